"""The stored index: equal to scoring all pairs, and what it leaves unread."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from folioworks.operators import postings, retrieve


def plain(docs, queries, k, k1=1.5, b=0.75, epsilon=0.25):
    held = [(d, t.lower().split()) for d, t in docs if t]
    mean = sum(len(ws) for _, ws in held) / len(held)
    df = Counter(w for _, ws in held for w in set(ws))
    raw = {w: math.log(len(held) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = epsilon * sum(raw.values()) / len(raw)
    out = {}
    for q, text in queries:
        scores = []
        for d, ws in held:
            tf = Counter(ws)
            hits = [w for w in text.lower().split() if w in tf]
            if hits:
                part = sum((raw[w] if raw[w] >= 0 else floor) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / mean)) for w in hits)
                scores.append((-round(part, 6), d))
        out[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def corpus(seed, n=700):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(r.choices(words, weights, k=r.choice((0, 3, 30, 200))))) for i in range(n)]
    docs += [(n + i, docs[3 * i][1].upper()) for i in range(20)] + [(n + 20, None), (n + 21, "  \n"), (n + 22, "w399 w398 W397")]
    queries = [(f"q{i}", " ".join(r.choices(words, k=r.randint(1, 6)))) for i in range(25)] + [("none", "unknown words"), ("empty", ""), ("twice", "w300 w300 w1")]
    return docs, queries


def got_of(found):
    out = {}
    for x in sorted(found.best.collect(), key=lambda x: (x.query, -x.score, x.doc)):
        out.setdefault(x.query, []).append((x.doc, x.score))
    return out


def test_search_is_scoring_all(spark, tmp_path, monkeypatch):
    docs, queries = corpus(1)
    table, asked = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(queries, "q string, text string")
    monkeypatch.setattr(postings, "BLOCK_DOCS", 16)
    postings.write_index(table, "id", f"file://{tmp_path}/index", buckets=4)
    index = postings.Index.load(spark, f"file://{tmp_path}/index")
    for k in (1, 1000):
        found = postings.search(index, asked, "q", k)
        want = {q: hits for q, hits in plain(docs, queries, k).items() if hits}
        got = got_of(found)
        assert set(got) == set(want)
        for q, hits in want.items():
            assert [d for d, _ in got[q]] == [d for d, _ in hits] and all(math.isclose(a, b, abs_tol=2e-6) for (_, a), (_, b) in zip(got[q], hits, strict=True))
        counts = {x.query: (x.scored, x.blocks) for x in found.blocks.collect()}
        assert all(0 < scored <= blocks for scored, blocks in counts.values()) and set(counts) == set(want)
        if k == 1:  # most queries leave blocks out
            assert sum(scored < blocks for scored, blocks in counts.values()) > len(counts) / 2


def test_blocks_out_of_reach_are_left_out(spark, tmp_path):
    """One document in a hundred blocks has the rare words of the query: no other block is opened for its common ones."""
    docs = [(i, f"common words everywhere d{i} " * (1 + i % 3)) for i in range(6400)] + [(9000, "the rare treasure of common words " * 2), (9001, "rare treasure")]
    table = spark.createDataFrame(docs, "id long, text string").coalesce(1)
    index = postings.write_index(table, "id", f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, "rare treasure common")], "q long, text string")
    found = postings.search(index, asked, "q", 2)
    assert sorted(x.doc for x in found.best.collect()) == [9000, 9001]
    counts = found.blocks.first()
    assert counts.blocks >= 100 and counts.scored <= 4


def test_odd_indexes(spark, tmp_path):
    asked = spark.createDataFrame([(1, "a b"), (2, None)], "q long, text string")
    empty = postings.write_index(spark.createDataFrame([], "id string, text string"), "id", f"file://{tmp_path}/none")
    assert empty.documents == 0 and postings.search(empty, asked, "q", 3).best.collect() == []
    rows = [("x", "a b c"), ("x", "b d"), (None, "a e"), ("y", None), ("z", "f g"), ("u", "f h")]
    index = postings.write_index(spark.createDataFrame(rows, "id string, text string").withColumn("term", F.lit("t")).withColumn("doc", F.lit(1)), "id", f"file://{tmp_path}/odd")
    assert index.documents == 5 and math.isclose(index.mean_length, 11 / 5)
    assert {x.doc for x in postings.search(index, asked, "q", 9).best.collect()} == {"x", None}


def test_filled_up_results_are_those_of_all_pairs(spark, tmp_path):
    docs, queries = corpus(2, 150)
    table, asked = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "q string, text string")
    index = postings.write_index(table, "id", f"file://{tmp_path}/index", buckets=2)
    top = lambda scores: {(x.query, x.doc, x.score, x.rank) for x in retrieve.top_k(scores, table, "id", asked, "q", 6).select("query", "doc", F.round("score", 5).alias("score"), "rank").collect()}
    assert top(postings.search(index, asked, "q", 6).best) == top(retrieve.bm25_scores(table, "id", asked, "q"))


def test_scores_are_summed_where_their_documents_are(spark, capsys):
    """Texts move once, by document; rows of pairs of queries and documents don't move to be summed."""
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b d"), (2, "b b"), (3, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "a b b"), (8, "d x")], "item_id long, text string")
    scores = retrieve.bm25_scores(docs, "doc_id", queries, "item_id")
    scores.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(doc#" in plan and not re.search(r"hashpartitioning\(query#\d+L?, doc#", plan)
    assert {(r.query, r.doc) for r in scores.collect()} == {(7, 1), (7, 2), (8, 1)}


def test_ids_that_repeat_over_blocks(spark, tmp_path, monkeypatch):
    """Scores of rows of one id add up: a block was left out, or its part ranked alone, though the sum is among the best."""
    monkeypatch.setattr(postings, "BLOCK_DOCS", 2)
    docs = [(i, f"apple {'x ' * (5 + i // 3)}") for i in range(60)] + [(500, "apple " + "y " * (200 + 40 * i)) for i in range(12)] + [(600 + i, "pear plum") for i in range(90)]
    index = postings.write_index(spark.createDataFrame(docs, "id long, text string").repartition(3), "id", f"file://{tmp_path}/index", buckets=2)
    found = postings.search(index, spark.createDataFrame([("q", "apple")], "q string, text string"), "q", 3)
    parts, by_id = plain(docs, [("q", "apple")], 1000)["q"], {}
    for d, s in parts:
        by_id[d] = by_id.get(d, 0) + s
    want = sorted(by_id.items(), key=lambda x: (-x[1], x[0]))[:3]
    got = got_of(found)["q"]
    assert [d for d, _ in got] == [d for d, _ in want] and any(d == 500 for d, _ in got)
    assert all(math.isclose(a, b, abs_tol=1e-4) for (_, a), (_, b) in zip(got, want, strict=True))


def test_postings_move_once_for_a_search(spark, tmp_path, capsys):
    """Scores of all pairs of queries and documents moved too."""
    docs, queries = corpus(3)
    index = postings.write_index(spark.createDataFrame(docs, "id long, text string"), "id", f"file://{tmp_path}/index", buckets=2)
    postings.search(index, spark.createDataFrame(queries, "q string, text string"), "q", 3).best.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(query" in plan and "hashpartitioning(block" in plan and not re.search(r"hashpartitioning\(query#\w+, doc#", plan)
