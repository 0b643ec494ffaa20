"""Operators on pairs, against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioworks.llm import embeddings, jaccard_join
from folioworks.llm import shingles as S
from folioworks.llm.components import connected_components
from folioworks.llm.decontaminate import find_leaks

from .test_shingles import PLAIN, shingles

DOCS = "doc_id long, text string"


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        i, j = find(a), find(b)
        parent[max(i, j)] = min(i, j)
    return {n: find(n) for n in nodes}


def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    inverted = {}
    for d, s in sets.items():
        for x in s:
            inverted.setdefault(x, []).append(d)
    pairs = {p for ds in inverted.values() for p in itertools.combinations(sorted(ds), 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, components(list(sets), links)


def near_copies(seed, n=220):
    """Groups of copies of every size, long shared passages, and edits that put pairs on both sides of the threshold."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.choice((4, 12, 60, 100)))]
        for _ in range(r.choice((1, 2, 5, 30))):
            copy = base[:]
            for _ in range(r.choice((0, 0, 1, 1, 2, 3, 5))):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy + (passage if r.random() < 0.2 else [])))
    rows += [" ".join(passage), " ".join(passage), "", "one", "one", " \n\t ", "ONE"]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows[:n])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join_is_brute_force(spark, seed):
    rows = near_copies(seed)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    sets, want = brute_components(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(sets[d]), want[d]) for d, _ in rows}


def test_leading_bits_alone_link_nothing(spark, monkeypatch):
    """Shingles whose leading bits agree: words that 42 bits can't tell apart, and, by 32 bits, a pair just below the threshold."""
    rows = [(1, "w2106070"), (2, "w2665008"), (3, "w545580"), (4, "w846715"), (5, "w2106070")]
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    heads = [f"a{i} b{i} c d e{i % 7}" for i in range(250_000)]
    hashes = np.concatenate([m for _, m in S.shingle_sets(pa.array(heads), S.BLANK_WORDS)]) >> np.uint64(32)
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])[0]
    tail = " ".join(f"t{i}" for i in range(40))
    one, other = (f"{heads[order[k]]} {tail}" for k in (same, same + 1))
    monkeypatch.setattr(jaccard_join, "LEAST_BITS", 0)
    monkeypatch.setattr(jaccard_join, "MOST_BITS", 0)
    rows = [(1, one), (2, other), (3, f"{one} more"), (4, f"{other} more")]
    sets, want = brute_components(rows)
    for sent in (1 << 20, 0):
        monkeypatch.setattr(jaccard_join, "SENT_NODES", sent)
        got = jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
        assert {r.doc_id: r.component_id for r in got} == want
    assert want[1] != want[2]


def test_jaccard_join_odd_rows(spark):
    text = "a b c d e f g h i j"
    rows = [(5, text, 1), (3, text, 1), (3, text, 1), (None, text, 1), (None, None, 1), (7, None, 1), (8, "", 1), (9, "lone words here", 1), (None, "x y z q r s t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()), key=str)
    want = [(5, 6, 3), (3, 6, 3), (3, 6, 3), (None, 6, 3), (None, 0, None), (7, 0, 7), (8, 0, 8), (9, 1, 9), (None, 3, None)]
    assert got == sorted(want, key=str)
    assert jaccard_join.near_duplicates(docs.limit(0)).collect() == []
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 0, 3, 7, 8, 9]


def test_versions_stand_for_their_own_components(spark):
    shared, clean, other = "a b c d e f g h i j", "k l m n o p q r s t", "quite another text of more than five words"
    rows = [(1, shared), (2, shared), (2, clean), (2, clean), (3, clean + " u"), (4, other), (4, clean), (5, ""), (5, None)]
    for order in (1, -1):
        kept = jaccard_join.representatives(spark.createDataFrame(rows[::order], DOCS)).collect()
        assert sorted(map(tuple, kept), key=str) == sorted([(1, shared), (2, clean), (4, other), (5, ""), (5, None)], key=str)


def test_long_documents_link(spark):
    r = random.Random(4)
    base = [str(r.randrange(10**6)) for _ in range(30_000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:27_000])), (3, " ".join(base[:10_000]))]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(1, None), (None, None), (7, 7)]
    want = components(sorted({n for a, b in links if None not in (a, b) and a != b for n in (a, b)}), [x for x in links if None not in x and x[0] != x[1]])
    got = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {(x.node, x.root) for x in got} == set(want.items()) and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_embeddings_are_brute_force(spark):
    g = np.random.default_rng(3)
    centres = g.standard_normal((6, 16))
    rows = []
    for i in range(300):
        x = centres[g.integers(6)] + g.standard_normal(16) * g.choice([0.05, 0.2, 0.27])
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(g.integers(3))))
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(20)] + [(2000 + k, [2 * v for v in rows[k][1]], rows[k][2]) for k in range(5)]
    bad = [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] + [1.0] * 15, 1), (3003, [None] + [1.0] * 15, 1), (3004, rows[0][1], None), (3005, [float("inf")] * 16, 1), (3006, [], 1), (3007, rows[0][1][:8], 1), (3008, rows[0][1][:8], 1)]
    links = []
    for (a, x, s), (b, y, t) in itertools.combinations(rows + bad[-2:], 2):
        if s == t and len(x) == len(y):
            u, v = np.array(x, dtype=float), np.array(y, dtype=float)
            if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
                links.append((a, b))
    want = components([r[0] for r in rows + bad], links)
    degree = {n: sum(n in x for x in links) for n in want}
    got = embeddings.near_embeddings(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int"), tile=32).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(n, degree[n], c, n == c) for n, c in want.items()}
    assert len(got) == len(rows + bad)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_embeddings(empty).collect() == []


@pytest.mark.parametrize("width", [700, 2048])
def test_wide_embeddings_are_brute_force(spark, width):
    """More dimensions than float32 adds up exactly, a pair at the threshold, clashing columns, vectors of other lengths."""
    g = np.random.default_rng(8)
    centres = g.standard_normal((3, width))
    rows = [(i, [float(v) for v in centres[i % 3] + g.standard_normal(width) * g.choice([0.1, 0.27, 0.28])], "s" if i % 7 else "t") for i in range(90)]
    rows += [(200, [1.0] + [0.0] * 9, "s"), (201, [0.93, (1 - 0.93**2) ** 0.5] + [0.0] * 8, "s"), (202, [0.929, (1 - 0.929**2) ** 0.5] + [0.0] * 8, "s")]
    links = []
    for (a, x, s), (b, y, t) in itertools.combinations(rows, 2):
        if s == t and len(x) == len(y) and np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= 0.93:
            links.append((a, b))
    want = components([r[0] for r in rows], links)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("key", F.lit(1)).withColumn("raw", F.lit("x"))
    got = embeddings.near_embeddings(docs, tile=16).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(n, sum(n in x for x in links), c) for n, c in want.items()}
    q, r = (g.integers(-127, 128, (8, width), dtype=np.int8) | np.int8(120) for _ in "ab")
    assert (embeddings.products(q, r) == q.astype(int) @ r.astype(int).T).all()


def test_few_pairs_are_computed_again():
    """The bounds settle all pairs but those near the threshold."""
    g = np.random.default_rng(9)
    x = embeddings.normalised(g.standard_normal((5, 64))[g.integers(5, size=600)] + 0.3 * g.standard_normal((600, 64)))
    tile = embeddings.quantised(x)
    sure, opened = embeddings.tile_links(tile, tile, 0.93)
    cosines = x @ x.T
    assert (cosines[sure] >= 0.93).all() and (np.abs(cosines[opened] - 0.93) < 0.04).all()
    assert len(sure[0]) + (cosines[opened] >= 0.93).sum() == (cosines >= 0.93).sum() and len(opened[0]) < 0.1 * cosines.size


def test_quantised_bounds_hold():
    g = np.random.default_rng(5)
    x, y = (embeddings.normalised(g.standard_normal((200, 24)) * np.exp(3 * g.standard_normal((200, 24)))) for _ in "ab")
    (q, s, e), (r, t, f) = embeddings.quantised(x), embeddings.quantised(y)
    rough = (q.astype(float) @ r.astype(float).T) * s[:, None] * t[None]
    assert (np.abs(rough - x @ y.T) <= (1 + e)[:, None] * f[None] + e[:, None] + 1e-12).all()


@pytest.mark.parametrize("block", [30, 10**6])
def test_leaks_are_brute_force(spark, block):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(r.choice((2, 4, 5, 9, 30, 80))))) for k in range(25)] + [(90, None), (91, ""), (92, " . "), (93, "Aa bb")]
    docs = []
    for d in range(60):
        w = [word() for _ in range(r.choice((3, 50, 2000)))]
        for _ in range(r.choice((0, 1, 2))):
            copy = items[r.randrange(25)][1].split()
            if r.random() < 0.5:
                copy[r.randrange(len(copy))] = word()
            at = r.randrange(len(w))
            w[at:at] = [c.upper() + "," if r.random() < 0.3 else c for c in copy]
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, ""), (None, "xx " + items[3][1] + " yy"), (102, "aa, BB!")]
    import re

    from .test_shingles import lower

    want = set()
    for k, t in items:
        q = shingles(t, PLAIN)
        n = len(re.findall(PLAIN, lower(t or "")))
        for d, text in docs:
            w = re.findall(PLAIN, lower(text or ""))
            own = {tuple(w[i : i + min(n, 5)]) for i in range(len(w) - min(n, 5) + 1)}
            if q and 100 * len(q & own) >= 80 * len(q):
                want.add((d, k, len(q & own), len(q)))
    # columns with clashing names, repeated documents and items
    frames = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(1)).withColumn("n_item", F.lit(2)), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = find_leaks(*frames, block_shingles=block).collect()
    assert sorted(((x.doc_id, x.item_id, x.n_shared, x.n_item) for x in got), key=str) == sorted(want, key=str) and len(want) > 20
    twice = find_leaks(frames[0].union(frames[0]), frames[1].union(frames[1]), block_shingles=block)
    assert twice.count() == 4 * len(want)
    assert find_leaks(frames[0], frames[1].limit(0)).collect() == [] and find_leaks(frames[0].limit(0), frames[1]).collect() == []
