"""Line dedup, mixing and the pipeline, against plain versions."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from folioworks.llm import line_dedup, mixing

from .test_shingles import BLANK, shingles

DOCS = "doc_id long, text string"


WHITE = " \t\n\x0b\f\r"


def tokens(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text or "")


def plain_windows(text):
    """(start, words) of the windows of a text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    last = [ord(w[-1]) for w in words]
    starts = [i for i in range(len(words) - 29) if i == 0 or words[i - 1][-1] in line_dedup.ENDINGS or (last[i - 1] > 96 and last[i - 1] % line_dedup.CUT == 0)]
    hashes = [sum(last[i + k] * f for k, f in enumerate(line_dedup.FACTORS)) for i in starts]
    least = lambda k, first: all(hashes[j] >= hashes[k] for j in range(first, first + line_dedup.SPREAD) if 0 <= j < len(hashes))
    picked = sorted({p for k, p in enumerate(starts) if any(least(k, k - j) for j in range(line_dedup.SPREAD))} | ({len(words) - 30} if len(words) >= 30 else set()))
    return [(p, tuple(words[p : max(p + 30, q)])) for p, q in zip(picked, [*picked[1:], 0], strict=False)]


def plain_dedup(rows):
    """Words of windows that a lesser id, or the text itself, holds before."""
    windows = {d: plain_windows(t) for d, t in rows}
    first = {}
    for d in sorted(windows):
        for i, w in windows[d]:
            first.setdefault(w, (d, i))
    out = {}
    for d, t in rows:
        gone = {k for i, w in windows[d] if first[w] != (d, i) for k in range(i, i + len(w))}
        out[d] = ("".join(w for k, w in enumerate(tokens(t)) if k not in gone) if gone else t, len(gone))
    return out


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 8)))
    line = lambda n: " ".join(word() for _ in range(n)) + r.choice([".", ",", "!", "", ".\n", "\n\n", "..."])
    passages = [" ".join(line(r.randint(1, 14)) for _ in range(r.randint(2, 12))) for _ in range(6)]
    rows = []
    for i in range(120):
        bits = [line(r.randint(1, 20)) for _ in range(r.randint(0, 12))]
        for _ in range(r.choice((0, 0, 1, 2))):
            bits.insert(r.randrange(len(bits) + 1), r.choice(passages))
        rows.append((i, r.choice([" ", "\n"]).join(bits)))
    rows += [(200 + i, rows[3 * i][1]) for i in range(8)] + [(300, "same line here again.\n" * 60), (301, ""), (302, "x"), (303, "a b " * 30_000)]
    r.shuffle(rows)
    return rows


def test_line_dedup_is_brute_force(spark):
    for seed in (1, 2):
        rows = texts(seed)
        got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
        assert got == plain_dedup(rows)
        assert sum(n > 0 for _, n in got.values()) > 20


def test_pasted_passages_go(spark):
    """Passages of fifty words and more, with and without punctuation, at any place of a line: 95 % leave no fifty words."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwyzйюя") for _ in range(r.randint(2, 7)))
    words = lambda n, p: " ".join(word() + (r.choice([".", ",", ".\n"]) if r.random() < p else "") for _ in range(n))
    passages = [words(r.randint(50, 80), p) for p in (0, 0.1, 0.2) for _ in range(40)]
    rows = [(100 * k + j, f"{words(r.randint(0, 60), 0.1)} {q} {words(r.randint(0, 60), 0.1)}") for k, q in enumerate(passages) for j in range(2)]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    holds = lambda t, q: any(" ".join(q[i : i + 50]) in " ".join(t.split()) for i in range(len(q) - 49))
    assert all(got[100 * k] == rows[2 * k][1] for k in range(len(passages)))
    assert sum(not holds(got[100 * k + 1], q.split()) for k, q in enumerate(passages)) >= 0.95 * len(passages)
    # nothing but the passage goes
    assert all(len(tokens(got[100 * k + 1])) >= len(tokens(rows[2 * k + 1][1])) - len(q.split()) for k, q in enumerate(passages))


def test_line_dedup_odd_rows(spark):
    text = ". ".join(f"some words number {i} of a passage" for i in range(12)) + "."
    rows = [(5, text, "a"), (5, text, "a"), (2, text, "b"), (None, text, "c"), (None, None, "d"), (7, None, "e"), (8, " \n ", "f"), (9, "", "g"), (10, "x " * 29, "h"), (11, " " + "y z. " * 200_000, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumnRenamed("runs", "digest").withColumn("w", F.lit(1)).withColumn("r_id", F.lit(2))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "digest", "w", "r_id", "n_removed"]
    got = sorted(((x.doc_id, x.text, x.digest) for x in out.collect()), key=str)
    want = [(5, "", "a"), (5, "", "a"), (2, text, "b"), (None, "", "c"), *rows[4:9], (11, " y z. ", "i")]
    assert got == sorted(want, key=str)
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: w[s] * left / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else share[s] for s in names}
        capped |= over


def test_mixing(spark):
    r = random.Random(7)
    sources = ["b", "a", "é", "hot", None, "tiny", "none"]
    rows = [(i, " ".join("w" for _ in range(r.choice((1, 5, 40, 200, 900)))), r.choice(["hot"] * 6 + sources[:5]), i) for i in range(1500)]
    rows += [(2000, "one two", "tiny", 0), (2001, None, "none", 0), (2002, " \n", "none", 0), (None, "x y z", "a", 0), (3, rows[3][1], rows[3][2], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda x: str(tuple(x))
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    count = lambda t: len(re.findall(BLANK, t or ""))
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += count(t)
    want = plain_targets(sizes)
    whole = mixing.mix_sources(docs, whole=True).select("document.source", "document.text", "size", "source_size", "target", "taken").collect()
    taken = defaultdict(int)
    for x in whole:
        assert x["size"] == count(x.text) and x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6
        assert x.taken <= 3 * x["size"]
        taken[x.source] += x.taken
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(900, 0.02 * t)
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    slotted = mixing.mix_sources(docs, slot_rows=7).collect()
    for s, t in want.items():
        assert abs(sum(x.taken for x in slotted if x.source_size == sizes[s]) - t * list(sizes.values()).count(sizes[s])) <= max(900, 0.02 * t)


def test_mixing_ties_and_clashing_columns(spark):
    """Rows of one id and size: the same texts are taken on every run; a document's own columns come back as they are."""
    words = [f"w{i} x y" for i in range(40)]
    rows = [(7, w, "a", 1, i) for i, w in enumerate(words)] + [(None, w, "a", 1, i) for i, w in enumerate(words)] + [(7, words[0], "a", 1, 0)] * 2 + [(8, "o " * 400, "b", 2, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copy int").withColumn("target", F.lit("t"))
    runs = []
    for n in (1, 3, 8):
        got = mixing.mix_sources(docs.repartition(n), whole=True).select("copies", "document.*").collect()
        assert len(got) == len(rows) and {x.target for x in got} == {"t"}
        runs.append(sorted((str(x.doc_id), x.text, x["copy"], x["size"], x.copies) for x in got))
    assert runs[0] == runs[1] == runs[2] and len({x[-1] for x in runs[0]}) > 1
    import corpus_pipeline

    out = corpus_pipeline.mixing(spark, docs, "")
    assert out.columns == [*docs.columns, "source_size", "taken"] and {x["copy"] for x in out.collect()} <= set(range(40))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    word = lambda: "".join(r.choice(["th", "on", "er", "an", "re", "ing"]) for _ in range(r.randint(1, 4)))
    text = lambda n: "".join(word() + r.choice([" ", " ", " ", " ", ". ", ", "]) for _ in range(n))
    passage, item = text(70), " ".join(word() for _ in range(30))
    rows = [(i, text(r.randint(60, 200)), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, " ".join(rows[1][1].split()[:-2]), "en", "s1", 0), (102, text(80) + item + " " + text(80), "en", "s1", 0), (103, "12 34 !", None, "s1", 0), (104, None, None, None, 0)]
    rows += [(110 + k, text(90) + ". " + passage, "en", "s2", 0) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [{x.doc_id for x in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[:5] == docs.columns
        out.write.parquet(str(tmp_path / name))
        before = {x.doc_id: x.text for x in docs.collect()}
        docs = spark.read.parquet(str(tmp_path / name))
        now = {x.doc_id: x.text for x in docs.collect()}
        gone = set(before) - set(now)
        if name == "language_id":
            assert gone == {103, 104} and now == {d: t for d, t in before.items() if d in now}
        if name == "line_dedup":
            want = plain_dedup(list(before.items()))
            assert now == {d: t for d, (t, n) in want.items() if t.strip(WHITE) or not n}
            assert 100 in gone and len(now[111]) < len(before[111]) and now[110] == before[110]
        if name == "ngram_jaccard_join":
            sets = {d: shingles(t) for d, t in before.items()}
            near = {d for d in sets for e in sets if e < d and sets[d] and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e])}
            assert gone == near
        if name == "benchmark_decontamination":
            assert gone == {102}
        seen.append(set(now))
    assert docs.count() == len(docs.select("doc_id", "copy").distinct().collect())
    size = sum(len(re.findall(BLANK, t)) for t in before.values())
    assert abs(sum(x["size"] for x in docs.collect()) - size) < 0.25 * size


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null ids, repeated ids with other texts, repeated rows, clashing columns, and an empty table."""
    import corpus_pipeline

    r = random.Random(12)
    word = lambda: "".join(r.choice(["th", "on", "er", "an", "re", "ing"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    item, shared = text(30), text(90)
    rows = [(i, text(120), "en", f"s{i % 2}", 7, i, "x") for i in range(30)]
    rows += [(None, text(80), "en", None, 7, 1, "x"), (None, text(60) + " " + item, None, "s0", 7, 2, "y"), (40, text(50), None, "s1", 7, 3, None), (40, shared, "en", "s1", 7, 4, None)]
    rows += [(41, shared + " " + text(4), "en", "s1", 7, 5, None)] + [(42, text(70), "en", "s0", 7, 6, "z")] * 2 + [(43, None, "en", "s0", None, 7, None), (44, "", None, None, 0, 8, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy long, digest string"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, table in (("full", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(table, schema).write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(folder / "benchmark.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, str(folder))
            assert out.columns[:7] == docs.columns[:7]
            out.write.parquet(str(folder / stage))
            docs = spark.read.parquet(str(folder / stage))
            got = [(x.doc_id, x.text) for x in docs.collect()]
            if not table:
                assert got == []
            elif k == 0:
                assert {x.lang for x in docs.collect()} == {"en"} and len(got) == len(rows) - 2
            elif k == 1:
                assert sum(t == shared for _, t in got) == 1 and len(got) == len(rows) - 2 and {t for d, t in got if d == 42} == {rows[-4][1]}
            elif k == 2:
                assert sum(d == 42 for d, _ in got) == 1 and sum(d is None for d, _ in got) == 2 and sum(d == 40 for d, _ in got) == 2
            elif k == 3:
                assert not any(item in t for _, t in got) and sum(d is None for d, _ in got) == 1
    assert set(docs.columns) == {*schema.replace(",", "").split()[::2], "size", "source_size", "target", "taken"}


def test_windows_are_hashed_by_generated_code(spark, capsys):
    """One hash of thirty words a window: as interpreted lambdas they took a third of the time."""
    from folioworks.llm import line_dedup

    docs = spark.createDataFrame([(1, "one two three. " * 30), (2, None)], "doc_id long, text string").withColumn("digest", F.xxhash64("text"))
    line_dedup._windows(docs).explain()
    hashed = [line for line in capsys.readouterr().out.splitlines() if "xxhash64(slice(" in line]
    assert hashed and all("*(" in line.split("Project")[0] for line in hashed)


def test_texts_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    """The stages that give whole texts to Python: a task used to get up to 10,000 rows or 64 MB at once."""
    import corpus_pipeline
    from folioworks.llm import decontaminate, jaccard_join, language
    from folioworks.llm.stage import BATCH_BYTES

    def checked(f):
        def one(batch, *a):
            assert batch.nbytes <= 1.1 * BATCH_BYTES
            return f(batch, *a)

        return one

    def checked_all(f):
        return lambda batches: f(map(checked(lambda batch: batch), batches))

    monkeypatch.setattr(language, "_parts", checked(language._parts))
    monkeypatch.setattr(jaccard_join, "_texts", checked(jaccard_join._texts))
    monkeypatch.setattr(jaccard_join, "_sets_of", checked_all(jaccard_join._sets_of))
    search = decontaminate._search
    monkeypatch.setattr(decontaminate, "_search", lambda *a: checked_all(search(*a)))
    r = random.Random(13)
    words = ["".join(r.choices("abcdeinorst", k=r.randint(2, 8))) for _ in range(500)]
    rows = [(i, " ".join(r.choices(words, k=1200)), "en") for i in range(1500)]
    spark.createDataFrame([(1, rows[7][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for k in (0, 2, 3):
        docs = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).coalesce(1)
    assert sorted(x.doc_id for x in docs.select("doc_id").collect()) == [i for i in range(1500) if i != 7]
    assert spark.conf.get(key) == before
