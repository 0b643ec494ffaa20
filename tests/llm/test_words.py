"""Operators on words and phrases, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioworks.llm import blocks, collocations, spelling

DOCS = "doc_id long, text string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(rows):
    total = Counter()
    for d, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += len(run) >= 5
    return {w: n for w, n in total.items() if n >= 3}


def edits(word, letters):
    """All words one edit away."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in letters:
        out |= {word[:i] + c + word[i:] for i in range(len(word) + 1)} | {word[:i] + c + word[i + 1 :] for i in range(len(word))}
    return out - {word}


def plain_groups(rows):
    words = plain_words(rows)
    letters, out = {c for w in words for c in w}, {}
    for w, n in words.items():
        near = [x for x in edits(w, letters) if x in words]
        form = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (form if near and words[form] >= 2 * n else None, n, len(near))
    got = set()
    for w, (form, n, many) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        got.add((w, form, root, n, many, words.get(form)))
    return got


def misspelt(seed, letters="abcdé", n=400):
    r = random.Random(seed)
    stems = ["".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(40)]
    near = [r.choice(sorted(edits(s, letters))) for s in stems for _ in range(3)]
    words = stems * 12 + near * 3 + [r.choice(sorted(edits(s, letters))) for s in near]
    text = lambda: r.choice(["", "1", ". "]).join([" "]) .join(r.choice([w, w.upper(), w.title()]) for w in r.choices(words, k=r.randint(0, 60)))
    return [(i, text()) for i in range(n)]


def groups(spark, rows, **columns):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    for name, value in columns.items():
        docs = docs.withColumn(name, value)
    return [tuple(x) for x in spelling.group_spellings(docs).collect()]


def test_spelling_is_brute_force(spark):
    for seed in (1, 2):
        rows = misspelt(seed)
        got = groups(spark, rows)
        assert len(got) == len(set(got)) and set(got) == plain_groups(rows)
        assert sum(form is not None for _, form, *_ in got) > 50 and any(root != form for _, form, root, *_ in got if form)


def test_crowded_keys_are_split(spark):
    """A thousand words with the same first half, and as many with the same second half: no pair is lost or counted twice."""
    r = random.Random(3)
    ends = ["".join(r.choice("abcd") for _ in range(5)) for _ in range(700)]
    vocabulary = sorted({f"hothot{e}" for e in ends} | {f"{e}hothot" for e in ends} | {f"hothot{e[:4]}" for e in ends[:200]} | {"aaaaaa", "aaaaaaa", "aaaaaaaa"})
    words = spark.createDataFrame([(w, 3 + i % 50) for i, w in enumerate(vocabulary)], "word string, n long")
    known, letters = set(vocabulary), {c for w in vocabulary for c in w}
    want = sorted((w, x) for w in vocabulary for x in edits(w, letters) & known)
    for crowded in (8, 64, 10**6):
        assert sorted((x.word, x.near) for x in spelling.near_words(words, crowded).collect()) == want
    sizes = spelling.keyed_words(words, 64).groupBy("size", "lo", "hi", "spared").count().where("hi - lo > 1")
    assert sizes.agg(F.max("count")).first()[0] <= 64


def test_spelling_odd_rows(spark):
    long = "z" * 9_000
    rows = [(1, "house HOUSE house"), (1, "house HOUSE house"), (2, "hause hause hause"), (None, "housé housé housé"), (None, None), (3, ""), (4, "ÀÉÎÕÜ ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ×÷×÷× ×÷×÷× ×÷×÷×"), (5, f"{long} {long}x " * 3), (6, "ab cd " * 300_000)]
    got = groups(spark, rows, word=F.lit("x"), n=F.lit(1), size=F.lit(2))
    assert {w: n for w, _, _, n, *_ in got} == plain_words(rows) and len(got) == len(plain_words(rows))
    assert ("hause", "house", "house", 3, 1, 6) in got and ("housé", "house", "house", 3, 1, 6) in got and ("house", None, "house", 6, 2, None) in got
    assert [x[4] for x in got if len(x[0]) > 8_000] == [1, 1]
    assert groups(spark, []) == []


def test_slices_join_to_the_text():
    r = random.Random(5)
    text = "".join(r.choice("abé .1") for _ in range(3000)) + "w" * 500 + " x"
    for size in (1, 7, 100, 5000):
        parts = list(spelling.slices(text, size))
        assert "".join(parts) == text
        assert [w for p in parts for w in re.findall(spelling.LETTERS, p)] == re.findall(spelling.LETTERS, text)


def plain_collocations(rows, least, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for m in range(1, 6):
                for i in range(len(ws) - m + 1):
                    counts[lang or "und"][tuple(ws[i : i + m])] += 1
    got = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= least}
        longest = Counter()
        for p, a in frequent.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        longest[p[i:j]] = max(longest[p[i:j]], a)
        scored = []
        for p, a in frequent.items():
            if len(p) > 1 and longest[p] < a:
                score, k = min(((1000 * a * n[lang]) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        got += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return set(got)


def sentences(seed, n=300):
    r = random.Random(seed)
    words = ["a", "b", "The", "of", "é", "Zu", "ñx", "rare", "\U0001f600", "x-y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda: "".join(r.choices(words, weights)[0] + r.choice([" "] * 8 + ["  ", "\t", ".", ", ", "\n", " ! "]) for _ in range(r.randint(0, 40)))
    return [(r.choice(["en", "en", "de", None, "und"]), r.choice([text(), "b of the a b of the a b of the a"])) for _ in range(n)]


def mined(spark, rows, *args, **columns):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for name, value in columns.items():
        docs = docs.withColumn(name, value)
    return [tuple(x) for x in collocations.collocations(docs, *args).collect()]


@pytest.mark.parametrize("pivot, top, sent", [(1 << 19, 2000, 1 << 25), (40, 7, 0), (40, 2000, 1 << 25), (1 << 19, 2000, 0)])
def test_collocations_are_brute_force(spark, monkeypatch, pivot, top, sent):
    """Also with pivots dealt to several tasks, a cut among ties, and numbers that come back by a join."""
    monkeypatch.setattr(collocations, "PIVOT_WORDS", pivot)
    monkeypatch.setattr(collocations, "DICTIONARY_BYTES", sent)
    monkeypatch.setattr(collocations, "BUCKET_WORDS", 500)
    for seed in (1,):
        rows = sentences(seed)
        got = mined(spark, rows, 5, top)
        assert len(got) == len(set(got)) and set(got) == plain_collocations(rows, 5, top)
        assert {x[0] for x in got} == {"en", "de", "und"} and any(len(x[2].split()) == 5 for x in got)


def test_collocations_odd_rows(spark):
    rows = [("en", None), ("en", ""), (None, " \t. "), ("xx", "one"), ("en", "go on " * 30_000), ("en", "go on"), ("en", "go on")]
    assert set(mined(spark, rows, 100, key=F.lit(1), n=F.lit(2), chunk=F.lit("x"), word=F.lit("y"))) == plain_collocations(rows, 100)
    assert mined(spark, [], 2) == []
    # the default keeps what occurs a hundred times
    assert [x[2:4] for x in mined(spark, [("en", "ever more")] * 100 + [("en", "never more")] * 99)] == [("ever more", 100)]


def test_scores_are_exact(spark):
    """Products beyond 64 bits, and quotients that doubles would round."""
    r = random.Random(4)
    rows = [("en", i, r.randrange(10**12, 10**14), r.randrange(10**14, 10**16), r.randrange(10**14, 10**16), r.randrange(10**15, 10**17)) for i in range(200)]
    got = spark.createDataFrame(rows, "lang string, i long, a long, l long, r long, n long").select("i", F.expr(collocations._EXACT).alias("score")).collect()
    assert {x.i: x.score for x in got} == {i: 1000 * a * n // (left * right) for _, i, a, left, right, n in rows}


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations, "_row_hash", lambda rows: np.zeros(len(rows), dtype=np.uint64))
    rows = np.array([[1, 2], [3, 4], [1, 2], [3, 5], [3, 4], [1, 2]], dtype=np.uint32)
    held, sums = collocations._summed(rows, np.array([1, 1, 1, 1, 1, 5]))
    assert sorted((*map(int, x), int(n)) for x, n in zip(held, sums, strict=True)) == [(1, 2, 7), (3, 4, 2), (3, 5, 1)]


@pytest.mark.parametrize("context, before", [(0, None), (4, None), (0, 7), (3, 0)])
def test_blocks_hold_each_word_once(context, before):
    r = random.Random(6)
    texts = ["", None, " ", "One"] + ["".join(r.choice(["ab", "É", " ", "\t", ".", "c d", "xyz" * 30]) for _ in range(r.choice((3, 50, 4000)))) for _ in range(20)]
    inside, breaks = collocations._INSIDE, collocations._BREAKS
    for size in (64, 1000, 1 << 20):
        got, seen = defaultdict(list), 0
        for b in blocks.blocks(pa.array(texts), inside, breaks, context, size, before):
            words = b.words.to_pylist()
            assert len(set(words)) == len(words) and set(b.codes.tolist()) == set(range(len(words)))
            for k in range(*b.own):
                got[int(b.text[k])].append((words[b.codes[k]], bool(b.fresh[k])))
            left, right = b.own[0], len(b.codes) - b.own[1]
            assert left <= (context if before is None else before) and right <= context
            seen += b.ends * (b.texts[1] - b.texts[0])
        assert seen == len(texts)
        for i, t in enumerate(texts):
            pieces = [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", (t or "").translate(LOWER))]
            assert [w for w, _ in got[i]] == [w for p in pieces for w in p]
            if before is None and context:
                assert [f for _, f in got[i]] == [k == 0 for p in pieces for k in range(len(p))]
