"""The attention model: gradients, causality, normalisation, windows; scores of texts against a plain reading."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import attention as A
from folioworks.llm import language_model as L

DOCS = "doc_id long, text string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def small_network(seed=3, n=70, end=69):
    rng = np.random.default_rng(seed)
    counts = np.floor(1000 / (1 + np.arange(n))).astype(np.int64)
    counts[50:60] = 0
    v = A.make_vocabulary(counts, end)
    return A.Network(v, seed), rng


def test_windows_hold_each_output_once():
    r = np.random.default_rng(1)
    for prefix in ([99], [99] * 5, list(range(60))):
        lengths = np.array([1, 31, 32, 33, 64, 65, 200])
        flat = r.integers(0, 50, lengths.sum())
        inputs, targets, owner = A.windows(flat, lengths, np.array(prefix))
        first = 0
        for t, n in enumerate(lengths):
            seen, before = [], [*prefix, *flat[first : first + n]]
            for x, y in zip(inputs[owner == t], targets[owner == t], strict=True):
                for i in np.flatnonzero(y != A.NOTHING):
                    history = x[: A.CONTEXT + i + 1]
                    history = history[history != A.NOTHING].tolist()
                    stands = before[: len(prefix) + len(seen)]
                    assert history == stands[-len(history) :] and (len(history) == len(stands) or len(history) > A.CONTEXT)
                    seen.append(int(y[i]))
            assert seen == flat[first : first + n].tolist()
            first += n


def test_gradients_are_differences():
    net, rng = small_network()
    net.weights = {k: x.astype(np.float64) for k, x in net.weights.items()}
    inputs, targets, _ = A.windows(rng.integers(0, 70, 90), np.array([20, 70]), np.array([70]))
    net.weights["near"] += rng.standard_normal(net.weights["near"].shape)
    _, grads = net.gradients(inputs, targets)
    for name, w in net.weights.items():
        for at in {tuple(rng.integers(0, s) for s in w.shape) for _ in range(6)}:
            kept, loss = w[at], []
            for step in (1e-5, -1e-5):
                w[at] = kept + step
                loss.append(net.gradients(inputs, targets)[0])
            w[at] = kept
            assert math.isclose((loss[0] - loss[1]) / 2e-5, grads[name][at], rel_tol=2e-2, abs_tol=2e-6), (name, at)


def test_probabilities_add_up_and_see_no_future():
    net, rng = small_network()
    inputs = rng.integers(0, 70, (70, A.CONTEXT + A.SPAN))
    inputs[:] = inputs[0]
    inputs[:, : A.CONTEXT - 3] = A.NOTHING
    targets = np.full((70, A.SPAN), A.NOTHING)
    for place in (0, 7, A.SPAN - 1):
        targets[:] = A.NOTHING
        targets[:, place] = np.arange(70)
        assert abs((10 ** net.scores(inputs, targets)[:, place]).sum() - 1) < 1e-5
    targets = rng.integers(0, 70, (1, A.SPAN))
    other = inputs[:1].copy()
    other[:, A.CONTEXT + 10 :] = rng.integers(0, 70, other[:, A.CONTEXT + 10 :].shape)
    a, b = net.scores(inputs[:1], targets)[0], net.scores(other, targets)[0]
    assert np.allclose(a[:10], b[:10], atol=1e-6) and not np.allclose(a[10:], b[10:], atol=1e-3)


def test_scoring_is_the_forward_pass(monkeypatch):
    """Looked-up products and cache-sized batches give what training computes; huge logits don't overflow."""
    net, rng = small_network()
    inputs, targets, _ = A.windows(rng.integers(0, 70, 900), np.array([1, 399, 500]), np.array([70]))
    for scale in (1, 40):
        net.weights = {k: x * scale if k in ("class", "q") else x for k, x in net.weights.items()}
        loss, _ = net.gradients(inputs, targets)
        for together in (1, 7, 64):
            monkeypatch.setattr(A, "TOGETHER", together)
            got = net.scores(inputs, targets)
            assert np.isfinite(got).all() and math.isclose(-got.sum() * math.log(10) / 900, loss - net.vocabulary.rest[targets[targets != A.NOTHING]].mean() * math.log(10), rel_tol=1e-4)


def test_training_learns_what_context_tells():
    """Of a sequence that repeats itself after a random word, counts alone explain little."""
    rng = np.random.default_rng(5)
    flat = np.concatenate([np.repeat(rng.permutation(20), 2) for _ in range(900)])
    v = A.make_vocabulary(np.bincount(flat, minlength=25), 24)
    inputs, targets, _ = A.windows(flat, np.array([len(flat)]), np.array([25]))
    net, losses = A.train(v, inputs[:1000], targets[:1000], steps=128)
    test = net.scores(inputs[1000:], targets[1000:])[targets[1000:] != A.NOTHING]
    assert losses[0] > 2.9 and -test.mean() * math.log(10) < 2.3


def test_subwords_of_words_are_those_of_each_word():
    coder, r = L.subwords(L.RANKS), random.Random(2)
    words = ["a", "don't", "été", "x ", " y", " ", "日本語", "12345", "...", "'s", "\U0001f600!"] + ["".join(r.choices("abcé1.' ", k=r.randint(1, 9))) for _ in range(300)]
    flat, counts = coder.of_words(words)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [coder.coder.encode_ordinary(f" {w}") for w in words]
    assert [len(x) for x in coder.of_words([])] == [0, 0]


def plain_base(rows):
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    total, distinct = sum(c.values()), len(c)
    return [(d, h, len(ws), sum(w in c for w in ws), total, sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws)) for (d, _), h, ws in zip(rows, held, words, strict=True)]


def corpus(seed, n=150):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(200)]
    return [(i, r.choice([" ", "\n", "  "]).join(r.choice(words[: r.choice((10, 200))]) for _ in range(r.choice((0, 3, 40, 300))))) for i in range(n)]


def scored(spark, rows, block_size=1 << 23, sample=500, **columns):
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    for name, value in columns.items():
        docs = docs.withColumn(name, value)
    return L.score_texts(docs, block_size=block_size, sample=sample).collect()


def close(got, want):
    got, want = (sorted(x, key=lambda r: (r[0] is None, r)) for x in (got, want))
    return len(got) == len(want) and all(g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) for g, w in zip(got, want, strict=True))


def test_scores_are_those_of_a_plain_reading(spark, monkeypatch):
    rows, nets = corpus(1), []
    fit = L.fit_network
    monkeypatch.setattr(L, "fit_network", lambda *a: nets.append(fit(*a)) or nets[-1])
    got = scored(spark, rows)
    assert close([tuple(x)[:6] for x in got], plain_base(rows))
    net, coder = nets[0][0], L.subwords(L.RANKS)
    assert nets[0][1] == sum(not h for _, h, *_ in plain_base(rows))
    for x in got[:40]:
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[x.doc_id][1].translate(LOWER))
        flat = np.array([i for w in words for i in coder.coder.encode_ordinary(f" {w}")] + [coder.end])
        inputs, targets, _ = A.windows(flat, np.array([len(flat)]), np.array([coder.start]))
        assert math.isclose(x.score, net.scores(inputs, targets).sum(), rel_tol=1e-5)
    # parts of texts: the same counts, and every subword scored once, with its context
    monkeypatch.setattr(L, "fit_network", lambda *a: nets[0])
    cut = scored(spark, rows, block_size=100)
    assert close([tuple(x)[:6] for x in cut], plain_base(rows))
    whole = {x.doc_id: x.score for x in got}
    # windows lie elsewhere in the parts
    assert all(x.score < 0 and math.isclose(x.score, whole[x.doc_id], rel_tol=0.15, abs_tol=1) for x in cut)


def test_language_model_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "Some words"), (None, "some WORDS"), (7, "some words"), (7, "some words"), (8, "z" * 100_000), (9, "go on " * 20_000), (10, "x y   � 日本語")]
    got = scored(spark, rows, block_size=1 << 16, sample=50, chunk=F.lit(1), held=F.lit(2), words=F.lit("x"), row=F.lit(3))
    assert close([tuple(x)[:6] for x in got], plain_base(rows))
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x.score)
    assert len({round(s, 4) for s in by[1] + by[2] + by[3]}) == 1 and len({round(s, 4) for s in by[None] + by[7]}) == 1
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)
    assert scored(spark, []) == []
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in scored(spark, [(alone, "no training text")])] == [(4, 0, 0, 0.0)]


@pytest.mark.parametrize("seed", [4])
def test_held_out_texts_are_predicted(spark, seed):
    """Words follow one another by rule: held-out texts are likelier than under the counts of single words."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcde", k=4)) for _ in range(30)]
    follow = {w: r.sample(words, 2) for w in words}
    rows = []
    for i in range(500):
        text = [r.choice(words)]
        for _ in range(60):
            text.append(r.choice(follow[text[-1]]))
        rows.append((i, " ".join(text)))
    got = [x for x in scored(spark, rows, sample=3000) if x.held_out]
    assert len(got) > 40 and sum(x.score for x in got) > sum(x.base_score for x in got)


def test_all_training_windows_are_learnt_from(spark):
    """More windows than the network starts from: the others used to be left out."""
    r = random.Random(8)
    words = ["".join(r.choices("abcde", k=4)) for _ in range(400)]
    follow = {w: r.sample(words, 2) for w in words}
    rows = []
    for i in range(300):
        text = [r.choice(words)]
        for _ in range(2500):
            text.append(r.choice(follow[text[-1]]))
        rows.append((i, " ".join(text)))
    total = lambda sample: sum(x.score for x in scored(spark, rows, block_size=1 << 20, sample=sample) if x.held_out)
    some, every = total(L.SAMPLE), total(None)
    assert every > some + 0.01 * abs(some)


def test_blocks_reach_python_one_at_a_time(spark, monkeypatch):
    """A task's blocks used to come together, up to the engine's own limit."""
    inner = L._scored

    def checked(*a):
        score = inner(*a)

        def one(batches):
            for batch in batches:
                assert batch.num_rows == 1
                yield batch

        return lambda batches: score(one(batches))

    monkeypatch.setattr(L, "_scored", checked)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(scored(spark, corpus(1), block_size=1000)) == 150
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_steps_share_their_memory(monkeypatch):
    """Each step used to ask for all its arrays anew, some 8 MB."""
    import tracemalloc

    rng, peaks, inner = np.random.default_rng(6), [], A.Network.gradients
    counts = np.floor(1e6 / (1 + np.arange(5000))).astype(np.int64)
    flat = rng.choice(5000, A.BATCH * A.SPAN * 6 - 50, p=counts / counts.sum())
    inputs, targets, _ = A.windows(flat, np.array([len(flat)]), np.array([5000]))
    net = A.Network(A.make_vocabulary(counts, 4999), 6)

    def measured(*a):
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        found = inner(*a)
        peaks.append(tracemalloc.get_traced_memory()[1] - before)
        return found

    monkeypatch.setattr(A.Network, "gradients", measured)
    tracemalloc.start()
    try:
        A.moved(net, inputs, targets)
    finally:
        tracemalloc.stop()
    assert len(peaks) == 6 and max(peaks[2:]) < 2 << 20
    # what a batch leaves behind is not read by the next, also if that is smaller
    scratch, left = A.Scratch(), {k: np.full_like(x, 7) for k, x in net.weights.items()}
    for part in (slice(0, 64), slice(64, 69), slice(320, 384)):
        loss, got = inner(net, inputs[part], targets[part], left, scratch)
        alone, want = inner(net, inputs[part], targets[part])
        assert loss == alone and all((got[k] == want[k]).all() for k in want)


def test_members_of_classes_of_any_size_have_gradients():
    """Classes are gone through together by size: the same as one after the other."""
    rng = np.random.default_rng(7)
    for n in (3, 70, 5000):
        counts = np.floor(1e5 / (1 + np.arange(n))).astype(np.int64)
        net = A.Network(A.make_vocabulary(counts, n - 1), 7)
        size, v = net.vocabulary.size, net.vocabulary
        for many in (1, 900):
            rows, numbers = rng.standard_normal((many, A.WIDTH)).astype(np.float32), np.sort(rng.integers(0, size, many))
            g, d = {k: np.zeros_like(net.weights[k]) for k in ("member", "member0")}, np.zeros_like(rows)
            want, e, losses = {k: np.zeros_like(x) for k, x in g.items()}, np.zeros_like(rows), []

            def add(chosen, first, last, p):
                own = np.arange(len(chosen)), numbers[chosen] - first
                losses.append(-np.log(p[own]).sum())
                p[own] -= 1
                want["member"][first:last], want["member0"][first:last] = p.T @ rows[chosen] / 2, p.sum(axis=0) / 2
                e[chosen] += p @ net.weights["member"][first:last] / 2

            net._members(rows, numbers, add)
            loss = net._member_gradients(rows, numbers, 0.5, g, d, A.Scratch())
            assert math.isclose(loss, sum(losses), rel_tol=1e-4, abs_tol=1e-6)
            assert np.allclose(d, e, atol=1e-4) and all(np.allclose(g[k], want[k], atol=1e-4) for k in g)
        assert sum(len(b[2]) for b in net.bands) <= len(v.starts) - 1


def test_blocks_of_one_part_are_dealt_out(spark):
    """The blocks of a single file used to be gone through by one task."""
    blocks = spark.range(0, 9, 1, 1).withColumnRenamed("id", "chunk")
    loads = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    assert loads(L._dealt_out(blocks)) == [1] * 9 and sorted(r.chunk for r in L._dealt_out(blocks).collect()) == list(range(9))
    most = L.SHARES * spark.sparkContext.defaultParallelism
    assert max(loads(L._dealt_out(spark.range(0, 40 * most, 1, 2)))) == 40
    even = spark.range(0, 40 * most, 1, most)
    assert L._dealt_out(even) is even and L._dealt_out(even.where("id < 0")).count() == 0
