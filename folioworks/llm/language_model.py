"""Scores of whole texts under a causal self-attention model of subwords, beside those of a model of single words.

Tokens are the words of a text, A-Z lower-cased, and its end. All counts come from the training texts, those that aren't held
out: of words for the base score, ``sum of log10((c + 1) / (N + V + 1))``, and of subwords for the network's vocabulary and for
the first weights of its outputs. A text's subwords are those of its words, a blank before each.

1. Blocks of texts are written with their distinct words, their counts in training texts, and their subwords.
2. The words of blocks go, packed, to the task of their bucket, which counts them, and the counts come back to the blocks.
3. The network starts from ``SAMPLE`` windows of training texts. Texts are drawn by their hashes, within a bound that the
   number of all windows gives, and their windows by hashes that follow from it; equal texts count once. From there each
   block's task goes through all windows of its training texts; the weights that come of it are averaged, by windows.
4. Each block scores its texts: words by their counts, subwords in overlapping windows by batched masked attention, each once.

Defined results: a null or empty text has the end as its only token; rows with a null id aren't held out; repeated rows
score alike; more columns are ignored; an empty table gives no rows; without training texts all subwords are equally
likely but for the network's ignorance. Texts of any length are read in parts, with words of the part before as context.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention as A
from . import shingles as S
from .blocks import Block, blocks, pack, unpack, word_hash
from .stage import Written, cut, rows_one_by_one

#: A public vocabulary of byte pairs, one token in base64 and its rank a line.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that goes with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of texts of a block; windows of training texts that the network starts from.
BLOCK, SAMPLE = 1 << 23, 32_000
#: Words of blocks that one task counts, the same word of several blocks each time.
BUCKET_WORDS = 1 << 21
#: Windows whose outputs are looked up at once; rows in which sums of weights reach the driver; tasks a core that training has at least.
TOGETHER, SUMS, SHARES = 2048, 8, 4
_SPACE = re.compile(r"\s")
_U = np.uint64


class Subwords:
    """The subwords of words; the symbol after the last one is the end, the next one the start."""

    def __init__(self, ranks: dict[bytes, int]):
        self.coder = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.length = np.zeros(self.end, dtype=np.int64)
        self.length[list(ranks.values())] = [len(x) for x in ranks]

    @property
    def start(self) -> int:
        return self.end + 1

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All subwords, word by word, and how many each word has."""
        # other white space could join with a neighbour's blank: such words are read alone
        plain = [w for w in words if not _SPACE.search(w)]
        flat = np.array(self.coder.encode_ordinary("".join(f" {w}" for w in plain)), dtype=np.uint32)
        starts = np.cumsum([0, *(len(w.encode()) + 1 for w in plain)])
        owner = np.searchsorted(starts, np.cumsum(self.length[flat]) - self.length[flat], "right") - 1
        counts = np.bincount(owner, minlength=len(plain)) if len(plain) else np.zeros(0, np.int64)
        if len(plain) == len(words):
            return flat, counts
        parts, done = iter(np.split(flat, np.cumsum(counts)[:-1])) if plain else iter(()), []
        for w in words:
            done.append(np.array(self.coder.encode_ordinary(f" {w}"), dtype=np.uint32) if _SPACE.search(w) else next(parts))
        return np.concatenate(done), np.array([len(x) for x in done], dtype=np.int64)


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    with open(path, "rb") as lines:
        return Subwords({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def held_from_fit(doc_id: str = "doc_id") -> Column:
    """True for rows whose crc32 of the id as text leaves remainder 2 on division by 7; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))



def _chunk_type(doc_id: str) -> str:
    texts = f"array<struct<row: bigint, doc_id: {doc_id}, held: boolean, draw: bigint, n: int>>"
    return f"chunk long, texts {texts}, ends boolean, starts boolean, words array<string>, counts array<long>, subwords array<int>, subword_counts array<long>, own binary, codes binary, pieces binary, piece_counts binary, first int, part int, windows long"


def _chunks(path: str, block_size: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = row = TaskContext.get().partitionId() << 36
        coder, part = subwords(path), 0
        for batch in batches:
            for block in blocks(batch.column("text"), S.BLANK_WORDS, before=A.CONTEXT + 1, size=block_size):
                serial += 1
                part = 0 if block.own[0] == 0 else part + 1
                yield _chunk(batch, block, coder, serial, row, part)
            row += batch.num_rows

    return chunks


def _chunk(batch: pa.RecordBatch, block: Block, coder: Subwords, serial: int, row: int, part: int) -> pa.RecordBatch:
    (first, last), (a, b) = block.own, block.texts
    held = batch.column("held").slice(a, b - a).to_numpy(zero_copy_only=False)
    own = block.codes[first:last]
    fit = ~held[block.text[first:last] - a]
    counts = np.bincount(own[fit], minlength=len(block.words))
    pieces, piece_counts = coder.of_words(block.words.to_pylist())
    ids, place = np.unique(pieces, return_inverse=True)
    many = np.bincount(place, weights=np.repeat(counts, piece_counts), minlength=len(ids)).astype(np.int64)
    n = np.bincount(block.text[first:last] - a, minlength=b - a)
    outputs = np.bincount(block.text[first:last] - a, weights=piece_counts[own], minlength=b - a) + block.ends
    texts = pa.StructArray.from_arrays([pa.array(row + np.arange(a, b)), batch.column("doc_id").slice(a, b - a), pa.array(held), batch.column("draw").slice(a, b - a), pa.array(n, pa.int32())], ["row", "doc_id", "held", "draw", "n"])
    one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
    cells = {
        "chunk": pa.array([serial]), "texts": one(texts, None), "ends": pa.array([block.ends]), "starts": pa.array([first == 0]), "words": one(block.words, None), "counts": one(counts, pa.int64()),
        "subwords": one(ids, pa.int32()), "subword_counts": one(many, pa.int64()), "own": pa.array([np.packbits(counts > 0).tobytes()]), "codes": pa.array([pack(block.codes)]), "pieces": pa.array([pack(pieces)]),
        "piece_counts": pa.array([pack(piece_counts)]), "first": pa.array([first], pa.int32()), "part": pa.array([part], pa.int32()), "windows": pa.array([int(np.ceil(outputs[~held] / A.SPAN).sum())]),
    }
    return pa.RecordBatch.from_arrays(list(cells.values()), list(cells))


def _outputs(row: dict, coder: Subwords, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a block's texts, all or the chosen, are to put out one after the other, how much each, and what stands before the first."""
    codes, pieces, counts = (unpack(row[c]).astype(np.int64) for c in ("codes", "pieces", "piece_counts"))
    at = np.cumsum(counts) - counts
    words = np.array([t["n"] for t in row["texts"]], dtype=np.int64)
    if chosen is not None:
        codes = np.concatenate((codes[: row["first"]], codes[row["first"] :][np.repeat(chosen, words)]))
        words = words[chosen]
    many = counts[codes]
    flat = pieces[np.repeat(at[codes], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    before = int(many[: row["first"]].sum())
    prefix, flat, many = flat[:before] if before else np.array([coder.start]), flat[before:], many[row["first"] :]
    sums = np.concatenate(([0], np.cumsum(many)))
    lengths = np.diff(sums[np.concatenate(([0], np.cumsum(words)))])
    if row["ends"]:
        flat = np.insert(flat, np.cumsum(lengths), coder.end)
        lengths = lengths + 1
    return flat, lengths, prefix


def _sampled(path: str, bound: int):
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(draw, window) of the training texts whose hash is within the bound: their windows' draws follow from it."""
        coder = subwords(path)
        for batch in batches:
            for row in batch.to_pylist():
                draws = np.array([t["draw"] for t in row["texts"]], dtype=np.int64)
                chosen = S.mix(draws.view(np.uint64)) >> _U(1) <= _U(bound)
                chosen &= ~np.array([t["held"] for t in row["texts"]], dtype=bool)
                if not chosen.any():
                    continue
                inputs, targets, owner = A.windows(*_outputs(row, coder, chosen))
                if not len(owner):
                    continue
                first = np.searchsorted(owner, owner)
                # parts of a text differ in their serial
                h = S.mix(draws[chosen][owner].view(np.uint64) + (np.arange(len(owner)) - first + 1).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(row["part"] << 32)) >> _U(1)
                both = np.concatenate((inputs, targets), axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array([x.tobytes() for x in both], pa.binary())], ["draw", "window"])

    return sampled


def _moved(path: str, net: A.Network):
    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The weights after each block's training windows, all from the same start, times the windows: a task's sum."""
        coder, total, sums = subwords(path), 0, 0.0
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                fit = ~np.array([t["held"] for t in row["texts"]], dtype=bool)
                if not fit.any():
                    continue
                inputs, targets, _ = A.windows(*_outputs(row, coder, fit))
                if len(inputs):
                    sums = sums + len(inputs) * A.moved(net, inputs, targets, row["chunk"]).astype(np.float64)
                    total += len(inputs)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([sums.tobytes()])], ["windows", "sums"])

    return moved


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, sums = 0, 0.0
    for batch in batches:
        for windows, one in zip(batch.column("windows").to_pylist(), batch.column("sums"), strict=True):
            total, sums = total + windows, sums + np.frombuffer(one.as_buffer(), np.float64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([sums.tobytes()])], ["windows", "sums"])


def _dealt_out(chunks: DataFrame) -> DataFrame:
    """Blocks over tasks of about equal numbers, if few of the input's parts hold them all: a file may have one part only."""
    most = SHARES * chunks.sparkSession.sparkContext.defaultParallelism
    loads = [n for _, n in chunks.groupBy(F.spark_partition_id()).count().limit(most).collect()]
    if len(loads) >= most or max(loads, default=0) <= 1:
        return chunks
    return chunks.repartition(min(sum(loads), most))


def fit_network(chunks: DataFrame, path: str, sample: int | None = None) -> tuple[A.Network, int]:
    """The network of the blocks' training texts, and their number: of all their windows, or of a ``sample`` alone.

    What reaches the driver is bounded by the vocabulary and the sample.
    """
    coder, whole = subwords(path), sample is None
    sample = SAMPLE if whole else sample
    counts = np.zeros(coder.end + 1)
    pairs = chunks.select(F.explode(F.arrays_zip("subwords", "subword_counts")).alias("x")).groupBy("x.subwords").agg(F.sum("x.subword_counts").alias("n"))
    for i, n in pairs.where("n > 0").collect():
        counts[i] = n
    # a text ends in its last part
    ends = F.expr("aggregate(texts, 0L, (n, t) -> n + if(t.held or not ends, 0L, 1L))")
    texts, windows = chunks.agg(F.sum(ends), F.sum("windows")).first()
    counts[coder.end] = texts or 0
    most = (1 << 63) - 1
    bound = most if not windows or windows <= 2 * sample else int(most * (2 * sample / windows))
    read = chunks.select("chunk", "texts", "ends", "part", "codes", "pieces", "piece_counts", "first")
    rows = read.mapInArrow(_sampled(path, bound), "draw long, window binary")
    rows = [bytes(w) for _, w in rows.groupBy("draw").agg(F.min("window").alias("window")).orderBy("draw").limit(sample).collect()]
    both = np.frombuffer(b"".join(rows), dtype=np.int32).reshape(len(rows), A.CONTEXT + 2 * A.SPAN).astype(np.int64)
    cells = both[:, : A.CONTEXT + A.SPAN], both[:, A.CONTEXT + A.SPAN :]
    net = A.train(A.make_vocabulary(counts, coder.end), *cells)[0]
    if whole and (windows or 0) > sample:
        sums = _dealt_out(read).mapInArrow(_moved(path, net), "windows long, sums binary").repartition(SUMS).mapInArrow(_added, "windows long, sums binary").collect()
        net = A.with_weights(net, sum(np.frombuffer(x.sums, np.float64) for x in sums) / sum(x.windows for x in sums))
    return net, int(counts[coder.end])


_DEALT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("lengths", pa.binary()), ("ks", pa.binary()), ("ns", pa.binary())])
_COUNTED = pa.schema([("chunk", pa.int64()), ("ks", pa.binary()), ("cs", pa.binary()), ("distinct", pa.int64())])


def _deal(buckets: int):
    """The words of blocks by bucket, packed."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, counts = batch.column("words")[k].values, batch.column("counts")[k].values.to_numpy()
                if not len(words):
                    continue
                bucket = (word_hash(words) % _U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                held, at = np.unique(bucket[order], return_index=True)
                rows = []
                for b, i, j in zip(held.tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
                    own = words.take(pa.array(order[i:j]))
                    data, offsets = S.utf8(own)
                    rows.append((b, batch.column("chunk")[k].as_py(), zstandard.compress(data[offsets[0] : offsets[-1]].tobytes(), 1), pack(np.diff(offsets)), pack(np.diff(order[i:j], prepend=0)), pack(counts[order[i:j]])))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _DEALT, strict=True)], schema=_DEALT)

    return deal


def _count_words(group: pa.Table) -> pa.Table:
    """A bucket: each word's count over all blocks, back to the blocks that can't tell it themselves."""
    words, sizes = [], []
    for data, lengths in zip(group.column("words").to_pylist(), group.column("lengths").to_pylist(), strict=True):
        lengths = unpack(lengths)
        offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        words.append(pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(zstandard.decompress(data))]))
        sizes.append(len(lengths))
    codes = pa.concat_arrays(words).dictionary_encode().indices.to_numpy()
    own = np.concatenate([unpack(x) for x in group.column("ns").to_pylist()]).astype(np.int64)
    counts = np.bincount(codes, weights=own).astype(np.int64)
    each, rows, at = counts[codes], [], 0
    for k, (chunk, ks, n) in enumerate(zip(group.column("chunk").to_pylist(), group.column("ks").to_pylist(), sizes, strict=True)):
        c, mine = each[at : at + n], own[at : at + n]
        other = c > np.minimum(mine, 1)
        rows.append((chunk, pack(np.cumsum(unpack(ks), dtype=np.uint32)[other]), zstandard.compress(c[other].tobytes(), 1), int((counts > 0).sum()) if k == 0 else 0))
        at += n
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _COUNTED, strict=True)], schema=_COUNTED)


def _scored(path: str, net: A.Network, ended: int, total: int, distinct: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, least = subwords(path), np.log10(total + distinct + 1)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = row.column("texts").flatten().field("doc_id")
                row = row.to_pylist()[0]
                inputs, targets, owner = A.windows(*_outputs(row, coder))
                sums = np.zeros(len(owner))
                for at in range(0, len(owner), TOGETHER):
                    sums[at : at + TOGETHER] = net.scores(inputs[at : at + TOGETHER], targets[at : at + TOGETHER]).sum(axis=1)
                texts = row["texts"]
                words = np.array([t["n"] for t in texts], dtype=np.int64)
                counts = np.unpackbits(np.frombuffer(row["own"], np.uint8)).astype(np.int64)
                for x in row["known"] or ():
                    counts[unpack(x["ks"])] = np.frombuffer(zstandard.decompress(x["cs"]), np.int64)
                c = counts[unpack(row["codes"])[row["first"] :]]
                owner_of = np.repeat(np.arange(len(texts)), words)
                base = np.bincount(owner_of, weights=np.log10(c + 1) - least, minlength=len(texts))
                known = np.bincount(owner_of[c > 0], minlength=len(texts))
                if row["ends"]:
                    base, known, words = base + np.log10(ended + 1) - least, known + (ended > 0), words + 1
                score = np.bincount(owner, weights=sums, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([pa.array([t["row"] for t in texts], pa.int64()), ids, pa.array([t["held"] for t in texts]), pa.array(words), pa.array(known), pa.array(base), pa.array(score)], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return scored


def score_texts(docs: DataFrame, ranks: str = RANKS, block_size: int = BLOCK, sample: int | None = None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs(doc_id, text)``.

    The network learns from all training texts, or from a ``sample`` of so many windows alone."""
    kind = dict(docs.dtypes)["doc_id"]
    named = docs.select("doc_id", F.col("text").cast("string"), held_from_fit().alias("held"), F.xxhash64("text").alias("draw"))
    with Written(named.mapInArrow(_chunks(ranks, block_size), _chunk_type(kind)), "zstd") as chunks, rows_one_by_one(docs.sparkSession):
        net, ended = fit_network(chunks, ranks, sample)
        size, total = chunks.agg(F.sum(F.size("words")), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x))).first()
        dealt = chunks.select("chunk", "words", "counts").mapInArrow(_deal(-(-(size or 1) // BUCKET_WORDS)), "bucket int, chunk long, words binary, lengths binary, ks binary, ns binary")
        counted = dealt.groupBy("bucket").applyInArrow(_count_words, "chunk long, ks binary, cs binary, distinct long")
        known = cut(counted.groupBy("chunk").agg(F.collect_list(F.struct("ks", "cs")).alias("known"), F.sum("distinct").alias("distinct")))
        distinct, total = known.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0], total or 0
        distinct, total = distinct + (ended > 0), total + ended
        both = chunks.select("chunk", "texts", "ends", "own", "codes", "pieces", "piece_counts", "first").join(known.drop("distinct"), "chunk", "left")
        out = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
        parts = cut(both.mapInArrow(_scored(ranks, net, ended, total, distinct), out))
    # parts of one text add up
    sums = (F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))
    whole = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums)
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
