"""Phrases and collocations, mined by pivot partitioning.

Texts, A-Z lower-cased, are split into pieces at ``BREAKS`` and these into words at blanks. A phrase is 2 to ``LONGEST`` words
that stand together in a piece; those that occur ``least`` times in a language are candidates. A candidate cut after its
first k words scores ``floor(1000 * a * n / (l * r))``, for its own count a, those of the two parts and the number n of words
of its language; its lowest cut counts. A candidate goes if a longer one that contains it is as frequent.

1. Words are counted by language, through the distinct words of blocks of texts; those that occur ``least`` times are
   numbered from the most frequent one on. The numbers are sent to all tasks up to ``DICTIONARY_BYTES``; beyond, the blocks
   are written and their words' numbers come back to them by a join. All other words only break pieces.
2. A phrase's *pivot* is its rarest word, at its first place in the phrase. Each place of a word yields one fragment: the
   word, up to four words before it that are more frequent, and up to four behind it that aren't rarer. So a phrase at a
   place is in the fragment of one pivot, once. Equal fragments of a block are one with a count.
3. Fragments go to the task of their pivot, which counts the phrases that hold the pivot and drops the infrequent ones.
   Fragments of a pivot that occurs more than ``PIVOT_WORDS`` times are dealt to several tasks; theirs are summed after.
4. Counts of the parts, the test for longer candidates and the report are joins and windows over the frequent phrases.

Counts are exact 64-bit integers, products decimals of 38 digits. Equal hashes of unequal phrases are told apart.

Defined results: null texts are empty, null languages ``und``; repeated rows count each; ids play no part; more columns are
ignored; an empty table gives no rows. A text of any length is read in parts that overlap by four words. 2 ** 32 - 1 words
can be numbered; more raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .blocks import Block, blocks
from .stage import Written, cut

# What ends a piece.
BREAKS = ".,;:!?\n\x0b\x0c\r"
LEAST, LONGEST, TOP = 100, 5, 2000
#: Places of words of one language that a task mines at a time, and of one word before it is dealt to several.
BUCKET_WORDS, PIVOT_WORDS = 1 << 20, 1 << 19
#: Frequent words, in bytes, that are sent to all executors; more come back to written blocks by a join.
DICTIONARY_BYTES = 1 << 25
_U = np.uint64
_NONE = np.uint32(0xFFFFFFFF)
_BREAKS = np.isin(np.arange(256), list(map(ord, BREAKS)))
_INSIDE = ~(_BREAKS | np.isin(np.arange(256), [0x20, 0x09]))
_REACH = LONGEST - 1

_CHUNKS = "chunk long, lang string, words array<string>, codes binary, first int, last int"
_FRAGMENTS = "lang string, bucket int, whole boolean, shapes binary, pivots binary, ids binary, counts binary"
_CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("codes", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])
_FRAGMENT_SCHEMA = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("whole", pa.bool_()), ("shapes", pa.binary()), ("pivots", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Block]]:
    """The blocks of each language that hold words of their own."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        order = np.argsort(langs.indices.to_numpy(), kind="stable")
        texts, at = batch.column("text").take(pa.array(order)), np.searchsorted(langs.indices.to_numpy()[order], np.arange(len(langs.dictionary) + 1))
        for lang, i, j in zip(langs.dictionary.to_pylist(), at[:-1], at[1:], strict=True):
            for block in blocks(texts.slice(i, j - i), _INSIDE, _BREAKS, context=_REACH):
                if block.own[0] < block.own[1]:
                    yield lang, block


def _codes(block: Block) -> np.ndarray:
    return block.codes.astype(np.uint32) * 2 + block.fresh


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f): the distinct words of each block, and null with the number of all."""
    for lang, block in _blocks(batches):
        first, last = block.own
        counts = np.bincount(block.codes[first:last], minlength=len(block.words))
        words = pa.concat_arrays([block.words, pa.array([None], pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), words, pa.array(np.append(counts, last - first))], ["lang", "word", "f"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    serial = TaskContext.get().partitionId() << 32
    for lang, block in _blocks(batches):
        serial += 1
        row = [[serial], [lang], pa.ListArray.from_arrays([0, len(block.words)], block.words), [_codes(block).astype("<u4").tobytes()], [block.own[0]], [block.own[1]]]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, list) else x for x, f in zip(row, _CHUNK_SCHEMA, strict=True)], schema=_CHUNK_SCHEMA)


def _row_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        h = S.mix(h ^ rows[:, k].astype(np.uint64), k + 1)
    return h


def _summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their counts."""
    if not len(rows):
        return rows, counts
    h = _row_hash(rows)
    order = np.argsort(h)
    for again in (False, True):
        if again:
            order = np.lexsort(rows.T)
        held = rows[order]
        new = np.concatenate(([True], (held[1:] != held[:-1]).any(axis=1)))
        # unequal rows of one hash may stand mixed: then they are sorted by their values
        if again or not (new[1:] & (h[order[1:]] == h[order[:-1]])).any():
            break
    first = np.flatnonzero(new)
    return held[first], np.add.reduceat(counts[order], first)


def _pieces(codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words, with breaks between pieces and at both ends, and where each word went."""
    value = ids[codes >> 1]
    place = np.arange(len(codes)) + np.cumsum(codes & 1, dtype=np.int64) + _REACH
    out = np.full(int(place[-1]) + 1 + _REACH, _NONE, dtype=np.uint32)
    out[place] = value
    return out, place


def fragments_of(codes: np.ndarray, ids: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fragments, nine words with the pivot amid and ``_NONE`` outside, of more than one word, and their counts.

    ``codes`` are twice the word's index in ``ids``, and one more where a piece begins.
    """
    values, place = _pieces(codes, ids)
    at = place[first:last]
    at = at[values[at] != _NONE]
    pivot = values[at]
    rows = np.full((len(at), 2 * _REACH + 1), _NONE, dtype=np.uint32)
    rows[:, _REACH] = pivot
    for step, rarer in ((-1, np.less), (1, np.less_equal)):
        reached = np.ones(len(at), dtype=bool)
        for k in range(1, _REACH + 1):
            near = values[at + step * k]
            reached &= rarer(near, pivot)
            rows[reached, _REACH + step * k] = near[reached]
    rows = rows[(rows[:, _REACH - 1] != _NONE) | (rows[:, _REACH + 1] != _NONE)]
    return _summed(rows, np.ones(len(rows), dtype=np.int64))


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by their first bytes, second bytes and so on: most of the later ones are zeros, which compress."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _dealt(lang: str, codes: np.ndarray, known: np.ndarray, first: int, last: int, buckets: int) -> pa.RecordBatch | None:
    """The fragments of a block by bucket. ``known`` has (index, number, tasks) of its words that are frequent."""
    size = int(codes.max() >> 1) + 1
    ids = np.full(size, _NONE, dtype=np.uint32)
    ids[known[:, 0]] = known[:, 1]
    rows, counts = fragments_of(codes, ids, first, last)
    if not len(rows):
        return None
    pivot = rows[:, _REACH]
    known = known[np.argsort(known[:, 1])]
    tasks = known[np.searchsorted(known[:, 1], pivot), 2].astype(np.uint64)
    bucket = S.mix(S.mix(pivot.astype(np.uint64)) + _row_hash(rows) % tasks) % _U(buckets)
    key = bucket.astype(np.int64) * 2 + (tasks == 1)
    order = np.lexsort((pivot, key))
    rows, counts, key = rows[order], counts[order], key[order]
    held, at = np.unique(key, return_index=True)
    inside = rows != _NONE
    shapes = (inside[:, :_REACH].sum(axis=1) * 8 + inside[:, _REACH + 1 :].sum(axis=1)).astype(np.uint8)
    inside[:, _REACH] = False
    out = []
    for k, i, j in zip(held.tolist(), at.tolist(), [*at[1:].tolist(), len(key)], strict=True):
        pivots = np.diff(rows[i:j, _REACH], prepend=np.uint32(0))
        out.append((lang, k >> 1, bool(k & 1), shapes[i:j].tobytes(), _planes(pivots), _planes(rows[i:j][inside[i:j]]), _planes(counts[i:j])))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _FRAGMENT_SCHEMA, strict=True)], schema=_FRAGMENT_SCHEMA)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks that their words' numbers have come back to."""
    for batch in batches:
        for row in batch.to_pylist():
            known = np.array([(x["k"], x["id"], x["tasks"]) for x in row["known"]], dtype=np.int64)
            found = _dealt(row["lang"], np.frombuffer(row["codes"], "<u4"), known, row["first"], row["last"], row["buckets"])
            if found is not None:
                yield found


def _looked_up(dictionary: dict[str, tuple[pa.Array, np.ndarray, np.ndarray, int]]):
    """The same of texts, by words, numbers, tasks and buckets of each language."""

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in _blocks(batches):
            words, ids, tasks, buckets = dictionary.get(lang, (None, None, None, 0))
            if words is None:
                continue
            at = pc.index_in(block.words, value_set=words)
            here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            at = at.fill_null(0).to_numpy()[here]
            found = len(here) and _dealt(lang, _codes(block), np.stack((here, ids[at], tasks[at]), axis=1), *block.own, buckets)
            if found:
                yield found

    return looked_up


def _unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The fragments of a bucket and their counts."""
    column, parts, counts = np.arange(2 * _REACH + 1), [], []
    for shapes, pivots, ids, many in zip(*(group.column(c).to_pylist() for c in ("shapes", "pivots", "ids", "counts")), strict=True):
        shapes = np.frombuffer(shapes, np.uint8)
        rows = np.full((len(shapes), len(column)), _NONE, dtype=np.uint32)
        inside = (column >= _REACH - (shapes >> 3)[:, None]) & (column <= _REACH + (shapes & 7)[:, None])
        inside[:, _REACH] = False
        rows[inside] = _from_planes(ids)
        rows[:, _REACH] = np.cumsum(_from_planes(pivots), dtype=np.uint32)
        parts.append(rows)
        counts.append(_from_planes(many))
    return np.concatenate(parts), np.concatenate(counts).astype(np.int64)


def _mine(least: int):
    def mine(key: tuple, group: pa.Table) -> pa.Table:
        """The phrases of a bucket that hold the pivot of their fragment; infrequent ones go if no other task counts them."""
        rows, counts = _summed(*_unpacked(group))
        keys, many = [], []
        for n in range(2, LONGEST + 1):
            found = []
            for first in range(_REACH - n + 1, _REACH + 1):
                here = (rows[:, first] != _NONE) & (rows[:, first + n - 1] != _NONE)
                found.append((rows[here, first : first + n], counts[here]))
            phrases, sums = _summed(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
            if key[2].as_py():
                phrases, sums = phrases[sums >= least], sums[sums >= least]
            data = phrases.astype(">u4").tobytes()
            keys.append(pa.Array.from_buffers(pa.binary(), len(phrases), [None, pa.py_buffer(np.arange(0, 4 * n * (len(phrases) + 1), 4 * n, dtype=np.int32)), pa.py_buffer(data)]))
            many.append(sums)
        keys = pa.concat_arrays(keys)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(keys), pa.string()), "key": keys, "a": np.concatenate(many)})

    return mine


def _numbered(frequent: DataFrame) -> DataFrame:
    """``(lang, word, f, id)``: numbers from 0 without gaps, from the most frequent word on."""
    ordered = cut(frequent.orderBy(F.desc("f"), "lang", "word").withColumn("m", F.monotonically_increasing_id()))
    sizes = sorted(map(tuple, ordered.groupBy(F.shiftright("m", 33).alias("part")).count().collect()))
    starts = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    if starts[-1] >= int(_NONE):
        raise ValueError(f"{starts[-1]} words occur often enough; fewer than {int(_NONE)} can be numbered")
    parts = frequent.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "part long, start long")
    # as many rows as the sort has partitions
    numbered = ordered.join(F.broadcast(parts), F.shiftright("m", 33) == F.col("part"))
    return numbered.select("lang", "word", "f", (F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("id"))


def _key(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 8, "0"))


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``docs(lang, text)``: phrases ``(lang, key, a)``, words ``(lang, word, f, id)`` and languages ``(lang, n)``.

    A phrase's key is its words' numbers, of four bytes each.
    """
    named = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    counted = named.mapInArrow(_counts, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counted = cut(counted.where(F.col("word").isNull() | (F.col("f") >= least)))
    langs = counted.where("word is null").select("lang", F.col("f").alias("n"))
    numbered = cut(_numbered(counted.where("word is not null")))
    tasked = numbered.select("lang", "word", "id", F.ceil(F.col("f") / PIVOT_WORDS).alias("tasks"))
    sized = langs.select("lang", F.ceil(F.col("n") / BUCKET_WORDS).cast("int").alias("buckets"))
    size = numbered.agg(F.coalesce(F.sum(F.octet_length("word") + 20), F.lit(0))).first()[0]
    with ExitStack() as tables:
        if size <= DICTIONARY_BYTES:
            fragments = named.mapInArrow(_looked_up(_dictionary(tasked.join(sized, "lang"))), _FRAGMENTS)
        else:
            chunks = tables.enter_context(Written(named.mapInArrow(_chunks, _CHUNKS)))
            known = chunks.select("chunk", "lang", F.posexplode("words").alias("k", "word")).join(tasked, ["lang", "word"])
            known = known.groupBy("chunk").agg(F.collect_list(F.struct("k", "id", "tasks")).alias("known"))
            fragments = chunks.select("chunk", "lang", "codes", "first", "last").join(known, "chunk").join(sized, "lang").mapInArrow(_fragments, _FRAGMENTS)
        mined = fragments.groupBy("lang", "bucket", "whole").applyInArrow(_mine(least), "lang string, key binary, a long")
        phrases = cut(mined.groupBy("lang", "key").agg(F.sum("a").alias("a")).where(F.col("a") >= least))
    return phrases, numbered, langs


def _dictionary(rows: DataFrame) -> dict[str, tuple[pa.Array, np.ndarray, np.ndarray, int]]:
    """The frequent words of each language, of ``DICTIONARY_BYTES`` in all."""
    table = rows.select("lang", "word", "id", "tasks", "buckets").toArrow()
    out = {}
    for lang in table.column("lang").unique().to_pylist():
        own = table.filter(pc.equal(table.column("lang"), lang)).combine_chunks()
        out[lang] = (own.column("word").combine_chunks(), own.column("id").to_numpy(), own.column("tasks").to_numpy(), own.column("buckets")[0].as_py())
    return out


_EXACT = "cast(cast(1000 as decimal(38,0)) * (cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)"


def scored_phrases(phrases: DataFrame, words: DataFrame, langs: DataFrame, percent: int = 100) -> DataFrame:
    """``(lang, key, a, l, r, n, score)`` of the phrases that no longer one of as many percent of their count contains."""
    longer = phrases.where(F.length("key") > 8).select("a", F.explode(F.array(F.expr("substring(key, 1, length(key) - 4)"), F.expr("substring(key, 5)"))).alias("key"))
    longer = longer.groupBy("key").agg(F.max("a").alias("most"))
    kept = phrases.join(longer, "key", "left").where(f"most is null or 100 * most < {percent} * a").drop("most")
    counts = phrases.select("key", "a").unionByName(words.select(_key(F.col("id")).alias("key"), F.col("f").alias("a")))
    cuts = kept.select("lang", "key", "a", F.explode(F.sequence(F.lit(1), F.expr("cast(length(key) / 4 - 1 as int)"))).alias("k"))
    cuts = cuts.select("*", F.expr("substring(key, 1, 4 * k)").alias("left"), F.expr("substring(key, 4 * k + 1)").alias("right")).join(langs, "lang")
    cuts = cuts.join(counts.select(F.col("key").alias("left"), F.col("a").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    lowest = F.min(F.struct(F.expr(_EXACT).alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "key").agg(F.first("a").alias("a"), F.first("n").alias("n"), lowest).select("lang", "key", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` of each language of ``docs(lang, text)``."""
    phrases, words, langs = frequent_phrases(docs, least)
    scored = scored_phrases(phrases, words, langs)
    order = (F.desc("score"), F.desc("a"))
    # the best of parts of a language first; ties stay until their words are known
    dealt = scored.withColumn("part", F.abs(F.xxhash64("key")) % 64)
    best = dealt.withColumn("place", F.rank().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    best = cut(best.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("part", "place"))
    spelt = best.select("key", F.explode(F.sequence(F.lit(0), F.expr("cast(length(key) / 4 - 1 as int)"))).alias("j"))
    spelt = spelt.select("key", "j", F.expr("cast(conv(hex(substring(key, 4 * j + 1, 4)), 16, 10) as long)").alias("id")).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("j", "word"))).alias("ws")).select("key", F.array_join(F.col("ws.word"), " ").alias("phrase"))
    ranked = best.join(spelt, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
