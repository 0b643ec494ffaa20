"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are looked for inside whole documents. Words are runs of ASCII letters, digits and anything beyond
ASCII, A-Z lower-cased; an item's set holds its distinct five-word shingles (with fewer words, the whole sequence as
one, and documents are then read in sequences of that length). A document leaks an item when it has at least 80 % of
the item's set.

Items are partitioned by the size of their sets, in powers of two; a partition of sets of n members and more asks for
``t = n / 8`` matches (one at least). An item's MinHash signature is its ``m - ceil(0.8 m) + t`` least hashes under one
order of all shingles, m being its own size. A document with 80 % of the set can miss at most ``m - ceil(0.8 m)``
members, so it has t of the signature: nothing is missed, whatever the document's length, which a signature of the long
document could not promise, and larger items are compared with fewer documents. Documents are streamed past the
signatures (a bit table first, a sorted search next); documents that have t of one are candidates, and their words and
the item's decide, shingle by shingle.

The items are hashed on the executors and go out in blocks of at most ``BLOCK_SHINGLES`` shingles (one longer item is a
block of its own, so the longest item must fit in memory); equal items are one entry. More items mean more blocks and
more passes over the documents. Documents are never shuffled.

Defined results: null and empty texts and items leak nothing; null ids are passed on; repeated items and documents
each give their rows; an item that stands in a document any number of times is one leak; empty tables give no rows; more
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S

PERCENT = 80
#: Shingles of items that go to the executors at once: 8 bytes each, and as many bytes again for the bit table.
BLOCK_SHINGLES = 2_000_000
_BITS = 22
_U = np.uint64
_SPACED = bytes(S.LOWER[c] if S.PLAIN_WORDS[c] else 32 for c in range(256))


def _strings(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


class Block:
    """Items, as (ids, width of shingles in words, sorted hashes of the set, words), with their signatures by partition."""

    def __init__(self, items: list[tuple[list, int, np.ndarray, bytes]]):
        self.items = items
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.asked = np.array([max(1, (1 << (len(members).bit_length() - 1)) // 8) for _, _, members, _ in items])
        marks = defaultdict(list)
        for k, (_, width, members, _) in enumerate(items):
            n = len(members)
            own = members[np.argsort(S.mix(members, 5))][: n - -(-n * PERCENT // 100) + int(self.asked[k])]
            marks[width].append((own, np.full(len(own), k)))
        for width, pairs in marks.items():
            mark, owner = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(mark, kind="stable")
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[(mark >> _U(64 - _BITS)).astype(np.int64)] = True
            self.tables[width] = (mark[order], owner[order], bits)

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) of consecutive texts that hold as many members of a signature as its partition asks for."""
        words, counts = S.word_hashes(data, offsets, S.PLAIN_WORDS)
        for width, (mark, owner, bits) in self.tables.items():
            hashed, many = S.shingle_hashes(words, counts, width) if width == S.WORDS else _sequences(words, counts, width)
            hits = np.flatnonzero(bits[(hashed >> _U(64 - _BITS)).astype(np.int64)])
            if not len(hits):
                continue
            # each document's distinct members of signatures
            doc = np.searchsorted(np.cumsum(many), hits, "right")
            order = np.lexsort((hashed[hits], doc))
            doc, found = doc[order], hashed[hits][order]
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])))
            doc, found = doc[new], found[new]
            lo, hi = np.searchsorted(mark, found, "left"), np.searchsorted(mark, found, "right")
            each = hi - lo
            place = np.repeat(lo - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
            pairs, seen = np.unique(np.repeat(doc, each) * len(self.items) + owner[place], return_counts=True)
            enough = pairs[seen >= self.asked[pairs % len(self.items)]]
            yield from zip((enough // len(self.items)).tolist(), (enough % len(self.items)).tolist(), strict=True)

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, shared shingles, shingles of the item) for each leak of consecutive texts."""
        of, words, strings = -1, [], {}
        for d, k in sorted(self.candidates(data, offsets)):
            if d != of:
                of, strings = d, {}
                words = data[int(offsets[d]) : int(offsets[d + 1])].tobytes().translate(_SPACED).split()
            _, width, _, own = self.items[k]
            if width not in strings:
                strings[width] = _strings(words, width)
            item = _strings(own.split(), width)
            shared = len(item & strings[width])
            if 100 * shared >= PERCENT * len(item):
                yield d, k, shared, len(item)


def _sequences(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All sequences of a width below five, as items of that many words are hashed."""
    first = np.concatenate(([0], np.cumsum(counts)))
    many = np.maximum(counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), many)
    at = first[:-1][text] + np.arange(len(text)) - np.concatenate(([0], np.cumsum(many)))[:-1][text]
    out = S.shingle_hashes(words[(at[:, None] + np.arange(width)).reshape(-1)], np.full(len(at), width), S.WORDS)[0] if len(at) else np.zeros(0, np.uint64)
    return out, many


def _hash_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, width, members, words) of (item_id, text)."""
    for batch in batches:
        data, offsets = S.utf8(batch.column("text"))
        words = [b" ".join(data[a:b].tobytes().translate(_SPACED).split()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        members = [m.tobytes() for _, m in S.shingle_sets(batch.column("text"), S.PLAIN_WORDS)]
        width = [min(w.count(b" ") + 1, S.WORDS) for w in words]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(width, pa.int32()), pa.array(members, pa.binary()), pa.array(words, pa.binary())], ["item_id", "width", "members", "words"])


def _blocks(items: DataFrame, block_shingles: int) -> Iterator[Block]:
    """Items in blocks of a bounded number of shingles; one longer item is a block of its own."""
    kind = items.schema["item_id"].dataType.simpleString()
    held: dict[bytes, tuple[list, int, np.ndarray, bytes]] = {}
    size = 0
    for row in items.mapInArrow(_hash_items, f"item_id {kind}, width int, members binary, words binary").where("length(members) > 0").toLocalIterator():
        words = bytes(row["words"])
        members = np.frombuffer(bytes(row["members"]), np.uint64)
        if words in held:
            held[words][0].append(row["item_id"])
            continue
        if held and size + len(members) > block_shingles:
            yield Block(list(held.values()))
            held, size = {}, 0
        held[words] = ([row["item_id"]], row["width"], members, words)
        size += len(members)
    if held:
        yield Block(list(held.values()))


def _search(spark, block: Block, doc_type: pa.DataType, item_type: pa.DataType):
    shared = spark.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            data, offsets = S.utf8(batch.column("text"))
            rows = [(a + d, i, n, m) for a, b in S.runs(offsets) for d, k, n, m in block.leaks(data, offsets[a : b + 1]) for i in block.items[k][0]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], item_type),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                ],
                ["doc_id", "item_id", "n_shared", "n_item"],
            )

    return search


def find_leaks(docs: DataFrame, items: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)`` for each leak of ``items(item_id, text)`` in ``docs(doc_id, text)``."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    docs, items = docs.select("doc_id", F.col("text").cast("string")), items.select("item_id", F.col("text").cast("string"))
    doc_kind, item_kind = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, n_shared long, n_item long"
    found = [docs.mapInArrow(_search(spark, block, to_arrow_type(doc_kind), to_arrow_type(item_kind)), schema) for block in _blocks(items, block_shingles)]
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    return out.withColumn("containment", F.col("n_shared").cast("double") / F.col("n_item"))
