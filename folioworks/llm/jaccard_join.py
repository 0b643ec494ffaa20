"""N-gram Jaccard join by multiple-global-order filtering.

A document's set holds its distinct five-word shingles (words are runs of anything but ASCII white space, A-Z
lower-cased); with fewer words the whole sequence is the one member; without words the set is empty and links with
nothing. Two documents link when ``100 * |A & B| >= 80 * |A | B|``.

If two sets link, then under *any* global order of the shingles they share a member of their prefixes, where the
prefix of a set of n is its first ``n - ceil(0.8 n) + 1`` members. Three orders are used, each led by the number of
documents that have the shingle (rare ones first) and ended by another permutation of the hashes; a pair must share
prefix members under all three before its sets are intersected. Shingles that one document has alone come first in
every order and can't be shared, so a document whose prefix holds only those is done at once: most text ends here.

Steps
1. Equal sets become one node, known by 128 bits summed over the set.
2. The shingles go, packed per chunk of documents and per range of hashes (32 bits each in blobs, not a row each), to
   the task that counts their documents. Those of two documents or more go back to their chunk with that number, and
   a node with too few of them to link is done. What is left is counted once more, each node once, so that copies
   don't make a shingle look shared.
3. Each chunk makes the prefixes of the nodes that can still link; their texts are read again for their sets' whole hashes.
4. Each prefix shingle elects the node with the fewest shingles of its own. Only pairs with an elected node come
   first, as many rows as prefix shingles. Those that share no prefix member under the second and third order are done;
   the sets of the others are intersected; what links into components needs no pairs any more. Only pairs
   of one prefix shingle, in different components, follow, and only if they could share enough: what two nodes share
   inside the elected one is at most the lesser of what either shares with it, and outside at most the lesser of
   their other shared shingles (of a pair that the orders dropped only that it shares too few to link). So a group of near copies hardly costs more rows than it has members, and every link
   between components is still found.
5. Components by alternating stars.

Defined results: null ids keep their row, and are ignored as the least id of a component (null if it has no other);
null texts count as empty; repeated rows are copies of each other; more columns are ignored. An empty table gives no
rows. Columns may have any name. Shingles are compared by 64-bit hashes of their words. Candidates are searched by the leading
32 bits and as many more as number the ranges of hashes, of which there is one for each ``BUCKET_SHINGLES`` shingles of the
documents (2 ** 20 at most); sets that are intersected have all 64 bits, so that a pair never links by the bits left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .components import connected_components
from .stage import cut, small_batches

PERCENT = 80
#: Shingles of all documents that one task counts at a time, of some six bytes each.
BUCKET_SHINGLES, LEAST_BITS, MOST_BITS = 1 << 18, 10, 20
#: Sets of a chunk and their shingles in all, but for the last set's: what a task holds at once.
CHUNK_SETS, CHUNK_SHINGLES = 10_000, 1 << 23
#: Sets smaller than this link with equal ones only.
LEAST_SHARED = -(-PERCENT // (100 - PERCENT))
#: Nodes, of sixteen bytes each, that are sent to all tasks to fetch their whole sets.
SENT_NODES = 1 << 20
_U = np.uint64


def _need(n: np.ndarray) -> np.ndarray:
    """The least number of shared shingles of a set of n with any set that it links with."""
    return -(-n * PERCENT // 100)


def _node(members: np.ndarray) -> bytes:
    n = _U(len(members) * 0x9E37)
    return np.array([S.mix(members, 1).sum() + n, S.mix(members, 2).sum() ^ n], dtype=np.uint64).tobytes()


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, node, n) of (doc_id, text)."""
    for batch in batches:
        nodes, sizes = [], []
        for _, members in S.shingle_sets(batch.column("text"), S.BLANK_WORDS):
            nodes.append(_node(members) if len(members) else None)
            sizes.append(len(members))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "node", "n"])


def _pack(tokens: np.ndarray) -> bytes:
    """The low 32 bits of each."""
    return tokens.astype("<u4").tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u4").astype(np.uint64)


_BLOBS = "bucket int, chunk long, tokens binary, refs binary, counts binary"
_BLOB_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("tokens", pa.binary()), ("refs", pa.binary()), ("counts", pa.binary())])
#: Marks the one row of a chunk that lists its nodes (tokens) and their sizes (refs).
_NODES = b"nodes"


def _pack_refs(refs: np.ndarray) -> bytes:
    """Rising 16-bit numbers by their steps: one byte each, or two where a step is larger."""
    steps = np.diff(refs, prepend=np.uint16(0))
    return steps.astype(np.uint8).tobytes() if steps.max(initial=0) < 256 else refs.tobytes()


def _unpack_refs(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint16) if len(blob) == 2 * n else np.cumsum(np.frombuffer(blob, np.uint8), dtype=np.uint16)


def _texts(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """(node, size, the leading ``bits + 32`` bits of the shingles' hashes) of texts."""
    for _, members in S.shingle_sets(batch.column("text"), S.BLANK_WORDS):
        if len(members):
            yield _node(members), len(members), members >> _U(32 - bits)


def _members(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """The same of nodes."""
    for node, n, members in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("members"), strict=True):
        yield node, n, members.values.to_numpy().astype(np.uint64)


def _scatter(bits: int, sets):
    """Chunks of sets to packed shingles by bucket, their leading ``bits``."""

    def packed(kept: dict[bytes, tuple[int, np.ndarray]], serial: int) -> pa.RecordBatch:
        tokens = np.concatenate([x for _, x in kept.values()])
        refs = np.repeat(np.arange(len(kept), dtype=np.uint16), [len(x) for _, x in kept.values()])
        bucket = (tokens >> _U(32)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        tokens, refs, bucket = tokens[order], refs[order], bucket[order]
        held, first = np.unique(bucket, return_index=True)
        spans = zip(held.tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True)
        rows = [(serial % (1 << bits), serial, b"".join(kept), np.array([n for n, _ in kept.values()], np.uint32).tobytes(), _NODES)]
        rows += [(b, serial, _pack(tokens[i:j]), _pack_refs(refs[i:j]), None) for b, i, j in spans]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _BLOB_SCHEMA, strict=True)], schema=_BLOB_SCHEMA)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, size = TaskContext.get().partitionId() << 24, 0
        kept: dict[bytes, tuple[int, np.ndarray]] = {}
        # a chunk is no batch: batches are small, and each chunk costs a row in every bucket
        for batch in batches:
            for node, n, tokens in sets(batch, bits):
                if node in kept:
                    continue
                kept[node] = n, tokens
                size += len(tokens)
                if len(kept) == CHUNK_SETS or size >= CHUNK_SHINGLES:
                    serial += 1
                    yield packed(kept, serial)
                    kept, size = {}, 0
        if kept:
            yield packed(kept, serial + 1)

    return scatter


def _spread(group: pa.Table) -> pa.Table:
    """One bucket: the shingles that several documents have, back by chunk."""
    return _several(group, False)


def _count(group: pa.Table) -> pa.Table:
    """The same, with the number of documents."""
    return _several(group, True)


def _several(group: pa.Table, numbers: bool) -> pa.Table:
    rows = list(zip(*(group.column(c).to_pylist() for c in ("bucket", "chunk", "tokens", "refs", "counts")), strict=True))
    out = [r for r in rows if r[4] is not None]
    rows = [r for r in rows if r[4] is None]
    if rows:
        packed = [_unpack(r[2]) for r in rows]
        at = np.cumsum([0, *map(len, packed)])
        tokens = np.concatenate(packed)
        order = np.argsort(tokens)
        tokens = tokens[order]
        new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
        first = np.flatnonzero(new)
        each = np.diff(np.append(first, len(tokens)))
        counts = np.empty(len(tokens), dtype=np.uint32)
        counts[order] = np.repeat(each, each)
        for r, own, i, j in zip(rows, packed, at[:-1], at[1:], strict=True):
            several = counts[i:j] > 1
            if several.any():
                out.append((r[0], r[1], _pack(own[several]), _pack_refs(_unpack_refs(r[3], len(own))[several]), counts[i:j][several].tobytes() if numbers else b""))
    return pa.Table.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_BLOB_SCHEMA)], schema=_BLOB_SCHEMA)


_SETS = "node binary, n int, members array<long>"
_PREFIXES = "node binary, n int, m int, members array<long>, first array<long>, second array<long>, third array<long>"
_LONGS = pa.list_(pa.int64())
_SET_SCHEMA = pa.schema([("node", pa.binary()), ("n", pa.int32()), ("members", _LONGS)])
_PREFIX_SCHEMA = pa.schema([("node", pa.binary()), ("n", pa.int32()), ("m", pa.int32()), *((c, _LONGS) for c in ("members", "first", "second", "third"))])


def _possible(group: pa.Table) -> Iterator[tuple[bytes, int, np.ndarray, np.ndarray]]:
    """(node, size, shared shingles, their counts) of the nodes of a chunk that can still link."""
    nodes, sizes, parts = b"", np.zeros(0, np.int64), []
    for bucket, tokens, refs, counts in zip(*(group.column(c).to_pylist() for c in ("bucket", "tokens", "refs", "counts")), strict=True):
        if counts == _NODES:
            nodes, sizes = tokens, np.frombuffer(refs, np.uint32).astype(np.int64)
        else:
            own = _unpack(tokens)
            parts.append((own | _U(bucket << 32), _unpack_refs(refs, len(own)), np.frombuffer(counts, np.uint32) if counts else np.zeros(len(own), np.uint32)))
    if not parts:
        return
    tokens, refs, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(refs, kind="stable")
    tokens, refs, counts = tokens[order], refs[order], counts[order]
    at = np.searchsorted(refs, np.arange(len(sizes) + 1))
    for i in np.flatnonzero((np.diff(at) >= _need(sizes)) & (sizes >= LEAST_SHARED)):
        yield nodes[16 * i : 16 * i + 16], int(sizes[i]), tokens[at[i] : at[i + 1]], counts[at[i] : at[i + 1]]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _shared(group: pa.Table) -> pa.Table:
    return _table([(node, n, own.astype(np.int64)) for node, n, own, _ in _possible(group)], _SET_SCHEMA)


def _prefixes(group: pa.Table) -> pa.Table:
    out: list[tuple] = []
    for node, n, own, many in _possible(group):
        length = len(own) - int(_need(np.int64(n))) + 1
        rough = np.log2(many).astype(np.int64)
        orders = (np.lexsort((own, many)), np.lexsort((S.mix(own, 11), rough)), np.lexsort((S.mix(own, 12), rough // 2)))
        out.append((node, n, len(own), np.sort(own).astype(np.int64), *(own[o[:length]].astype(np.int64) for o in orders)))
    return _table(out, _PREFIX_SCHEMA)


def _whole(wanted: frozenset[bytes] | None):
    """(node, all its 64-bit hashes) of texts, of the wanted nodes or all; each node once a task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for _, members in S.shingle_sets(batch.column("text"), S.BLANK_WORDS):
                if len(members) >= LEAST_SHARED:
                    node = _node(members)
                    if node not in seen and (wanted is None or node in wanted):
                        seen.add(node)
                        rows.append((node, members.tobytes()))
                if len(seen) > SENT_NODES:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["node", "whole"])

    return whole


def _exact(bits: int):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The 64-bit hashes in place of the leading bits of those shingles that several nodes have."""
        for batch in batches:
            members = []
            for held, blob in zip(batch.column("members"), batch.column("whole").to_pylist(), strict=True):
                own = np.frombuffer(blob, np.uint64)
                members.append(own[np.isin(own >> _U(32 - bits), held.values.to_numpy().view(np.uint64))].view(np.int64))
            columns = [pa.array(members, _LONGS) if f.name == "members" else batch.column(f.name) for f in _PREFIX_SCHEMA]
            yield pa.RecordBatch.from_arrays(columns, _PREFIX_SCHEMA.names)

    return exact


def shingle_nodes(docs: DataFrame) -> DataFrame:
    """``(doc_id, node, n)`` of every row: the set's identity (null if empty) and size."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_sets_of, f"doc_id {kind}, node binary, n long")


def candidate_nodes(docs: DataFrame, shingles: int) -> DataFrame:
    """The nodes that can link with another one, once each, with their prefixes under the three orders.

    ``shingles`` is the number of shingles of all documents.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (shingles // BUCKET_SHINGLES).bit_length()))
    blobs = docs.select(F.col("text").cast("string")).mapInArrow(_scatter(bits, _texts), _BLOBS)
    shared = blobs.groupBy("bucket").applyInArrow(_spread, _BLOBS)
    with small_batches(docs.sparkSession):
        sets = cut(shared.groupBy("chunk").applyInArrow(_shared, _SETS).dropDuplicates(["node"]))
        again = sets.mapInArrow(_scatter(bits, _members), _BLOBS).groupBy("bucket").applyInArrow(_count, _BLOBS)
        nodes = cut(again.groupBy("chunk").applyInArrow(_prefixes, _PREFIXES))
    # links are decided by whole hashes, which only the nodes that can still link need
    ids = nodes.select("node")
    few = frozenset(bytes(x.node) for x in ids.collect()) if nodes.count() <= SENT_NODES else None
    whole = docs.select(F.col("text").cast("string")).mapInArrow(_whole(few), "node binary, whole binary")
    if few is None:
        whole = whole.join(ids, "node", "left_semi")
    whole = whole.groupBy("node").agg(F.first("whole").alias("whole"))
    with small_batches(docs.sparkSession):
        return cut(nodes.join(whole, "node").mapInArrow(_exact(bits), _PREFIXES))


#: I >= 80 % of (na + nb - I)
_ENOUGH = f"{100 + PERCENT} * {{shared}} >= {PERCENT} * (n_a + n_b)"


_FILTERED = "arrays_overlap(second_a, second_b) and arrays_overlap(third_a, third_b)"


def _compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) with whether they link, and the most shingles that they share: exact if the filters let them be compared.

    To link, they must share prefix shingles under the other orders too; only then their sets are intersected.
    """
    side = lambda x: nodes.select(*(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "members", "second", "third")))
    both = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
    both = both.withColumn("shared", F.when(F.expr(_FILTERED), F.size(F.array_intersect("members_a", "members_b"))))
    links = F.coalesce(F.expr(_ENOUGH.format(shared="shared")), F.lit(False))
    return both.select("a", "b", "shared", F.expr(f"cast(ceil({PERCENT} * (n_a + n_b) / {100 + PERCENT}.0) - 1 as int)").alias("too_few"), links.alias("links"))


def _linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that link: all filters come before the sets are compared."""
    side = lambda x: nodes.select(*(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "members", "second", "third")))
    both = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
    both = both.where(_FILTERED)
    return both.where(_ENOUGH.format(shared="size(array_intersect(members_a, members_b))")).select("a", "b")


def node_links(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Links that span the components of the nodes, as ``(a, b)``, and the components of those nodes."""
    posts = cut(nodes.select("node", "n", "m", F.explode("first").alias("token")))
    best = F.min(F.struct(F.expr("n - m").alias("alone"), F.expr("-m").alias("least"), "node"))
    elected = posts.groupBy("token").agg(best.alias("e"), F.count("*").alias("many")).where("many > 1").select("token", F.col("e.node").alias("centre"))
    near = posts.select("node", "token").join(elected, "token").where("node <> centre")
    near = cut(_compared(near.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), nodes))
    links = near.where("links").select("a", "b")
    parts = cut(connected_components(links, "a", "b"))
    placed = posts.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    placed = placed.join(mixed, "token", "left_semi").join(elected, "token")
    seen = near.select(F.col("a").alias("node"), F.col("b").alias("centre"), "shared", "too_few")
    placed = placed.join(seen, ["node", "centre"], "left")
    own = F.col("node") == F.col("centre")
    placed = placed.withColumn("inside", F.when(own, F.col("m")).otherwise(F.coalesce("shared", F.least("m", "too_few"))))
    placed = placed.withColumn("outside", F.when(own | F.col("shared").isNotNull(), F.col("m") - F.col("inside")).otherwise(F.col("m")))
    placed = cut(placed.select("token", "node", "n", "root", "inside", "outside").join(nodes.select("node", "first"), "node"))
    side = lambda x: placed.select(*(F.col(c).alias(f"{c}_{x}") for c in placed.columns))
    could = _ENOUGH.format(shared="(least(inside_a, inside_b) + least(outside_a, outside_b))")
    # a pair counts once, at the least shingle that its prefixes share
    once = "token_a = array_min(array_intersect(first_a, first_b))"
    rest = side("a").join(side("b"), (F.col("token_a") == F.col("token_b")) & F.expr(f"node_a < node_b and root_a <> root_b and {could} and {once}"))
    more = cut(_linked(rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), nodes))
    if more.isEmpty():
        return links, parts
    links = links.unionByName(more)
    return links, connected_components(links, "a", "b")


def _total(rows: DataFrame) -> int:
    return rows.agg(F.sum("n")).first()[0] or 0


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs(doc_id, text)``; see the module for every case."""
    with small_batches(docs.sparkSession):
        rows = cut(shingle_nodes(docs))
    _, parts = node_links(candidate_nodes(docs, _total(rows)))
    placed = rows.join(parts.withColumnRenamed("node", "part_node"), F.col("node") == F.col("part_node"), "left").withColumn("root", F.coalesce("root", "node"))
    placed = cut(placed.select("doc_id", "n", "root"))
    least = cut(placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).where("many > 1").select(F.col("root").alias("least_root"), "least"))
    # a component of null ids only has no least id; its rows keep null
    out = placed.join(least, F.col("root") == F.col("least_root"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that stand for their component: one row of its least id.

    A component is one of texts: rows that share an id but no component each stand for their own. Rows without shingles
    and rows with a null id stay, the latter as nothing names them.
    """
    digest = F.md5(F.col("text").cast("binary"))
    # a row is named by its id and its text
    named = docs.select(F.struct("doc_id", digest.alias("digest")).alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        found = cut(shingle_nodes(named).select("doc_id.*", "node", "n"))
    rows = cut(found.where("doc_id is not null and node is not null").drop("n").distinct())
    _, parts = node_links(candidate_nodes(docs.select("text"), _total(found)))
    placed = rows.join(parts.withColumnRenamed("node", "part_node"), F.col("node") == F.col("part_node"), "left").withColumn("root", F.coalesce("root", "node"))
    stands = placed.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    stands = cut(stands.select(F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest")))
    # each name once among equal rows; names without shingles stand in no component
    known = rows.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.lit(True).alias("__known"))
    kept = cut(known.join(stands.withColumn("__kept", F.lit(True)), ["__id", "__digest"], "left").select("__id", "__digest", F.col("__kept").isNotNull().alias("__kept")))
    both = docs.withColumn("__text", digest).join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__digest")), "left")
    one = Window.partitionBy("doc_id", "__text").orderBy(F.lit(1))
    standing = both.where("__kept").withColumn("__row", F.row_number().over(one)).where("__row = 1")
    return standing.select(*docs.columns).unionByName(both.where("__kept is null").select(*docs.columns))
