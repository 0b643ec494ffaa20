"""A stored inverted index for lexical retrieval: written once, asked often, read only where a hit can be among the best.

The index is a folder of Parquet tables.

* ``postings``: a row for each word of a *block* of ``BLOCK_DOCS`` documents, with the documents, how often they have it and
  how long they are, the greatest count and the least length. Rows lie in ``bucket`` folders by word, sorted by word, so that
  few of them are opened for the words of a query.
* ``terms``: the words with the number of documents that have them.
* ``stats``: one row: documents, their mean length, the mean raw idf of all words, and whether ids repeat.

A search bounds what each block can add to a query: a document's part grows with its count and falls with its length, so the
block's greatest count and least length bound it. The blocks of highest bound are scored first; of the others only those whose
bound reaches the k-th score found are read (block-max pruning), and no result is lost. Where ids repeat, scores of several
blocks add up, and all blocks are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.model_calls import settled
from .retrieve import tokens

#: Documents of a block, folders of words, blocks of a query that are scored before any is left out.
BLOCK_DOCS, BUCKETS, FIRST_BLOCKS = 64, 32, 2
#: Bytes of the queries and their words that are sent to all executors.
SENT_BYTES = 1 << 24
#: Parts that a bucket is written in, at least, and bytes of texts whose words make a part: sorting one never needs the disk.
SPREAD, PART_BYTES = 4, 1 << 22
_POSTINGS = "term string, block long, docs array<{kind}>, counts array<int>, lengths array<int>, most long, least long"
#: What rounding and the order of sums may add to a score.
SLACK = 2e-6


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents to rows of words; a row without a word counts the block's documents and words."""
    serial = TaskContext.get().partitionId() << 32
    for batch in batches:
        # documents of like length share a block, so that its least length bounds them well
        batch = batch.take(pc.sort_indices(pc.fill_null(pc.utf8_length(batch.column("text")), 0)))
        for start in range(0, batch.num_rows, BLOCK_DOCS):
            part = batch.slice(start, BLOCK_DOCS)
            serial += 1
            words: dict[str, tuple[list[int], list[int]]] = {}
            lengths, some = [], 0
            for i, text in enumerate(part.column("text").to_pylist()):
                ws = (text or "").lower().split()
                lengths.append(len(ws))
                some += bool(text)
                for w, n in Counter(ws).items():
                    held = words.setdefault(w, ([], []))
                    held[0].append(i)
                    held[1].append(n)
            at = [i for held, _ in words.values() for i in held]
            sizes = [len(held) for held, _ in words.values()]
            offsets = pa.array([0, *accumulate(sizes), sum(sizes)], pa.int32())
            lists = lambda x, last: pa.ListArray.from_arrays(offsets, x.take(pa.array(at, pa.int64())) if last else x)
            counts = pa.array([n for _, ns in words.values() for n in ns], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*words, None], pa.string()), pa.array([serial] * (len(words) + 1), pa.int64()), lists(part.column("doc"), True), lists(counts, False), lists(pa.array(lengths, pa.int32()), True),
                    pa.array([*(max(ns) for _, ns in words.values()), some], pa.int64()), pa.array([*(min(lengths[i] for i in held) for held, _ in words.values()), sum(lengths)], pa.int64()),
                ],
                ["term", "block", "docs", "counts", "lengths", "most", "least"],
            )


@dataclass(frozen=True)
class Index:
    """An index that stands in a folder."""

    postings: DataFrame
    terms: DataFrame
    documents: int
    mean_length: float
    mean_raw: float
    repeats: bool

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Index:
        held = spark.read.parquet(f"{folder}/stats").first()
        return Index(_postings(spark, folder, held.kind), spark.read.parquet(f"{folder}/terms"), held.documents or 0, held.mean_length or 0.0, held.mean_raw or 0.0, held.repeats)


def _postings(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(f"{_POSTINGS.format(kind=kind)}, bucket int").parquet(f"{folder}/postings")


def _raw(documents: Column) -> Column:
    return F.log(documents - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def write_index(docs: DataFrame, doc: str, folder: str, text: str = "text", buckets: int = BUCKETS) -> Index:
    """[R1b][R2] Writes the index of ``docs`` and loads it.

    Words are what stands between white space of any kind, lower-cased. Documents without text aren't in it. Ids may be of
    any type; scores of rows of one id add up. An empty table gives an empty index.
    """
    spark, kind = docs.sparkSession, docs.select(doc).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(_posted, _POSTINGS.format(kind=kind))
    # a block's own row, without a word, has a bucket of its own; a frequent word's rows are dealt by block
    bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.hash("term"), F.lit(buckets)))
    ids = docs.where(F.coalesce(F.col(text), F.lit("")) != "").groupBy(doc).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes")).agg(F.max("n").alias("most"), F.sum("bytes").alias("bytes")).first()
    spread = -(-(ids.bytes or 0) // (buckets * PART_BYTES))
    keys = F.col("bucket"), F.pmod(F.xxhash64("block"), F.lit(max(spread, SPREAD)))
    rows = rows.withColumn("bucket", bucket)
    rows = (rows.repartition(buckets * spread, *keys) if spread > SPREAD else rows.repartition(*keys)).sortWithinPartitions("bucket", "term", "block")
    rows.write.partitionBy("bucket").parquet(f"{folder}/postings")
    postings = _postings(spark, folder, kind)
    count = postings.where("bucket = -1").agg(F.coalesce(F.sum("most"), F.lit(0)).alias("documents"), (F.sum("least") / F.sum("most")).alias("mean_length")).first()
    terms = postings.where("bucket >= 0").groupBy("term", "bucket").agg(F.sum(F.size("docs")).alias("df"))
    terms.write.parquet(f"{folder}/terms")
    mean = spark.read.parquet(f"{folder}/terms").agg(F.avg(_raw(F.lit(count.documents))).alias("mean_raw"))
    mean.select(F.lit(kind).alias("kind"), F.lit(count.documents).cast("long").alias("documents"), F.lit(count.mean_length).cast("double").alias("mean_length"), "mean_raw", F.lit((ids.most or 0) > 1).alias("repeats")).write.parquet(f"{folder}/stats")
    return Index.load(spark, folder)


def _weights(index: Index, queries: DataFrame, query: str, text: str, epsilon: float) -> DataFrame:
    """``(query, term, bucket, w)``: the words of each query that the index has; repeated ones count each time."""
    asked = queries.select(F.col(query).alias("query"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    raw = _raw(F.lit(index.documents))
    idf = F.when(raw < 0, epsilon * F.lit(index.mean_raw)).otherwise(raw)
    return asked.join(index.terms, "term").select("query", "term", "bucket", (F.col("times") * idf).alias("w"))


@dataclass(frozen=True)
class Found:
    """The best documents ``(query, doc, score)``, and for each query how many ``blocks`` hold words of it and how many were ``scored``."""

    best: DataFrame
    blocks: DataFrame


def search(index: Index, queries: DataFrame, query: str, k: int, text: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, digits: int = 6) -> Found:
    """[R2][R3] The ``k`` best documents with a word of the query, by the score to so many ``digits``; ties by document.

    Okapi scores; words that are in more than half of the documents weigh ``epsilon`` times the mean raw idf. A row comes for each
    query word and block at most, and postings are opened for the blocks that can reach the best.
    """
    part = lambda count, length: count * (k1 + 1) / (count + k1 * (1 - b + b * length / index.mean_length))
    asked = settled(_weights(index, queries, query, text, epsilon))
    few = (asked.agg(F.sum(F.octet_length("term") + F.octet_length(F.col("query").cast("string")) + 48)).first()[0] or 0) <= SENT_BYTES
    sent = F.broadcast if few else lambda rows: rows
    held = index.postings.where("bucket >= 0").join(sent(asked.select("term", "bucket").distinct()), ["bucket", "term"], "left_semi").drop("bucket")
    asked = asked.drop("bucket")
    limit = F.greatest(F.lit(0.0), F.col("w") * part(F.col("most"), F.col("least")))
    bounds = settled(held.select("term", "block", "most", "least").join(sent(asked), "term").groupBy("query", "block").agg(F.sum(limit).alias("bound")))
    held = held.drop("most", "least")

    def summed(rows: DataFrame) -> DataFrame:
        rows = rows.select("query", "block", "w", F.posexplode("docs").alias("i", "doc"), "counts", "lengths")
        one = F.col("w") * part(F.get("counts", F.col("i")), F.get("lengths", F.col("i")))
        return rows.groupBy("query", "block", "doc").agg(F.sum(one).alias("score"))

    def by_block(pairs: DataFrame) -> DataFrame:
        """Postings move once, by block: they meet the queries that want the block, and sums need no other shuffle."""
        wanted = pairs.groupBy("block").agg(F.collect_list("query").alias("askers"))
        return summed(held.join(wanted.hint("shuffle_hash"), "block").join(sent(asked), "term").where(F.array_contains("askers", F.col("query"))))

    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    top = lambda rows: rows.select("query", "doc", F.round("score", digits).alias("score")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    if index.repeats:
        both = top(by_block(bounds.select("query", "block")).groupBy("query", "doc").agg(F.sum("score").alias("score")))
        return Found(both.select("query", "doc", "score"), bounds.groupBy("query").agg(F.count("*").alias("blocks"), F.count("*").alias("scored")))
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    first = settled(bounds.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= FIRST_BLOCKS).select("query", "block"))
    early = settled(top(summed(held.join(sent(first.join(asked, "query")), ["term", "block"]))))
    reached = early.where(F.col("place") == k).select("query", F.col("score").alias("reached"))
    within = lambda value: F.col("reached").isNull() | (F.col(value) + SLACK >= F.col("reached"))
    rest = bounds.join(first.withColumn("done", F.lit(True)), ["query", "block"], "left").join(sent(reached), "query", "left")
    rest = settled(rest.select("query", "block", (F.col("done").isNull() & within("bound")).alias("more"), F.col("done").isNotNull().alias("done")))
    # what can't be among the best is left where it was summed
    late = by_block(rest.where("more").select("query", "block")).join(sent(reached), "query", "left").where(within("score"))
    both = top(early.select("query", "doc", "score").unionByName(late.select("query", "doc", "score"))).select("query", "doc", "score")
    return Found(both, rest.groupBy("query").agg(F.count("*").alias("blocks"), F.count_if(F.col("more") | F.col("done")).alias("scored")))
