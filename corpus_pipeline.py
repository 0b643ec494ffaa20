"""A cleaning pipeline over ``documents``: language, repeated passages, near duplicates, benchmark leaks, mixing.

Each stage takes what its predecessor kept and, but for the last, returns the columns of ``documents``, further columns
and their names as they are. A stage that changes a text also sets ``n_chars``. The last emits each document as often as
the mix takes it.

Defined results, of every stage: an empty table gives an empty table; null texts and empty ones go in the first stage;
rows with a null id are documents of their own; rows of one id are told apart by their texts, and equal rows fare alike,
but for near duplicates, of which one row stays, and copies in the mix, which are dealt by row; runs agree on all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm.decontaminate import find_leaks
from folioworks.llm.jaccard_join import representatives
from folioworks.llm.language import keep_identified
from folioworks.llm.line_dedup import dedup_lines
from folioworks.llm.mixing import mix_sources
from folioworks.llm.stage import cut, small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cross-parsing rejects go: no text, no letters, or nothing like text of a learned language. A null
    ``lang`` is filled with the language that needs the fewest phrases."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repetitions of runs of lines go; so do documents of which nothing is left."""
    cleaned = dedup_lines(docs, removed="__removed")
    changed = F.col("__removed") > 0
    cleaned = cleaned.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least id."""
    return representatives(docs)


#: Leaking documents, of some thirty bytes each, that are sent to all executors.
BROADCAST_IDS = 500_000


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; the others don't move unless more than ``BROADCAST_IDS`` leak."""
    digest = F.xxhash64("text")
    named = docs.select(F.struct("doc_id", digest.alias("digest")).alias("doc_id"), "text")
    with small_batches(spark):
        leaks = cut(find_leaks(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.digest").alias("__digest")).distinct())
    few = leaks.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(leaks) if few else leaks, F.col("doc_id").eqNullSafe(F.col("__id")) & (digest == F.col("__digest")), "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered by ``copy``, with its size and its source's size and target.

    A document's own columns keep their values: of the new ones only those are added whose name it doesn't have.
    """
    mixed = mix_sources(docs, whole=True).where("copies > 0")
    own = [c for c in ("copy", "size", "source_size", "target", "taken") if c not in docs.columns]
    mixed = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select(*(F.col("document")[c].alias(c) for c in docs.columns), *own)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard_join", ngram_jaccard_join), ("benchmark_decontamination", benchmark_decontamination), ("mixing", mixing)]
#: SQL can't express the cross-parsing of the first stage; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
