"""The thin queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .decontaminate import find_leaks
from .embeddings import near_embeddings
from .jaccard_join import near_duplicates
from .language import language_of
from .language_model import score_texts
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .pii import TAGS, find_personal_data
from .spelling import group_spellings
from .stage import held_out, table
from .tagger import Tagger
from .toxicity import score_toxicity
from .urls import RULES, judge_urls


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), "host string, path string, verdict string"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents")).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


# What SQL can say of operators whose queries hold more than it can.


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("first_word", "last_word")), "base_labels")


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans alone: a tagger without training adds what it likes, which these columns leave out."""
    return find_personal_data(table(spark, sf_dir, "documents"), Tagger(TAGS)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def base_word_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word model alone, beside a network that sees no windows."""
    scored = score_texts(table(spark, sf_dir, "documents"), sample=0)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_decontamination, op3_licenses, op4_urls, op5_language, op6_personal_data, op7_embeddings, op8_jaccard_join, op9_mixing, op10_line_dedup, op11_collocations, op12_language_model, op13_spelling, base_licenses, base_personal_data, base_word_model)
}
