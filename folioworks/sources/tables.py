"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order and line number, which the raw table repeats; an order's rows stand together, so that grouping them
    by order moves nothing more."""
    rest = ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    kept = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *rest).repartition("l_orderkey")
    return kept.groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in rest))
