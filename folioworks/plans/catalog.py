"""All queries over the reference-shaped operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import auditing, chains, files, grading, itemwork, layouts, pages, queueing, references, retrieval, rules, statistics

MODULES = (grading, statistics, retrieval, references, chains, auditing, queueing, pages, layouts, itemwork, rules, files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
