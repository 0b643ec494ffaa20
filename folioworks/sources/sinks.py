"""Writers: JSON lines, ledgers, artefact tables and resumable appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """[K1][K2] One object a line, nulls kept, no ASCII escapes."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_run(rows: DataFrame, path: str, run: str) -> None:
    """[K3] A run's rows in a partition of their own: writing it again replaces it, other runs stay."""
    rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def write_artefacts(tables: dict[str, DataFrame], folder: str, partition: str | None = None) -> None:
    """[K4] One table per kind of artefact."""
    for name, rows in tables.items():
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(f"{folder}/{name}")


def ascii_bytes(text: Column) -> Column:
    """[K5] Text as bytes, what isn't ASCII replaced."""
    return F.encode(F.regexp_replace(text, r"[^\x00-\x7F]", "?"), "US-ASCII")


def discard(rows: DataFrame) -> None:
    """[K5] Computes everything and keeps nothing."""
    rows.write.format("noop").mode("overwrite").save()
