"""A task table as batch folds: what is next, guarded transitions, stale resets, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enqueue(files: DataFrame, name: str, path: str, now: Column, priority: int = 0) -> DataFrame:
    """[Q1] New pending tasks; ids follow from the path and time, so that a retried job adds none twice."""
    key = F.sha2(F.concat_ws("|", path, now.cast("string")), 256)
    return files.select(F.left(key, F.lit(32)).alias("task_id"), F.col(name).alias("file_name"), F.col(path).alias("file_path"), F.lit("pending").alias("status"), F.lit(priority).alias("priority"), now.alias("created_at"), F.lit(0).alias("retry_count"))


def next_tasks(tasks: DataFrame, n: int = 1) -> DataFrame:
    """[Q2] The pending tasks of highest priority, oldest first. Claiming one atomically is a transaction elsewhere."""
    return tasks.where("status = 'pending'").orderBy(F.col("priority").desc(), "created_at", "task_id").limit(n)


def fold_transitions(events: DataFrame) -> DataFrame:
    """[Q3] The state of each task after its events in order: ``events(task_id, ts, seq, status, worker_id)``.

    ``completed`` and ``failed`` count only out of ``processing`` and only by the worker that holds the task (an event
    without a worker isn't checked); anything else always counts.
    """
    step = F.struct("ts", "seq", "status", "worker_id")
    start = F.struct(F.lit("pending").alias("status"), F.lit(None).cast("string").alias("worker_id"), F.lit(0).alias("applied"), F.lit(0).alias("refused"))

    def apply(s, e):
        ends = e["status"].isin("completed", "failed")
        ok = ~ends | ((s["status"] == "processing") & (e["worker_id"].isNull() | s["worker_id"].eqNullSafe(e["worker_id"])))
        return F.struct(
            F.when(ok, e["status"]).otherwise(s["status"]).alias("status"),
            F.when(ok & (e["status"] == "processing"), e["worker_id"]).otherwise(s["worker_id"]).alias("worker_id"),
            (s["applied"] + ok.cast("int")).alias("applied"), (s["refused"] + (~ok).cast("int")).alias("refused"),
        )

    logs = events.groupBy("task_id").agg(F.sort_array(F.collect_list(step)).alias("log"))
    return logs.select("task_id", F.aggregate("log", start, apply).alias("s")).select("task_id", "s.*")


def newest(tasks: DataFrame, n: int, status: str | None = None) -> DataFrame:
    """[Q4]"""
    rows = tasks if status is None else tasks.where(F.col("status") == status)
    return rows.orderBy(F.col("created_at").desc(), "task_id").limit(n)


def reset_stale(tasks: DataFrame, now: Column, minutes: int) -> DataFrame:
    """[Q5] Tasks in work for longer are pending again, with one more retry."""
    stale = (F.col("status") == "processing") & (F.col("started_at") < now - F.expr(f"interval {int(minutes)} minutes"))
    stale = F.coalesce(stale, F.lit(False))
    cleared = lambda c: F.when(~stale, F.col(c)).alias(c)
    new = {"status": F.when(stale, "pending").otherwise(F.col("status")).alias("status"), "retry_count": (F.col("retry_count") + stale.cast("int")).alias("retry_count"), "started_at": cleared("started_at"), "worker_id": cleared("worker_id")}
    return tasks.select(*(new.get(c, F.col(c)) for c in tasks.columns))


def retained(tasks: DataFrame, now: Column, days: int) -> DataFrame:
    """[Q6][C33] All but tasks that ended more than so many days ago."""
    old = F.col("status").isin("completed", "failed") & (F.col("completed_at") < now - F.expr(f"interval {int(days)} days"))
    return tasks.where(~F.coalesce(old, F.lit(False)))


def status_counts(tasks: DataFrame) -> DataFrame:
    """[A15][Q7]"""
    return tasks.groupBy("status").agg(F.count("*").alias("n"))


def running_counts(events: DataFrame, every: str) -> DataFrame:
    """[Q7] Events by status in each stretch of time, as a monitor's counters."""
    return events.groupBy(F.window("ts", every).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("since"), "status", "n")


def with_backoff(attempts: DataFrame, waits: tuple[int, ...] = (30, 90, 180, 600, 1200)) -> DataFrame:
    """[Q9] The wait in seconds before each retry of ``attempts(attempt)`` (from 0); null when there is none left."""
    return attempts.withColumn("wait_s", F.when(F.col("attempt") < len(waits), F.element_at(F.array(*map(F.lit, waits)), F.col("attempt").cast("int") + 1)))


def latest_first(tasks: DataFrame, key: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(F.col("created_at").desc(), "task_id")
    return tasks.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
