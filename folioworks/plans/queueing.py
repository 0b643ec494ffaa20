"""Queue queries: orders as tasks, user events as transitions, at a fixed time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import taskqueue as Q
from ..sources.tables import table

NOW = "1998-08-02 00:00:00"


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    at = F.col("o_orderdate").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 2 == 0, "pending").otherwise("processing")).when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    return orders.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("task_id"), status.alias("status"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), at.alias("created_at"),
        at.alias("started_at"), F.when(status.isin("completed", "failed"), at).alias("completed_at"), F.lit("w").alias("worker_id"), F.lit(0).alias("retry_count"),
    )


def _now():
    return F.lit(NOW).cast("timestamp")


def next_task(spark: SparkSession, sf: str) -> DataFrame:
    return Q.next_tasks(_tasks(spark, sf), 5).select("task_id", "priority")


def stale_reset(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q.reset_stale(_tasks(spark, sf), _now(), 60 * 24 * 30)
    return rows.groupBy("status", "retry_count").agg(F.count("*").alias("n"), F.count("worker_id").alias("held"))


def retention(spark: SparkSession, sf: str) -> DataFrame:
    return Q.status_counts(Q.retained(_tasks(spark, sf), _now(), 365))


def newest_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return Q.newest(_tasks(spark, sf), 20, "completed").select("task_id")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("processing", "completed", "failed", "pending", "cancelled"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("task_id"), "ts", F.col("event_id").alias("seq"), status.alias("status"), F.lit(None).cast("string").alias("worker_id"))


def task_states(spark: SparkSession, sf: str) -> DataFrame:
    return Q.fold_transitions(_events(spark, sf)).select("task_id", "status", "applied", "refused")


def monitor_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q.running_counts(_events(spark, sf), "1 day")
    return rows.select(F.col("since").cast("date").alias("since"), "status", "n")


QUERIES = {f.__name__: f for f in (next_task, stale_reset, retention, newest_tasks, task_states, monitor_counts)}

_T = f"""with t as (select lpad(o_orderkey::varchar, 12, '0') as task_id, case o_orderstatus when 'O' then case when o_orderkey % 2 = 0 then 'pending' else 'processing' end when 'F' then 'completed' else 'failed' end as status,
  (6 - substr(o_orderpriority, 1, 1)::int)::int as priority, o_orderdate::timestamp as since from orders), z as (select timestamp '{NOW}' as now)
"""

ORACLES = {
    "next_task": _T + "select task_id, priority from t where status = 'pending' order by priority desc, since, task_id limit 5",
    "stale_reset": _T + """, s as (select *, status = 'processing' and since < now - interval 30 day as stale from t, z)
select case when stale then 'pending' else status end as status, stale::int as retry_count, count(*) as n, count(*) filter (not stale) as held from s group by 1, 2""",
    "retention": _T + "select status, count(*) as n from t, z where not (status in ('completed', 'failed') and since < now - interval 365 day) group by status",
    "newest_tasks": _T + "select task_id from t where status = 'completed' order by since desc, task_id limit 20",
    "task_states": """with recursive e as (select user_id::varchar as task_id, row_number() over (partition by user_id order by ts, event_id) as k, ['processing', 'completed', 'failed', 'pending', 'cancelled'][event_id % 5 + 1] as st from events),
f as (
  select task_id, 0::bigint as k, 'pending' as status, 0 as applied, 0 as refused from (select distinct task_id from e)
  union all
  select f.task_id, e.k, case when e.st not in ('completed', 'failed') or f.status = 'processing' then e.st else f.status end,
    applied + (e.st not in ('completed', 'failed') or f.status = 'processing')::int, refused + (e.st in ('completed', 'failed') and f.status <> 'processing')::int
  from f join e on e.task_id = f.task_id and e.k = f.k + 1),
l as (select *, row_number() over (partition by task_id order by k desc) as r from f) select task_id, status, applied, refused from l where r = 1""",
    "monitor_counts": "select ts::date as since, ['processing', 'completed', 'failed', 'pending', 'cancelled'][event_id % 5 + 1] as status, count(*) as n from events group by 1, 2",
}
