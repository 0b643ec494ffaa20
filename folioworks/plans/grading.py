"""Grading queries over orders (items) and their line items (facts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grading as G
from ..sources.tables import table


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "orders").select("o_orderkey", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("tier"), "o_orderstatus")
    facts = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("present"), (F.col("l_linestatus") == "F").alias("second"))
    return facts.join(items, F.col("l_orderkey") == F.col("o_orderkey"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return G.strict_items(_facts(spark, sf), "o_orderkey", "tier", "present")


def strict_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    return G.strict_by_tier(_items(spark, sf))


def fact_rate(spark: SparkSession, sf: str) -> DataFrame:
    return G.fact_rate(_items(spark, sf), "tier", "facts_present", "facts_total")


def paired_perturbation(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _facts(spark, sf).groupBy("o_orderkey", "o_orderstatus").agg(F.bool_and("present").alias("released"), F.bool_and("second").alias("perturbed"))
    return G.paired_perturbation(pairs, "o_orderstatus", "released", "perturbed")


def accuracy_by_condition(spark: SparkSession, sf: str) -> DataFrame:
    items = _facts(spark, sf).groupBy("o_orderkey", "tier", "o_orderstatus").agg(F.bool_and("present").alias("strict"))
    return G.accuracy_by(items, "o_orderstatus")


def judge_json_parse(spark: SparkSession, sf: str) -> DataFrame:
    replies = table(spark, sf, "events").select("event_id", F.concat(F.lit("<think>{x}</think>```json\n"), "props", F.lit("\n```")).alias("raw"))
    parsed = replies.select("event_id", G.parse_judgement(F.col("raw"), "k long").alias("p"))
    return parsed.select("event_id", F.col("p.value.k").alias("k"), F.coalesce("p.error", F.lit("ok")).alias("status"))


def mean_recall(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf).withColumn("recall", F.when(F.col("facts_total") > 1, F.col("facts_present") / F.col("facts_total")))
    return G.mean_recall(items, "tier", "recall").select("tier", F.round("mean_recall", 9).alias("mean_recall"), "n")


def item_counters(spark: SparkSession, sf: str) -> DataFrame:
    return G.counters(table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"])


QUERIES = {f.__name__: f for f in (strict_by_tier, fact_rate, paired_perturbation, accuracy_by_condition, judge_json_parse, mean_recall, item_counters)}

_FACTS = """with f as (select l_orderkey as k, o_orderstatus as st, cast(substr(o_orderpriority, 1, 1) as int) - 1 as tier,
  l_returnflag <> 'R' as present, l_linestatus = 'F' as second from lineitem join orders on l_orderkey = o_orderkey),
i as (select k, tier, bool_and(present) as strict, count(*) filter (present) as p, count(*) as t from f group by k, tier)
"""

ORACLES = {
    "strict_by_tier": _FACTS + """select case when grouping(tier) = 1 then 'TOTAL' else 'T' || tier end as tier,
  count(*) filter (strict) as correct, count(*) as total, (count(*) filter (strict))::double / greatest(count(*), 1) as accuracy from i group by rollup(tier)""",
    "fact_rate": _FACTS + "select tier, sum(p)::bigint as facts_present, sum(t)::bigint as facts_total, sum(p)::double / greatest(sum(t), 1) as fact_rate from i group by tier",
    "paired_perturbation": _FACTS + """, q as (select k, st, bool_and(present) as r, bool_and(second) as p from f group by k, st)
select case when grouping(st) = 1 then 'ALL' else st end as system, count(*) filter (r) as released, count(*) filter (p) as perturbed, count(*) as n,
  100.0::double * (count(*) filter (p) - count(*) filter (r)) / greatest(count(*), 1) as delta_pp,
  100.0::double * count(*) filter (r = p) / greatest(count(*), 1) as agree_pct from q group by rollup(st)""",
    "accuracy_by_condition": _FACTS + """, q as (select k, st, tier, bool_and(present) as strict from f group by k, st, tier)
select st as o_orderstatus, tier, count(*) filter (strict) as correct, count(*) as total, grouping(tier)::int as is_total from q group by grouping sets ((st, tier), (st))""",
    "judge_json_parse": "select event_id, cast(json_extract(props, '$.k') as bigint) as k, 'ok' as status from events",
    "mean_recall": _FACTS + "select tier, round(coalesce(avg(case when t > 1 then p::double / t end), 0), 9) as mean_recall, count(case when t > 1 then 1 end) as n from i group by tier",
    "item_counters": """select 'o_orderpriority' as attribute, coalesce(o_orderpriority, '?') as value, count(*) as n from orders group by 2
union all select 'o_orderstatus', coalesce(o_orderstatus, '?'), count(*) from orders group by 2""",
}
