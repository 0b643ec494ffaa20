"""Item queries over orders and their line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import items as I
from ..sources.tables import lines, table
from .retrieval import LINES


def required_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 5 == 0, " ").otherwise("q").alias("question"), F.when(F.col("l_partkey") % 3 != 0, "c").alias("correct"))
    return I.validated(rows, ["question", "correct"]).select("l_orderkey", "l_linenumber", "problem")


def item_texts(spark: SparkSession, sf: str) -> DataFrame:
    path = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"])
    items = lines(spark, sf).groupBy("l_orderkey").agg(path.alias("path"))
    sections = table(spark, sf, "supplier").where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("section_id"), F.col("s_name").alias("text"))
    return I.with_texts(items, "l_orderkey", "path", sections).select("l_orderkey", F.array_join("texts", "|").alias("texts"))


def known_targets(spark: SparkSession, sf: str) -> DataFrame:
    edges = lines(spark, sf).select("l_orderkey", F.col("l_partkey").alias("target"))
    nodes = table(spark, sf, "documents").select(F.col("doc_id").alias("node"))
    return I.existing(edges, nodes, "target", "node").groupBy("target").agg(F.count("*").alias("n"))


def tier_items(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("tier"))
    return I.closed_book(I.of_tier(orders, 2))


def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("pos"))
    return I.without_repeats(rows, "pos")


def stable_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")
    return I.ranked(rows, ["l_orderkey"], [F.col("l_returnflag"), F.col("l_suppkey").desc()], "l_linenumber").select("l_orderkey", "l_linenumber", "place")


def operation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    judged = lines(spark, sf).select(F.col("l_orderkey").alias("item_id"), (F.col("l_returnflag") != "R").alias("strict"))
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("op")).where("item_id % 2 = 0")
    return I.with_operation(judged, keys, "item_id", "op").groupBy("op").agg(F.count("*").alias("n"), F.count_if("strict").alias("strict"))


QUERIES = {f.__name__: f for f in (required_fields, item_texts, known_targets, tier_items, distinct_rows, stable_order, operation_lookup)}

ORACLES = {
    "required_fields": LINES + " select l_orderkey, l_linenumber, case when l_partkey % 5 = 0 then 'question' when l_partkey % 3 = 0 then 'correct' end as problem from lines",
    "item_texts": LINES + " select l_orderkey, string_agg(coalesce(s_name, ''), '|' order by l_linenumber) as texts from lines left join (select * from supplier where s_suppkey % 7 <> 0) on s_suppkey = l_suppkey group by l_orderkey",
    "known_targets": LINES + " select l_partkey as target, count(*) as n from lines where l_partkey in (select doc_id from documents) group by l_partkey",
    "tier_items": "select o_orderkey, substr(o_orderpriority, 1, 1)::int - 1 as tier, 'closed_book' as condition, '' as context, 0 as context_chars from orders where substr(o_orderpriority, 1, 1) = '3'",
    "distinct_rows": "select l_returnflag, l_linestatus, l_suppkey as s, min(l_orderkey) as pos from lineitem group by all",
    "stable_order": LINES + " select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_returnflag, l_suppkey desc, l_linenumber) - 1 as place from lines",
    "operation_lookup": LINES + " select o_orderstatus as op, count(*) as n, count(*) filter (l_returnflag <> 'R') as strict from lines join orders on o_orderkey = l_orderkey where l_orderkey % 2 = 0 group by 1",
}
