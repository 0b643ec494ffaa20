"""Audit queries: benchmark passages as quotes, line items as verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit as A
from ..sources.tables import lines, table
from .retrieval import LINES


def quote_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Each document is asked for two phrases: one of its own and one that it may not have."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    own = F.trim(F.substring("text", 20, 30))
    verdicts = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("wrong_value").alias("verdict"), own.alias("quote")), F.struct(F.lit("missing_override").alias("verdict"), F.lit("no such phrase").alias("quote")), F.struct(F.lit("verified").alias("verdict"), F.lit("").alias("quote")), F.struct(F.lit("uncertain").alias("verdict"), own.alias("quote")))).alias("v")).select("doc_id", "v.*")
    checked = A.verify_quotes(verdicts, docs.select("doc_id", "text"), "doc_id")
    return checked.select("doc_id", "verdict", "checked", F.coalesce("original", F.lit("-")).alias("original"), "quote_verified")


def _verdicts(spark: SparkSession, sf: str, a: int) -> DataFrame:
    line = lines(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    verdict = F.when(F.col("l_returnflag") == "R", "wrong_value").when(F.col("l_partkey") % a == 0, "uncertain").otherwise("verified")
    return line.where(F.col("l_partkey") % 11 != a).select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").cast("int").alias("fact_idx"), verdict.alias("verdict"))


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    items = lines(spark, sf).groupBy(F.col("l_orderkey").alias("qid")).agg(F.count("*").alias("n"))
    spine = A.pairing_spine(items, "qid", "n")
    return A.fuse_verdicts(spine, _verdicts(spark, sf, 5), _verdicts(spark, sf, 7), "qid")


def verdict_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf)


def confusion_pr(spark: SparkSession, sf: str) -> DataFrame:
    labels = lines(spark, sf).select(F.col("l_orderkey").alias("qid"), (F.col("l_linenumber").cast("int") - 1).alias("fact_idx0"), F.when(F.col("l_linestatus") == "F", "fail").otherwise("pass").alias("label"))
    return A.confusion(A.with_labels(_fused(spark, sf), labels.where("label = 'fail'"), "qid"), "either", "human")


def item_flags(spark: SparkSession, sf: str) -> DataFrame:
    line = lines(spark, sf).select("l_orderkey", F.struct("l_linenumber", F.when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 3 == 0), "incorrect").when(F.col("l_returnflag") == "A", "uncertain").otherwise("correct").alias("verdict")).alias("f"))
    items = line.groupBy("l_orderkey").agg(F.collect_list("f").alias("per_fact"))
    return items.select("l_orderkey", A.item_flag(F.col("per_fact")).alias("flag"))


def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    todo = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    done = todo.withColumn("response", F.when(F.col("o_orderkey") % 3 == 0, "[ERROR: timeout]").when(F.col("o_orderkey") % 3 == 1, "fine")).where("o_orderkey % 4 <> 0")
    return A.resume(todo, done, ["o_orderkey"]).select("o_orderkey")


def repairs_applied(spark: SparkSession, sf: str) -> DataFrame:
    line = lines(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    items = line.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("facts"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    repairs = line.withColumn("fact_idx", place).where("l_partkey % 13 = 0").select("l_orderkey", "fact_idx", F.lit("fixed").alias("new_text"))
    return A.apply_repairs(items, repairs, "l_orderkey", "facts").select("l_orderkey", F.array_join("facts", ",").alias("facts"))


def validation_missing(spark: SparkSession, sf: str) -> DataFrame:
    return A.validated(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")[1]


QUERIES = {f.__name__: f for f in (quote_verify, verdict_fusion, confusion_pr, item_flags, resume_antijoin, repairs_applied, validation_missing)}

_V = LINES + """, l as (select l_orderkey as qid, l_linenumber::int as n, l_returnflag as r, l_partkey as p, l_linestatus as s from lines),
a as (select qid, n, case when r = 'R' then 'wrong_value' when p % 5 = 0 then 'uncertain' else 'verified' end as v from l where p % 11 <> 5),
b as (select qid, n, case when r = 'R' then 'wrong_value' when p % 7 = 0 then 'uncertain' else 'verified' end as v from l where p % 11 <> 7),
i as (select qid, unnest(range(1, count(*) + 1))::int as n from l group by qid),
f as (select i.qid, i.n as fact_idx, coalesce(a.v, 'unknown') as first, coalesce(b.v, 'unknown') as second from i left join a using (qid, n) left join b using (qid, n)),
g as (select *, first not in ('verified', 'unknown') or second not in ('verified', 'unknown') as either, first not in ('verified', 'unknown') and second not in ('verified', 'unknown') as both from f)
"""

ORACLES = {
    "quote_verify": r"""with d as (select doc_id, trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) as t, trim(regexp_replace(trim(substr(text, 20, 30)), '[\s\x{00A0}]+', ' ', 'g')) as q from documents)
select doc_id, 'wrong_value' as verdict, case when q <> '' and contains(t, q) then 'wrong_value' else 'uncertain' end as checked, case when q <> '' and contains(t, q) then '-' else 'wrong_value' end as original, q <> '' and contains(t, q) as quote_verified from d
union all select doc_id, 'missing_override', case when contains(t, 'no such phrase') then 'missing_override' else 'uncertain' end, case when contains(t, 'no such phrase') then '-' else 'missing_override' end, contains(t, 'no such phrase') from d
union all select doc_id, 'verified', 'verified', '-', false from d union all select doc_id, 'uncertain', 'uncertain', '-', false from d""",
    "verdict_fusion": _V + "select * from g",
    "confusion_pr": _V + """, h as (select g.*, coalesce(l.s = 'F', false) as human from g left join l on l.qid = g.qid and l.n = g.fact_idx),
c as (select count(*) filter (either and human) as tp, count(*) filter (either and not human) as fp, count(*) filter (not either and human) as fn, count(*) filter (not either and not human) as tn from h)
select *, tp::double / greatest(tp + fp, 1) as precision, tp::double / greatest(tp + fn, 1) as recall from c""",
    "item_flags": LINES + " select l_orderkey, bool_or(l_returnflag = 'R' and l_partkey % 3 = 0) as flag from lines group by l_orderkey",
    "resume_antijoin": "select o_orderkey from orders where not (o_orderkey % 4 <> 0 and o_orderkey % 3 = 1)",
    "repairs_applied": LINES + " select l_orderkey, string_agg(case when l_partkey % 13 = 0 then 'fixed' else l_returnflag end, ',' order by l_linenumber) as facts from lines group by l_orderkey",
    "validation_missing": "select doc_id from documents where doc_id not in (select doc_id from labels)",
}
