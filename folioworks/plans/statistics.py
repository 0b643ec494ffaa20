"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as S
from ..sources.tables import table


def _raters(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") >= 200).alias("b"))
    return table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("a")).join(docs, "doc_id")


def agreement_wilson(spark: SparkSession, sf: str) -> DataFrame:
    return S.agreement_by(_raters(spark, sf), "source", "a", "b")


def kappa_ac1(spark: SparkSession, sf: str) -> DataFrame:
    return S.kappa_ac1(_raters(spark, sf), "a", "b")


def rule_of_three(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.select("event_type", "n", F.round(S.rule_of_three(F.col("n")), 9).alias("upper_pct"))



def ledger_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag")
    return S.ledger(rows, "l_linestatus", "l_returnflag", ["R", "A", "N"])


def disagreement_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", (F.col("l_linestatus") == "F").alias("released"))
    return S.disagreement_summary(rows, "l_returnflag", "l_partkey", "released")


def median_quantity(spark: SparkSession, sf: str) -> DataFrame:
    return S.medians(table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").cast("double").alias("q")), "l_suppkey", "q")


def mode_flag(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return S.mode_first_seen(rows, "l_suppkey", "l_returnflag", "pos")


def token_accounting(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "conversations").select("conv_id", "turn", "role", S.estimated_tokens(F.col("text")).alias("tokens"))
    return S.token_log(calls, "conv_id", ["turn", "role", "tokens"], "tokens", "tokens").drop("cum_completion")


def queue_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (agreement_wilson, kappa_ac1, rule_of_three, ledger_pivot, disagreement_summary, median_quantity, mode_flag, token_accounting, queue_stats)}

_RATERS = "with r as (select l.doc_id, source, quality = 1 as a, n_chars >= 200 as b from labels l join documents using (doc_id))"
_Z = "1.959963984540054::double"

ORACLES = {
    "agreement_wilson": _RATERS + f""", g as (
  select case when grouping(source) = 1 then 'TOTAL' else source end as pairing, count(*) as n, count(*) filter (a = b) as agree, count(*) filter (a and not b) as lenient, count(*) filter (not a and b) as strict
  from r group by rollup(source)),
p as (select *, agree::double / n as p, {_Z} as z, n::double as m from g)
select pairing, n, agree, 100.0::double * agree / greatest(n, 1) as agree_pct,
  round(100.0::double * (p + z * z / (2 * m) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m), 6) as ci95_lo,
  round(100.0::double * (p + z * z / (2 * m) + z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m), 6) as ci95_hi, lenient, strict from p""",
    "kappa_ac1": _RATERS + """, t as (
  select count(*)::double as n, count(*) filter (a = b)::double as s, count(*) filter (a)::double as a1, count(*) filter (b)::double as b1 from r),
c as (select n, s / n as po, (a1 / n) * (b1 / n) + ((n - a1) / n) * ((n - b1) / n) as pe, 2 * ((a1 + b1) / (2 * n)) * (1 - (a1 + b1) / (2 * n)) as pg from t)
select n::bigint as n, round(po, 9) as po, round((po - pe) / (1 - pe), 9) as kappa, round((po - pg) / (1 - pg), 9) as ac1 from c""",
    "rule_of_three": "select event_type, count(*) as n, round(300.0::double / count(*), 9) as upper_pct from events group by event_type",
    "ledger_pivot": """select l_linestatus, count(l_returnflag) as flags, count(*) filter (l_returnflag = 'R') as "R", count(*) filter (l_returnflag = 'A') as "A", count(*) filter (l_returnflag = 'N') as "N",
  round(100.0::double * count(*) filter (l_returnflag in ('R', 'A')) / greatest(count(l_returnflag), 1), 6) as flag_precision_pct from lineitem group by l_linestatus""",
    "disagreement_summary": """select l_returnflag, count(*) as records, count(distinct l_partkey) as items, count(*) filter (l_linestatus = 'F') as released, count(*) filter (l_linestatus <> 'F') as withheld
from lineitem group by l_returnflag""",
    "median_quantity": "select l_suppkey, median(l_quantity::double) as median from lineitem group by l_suppkey",
    "mode_flag": """with c as (select l_suppkey, l_returnflag, count(*) as n, min(l_orderkey * 10 + l_linenumber) as f from lineitem group by all),
k as (select *, row_number() over (partition by l_suppkey order by n desc, f) as k from c) select l_suppkey, l_returnflag as mode from k where k = 1""",
    "token_accounting": r"""with c as (select conv_id, turn, role, greatest(1, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) * 4 // 3)::int as tokens from conversations)
select conv_id, turn, role, tokens, (sum(tokens) over w)::bigint as cum_prompt, count(*) over w as cum_calls from c window w as (partition by conv_id order by turn, role, tokens rows unbounded preceding)""",
    "queue_stats": "select o_orderstatus as status, count(*) as n from orders group by 1",
}
