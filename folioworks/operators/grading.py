"""Strict grading of answers over atomic facts, per-tier roll-ups and paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derived_strict(verdicts: Column) -> Column:
    """[A4] All facts are present; an item without facts is not correct."""
    return (F.size(verdicts) > 0) & F.forall(verdicts, lambda v: F.coalesce(v["present"], F.lit(False)))


def strict_items(facts: DataFrame, item: str, tier: str, present: str) -> DataFrame:
    """[A4] One row per item from one row per fact: strict conjunction and the counts behind it."""
    ok = F.coalesce(F.col(present), F.lit(False))
    return facts.groupBy(item, tier).agg(F.bool_and(ok).alias("strict"), F.count_if(ok).alias("facts_present"), F.count("*").alias("facts_total"))


def strict_by_tier(items: DataFrame, tier: str = "tier", strict: str = "strict") -> DataFrame:
    """[A1] Correct and total by tier and in all (``TOTAL``), guarded against no items."""
    rolled = items.rollup(tier).agg(F.count_if(F.col(strict)).alias("correct"), F.count("*").alias("total"), F.grouping(tier).alias("all_tiers"))
    label = F.when(F.col("all_tiers") == 1, "TOTAL").otherwise(F.concat(F.lit("T"), F.col(tier).cast("string")))
    share = F.col("correct").cast("double") / F.greatest("total", F.lit(1))
    return rolled.select(label.alias("tier"), "correct", "total", share.alias("accuracy"))


def accuracy_by(items: DataFrame, key: str, strict: str = "strict", tier: str = "tier") -> DataFrame:
    """[A1] Grouping sets (key, tier) and (key): one pass for every condition."""
    grouped = items.groupingSets([[F.col(key), F.col(tier)], [F.col(key)]], F.col(key), F.col(tier))
    return grouped.agg(F.count_if(F.col(strict)).alias("correct"), F.count("*").alias("total"), F.grouping(tier).cast("int").alias("is_total"))


def fact_rate(items: DataFrame, tier: str, present: str, total: str) -> DataFrame:
    """[A3] Facts present over facts asked by tier, nulls as none."""
    p, t = (F.sum(F.coalesce(F.col(c), F.lit(0))) for c in (present, total))
    return items.groupBy(tier).agg(p.cast("long").alias("facts_present"), t.cast("long").alias("facts_total"), (p.cast("double") / F.greatest(t, F.lit(1))).alias("fact_rate"))


def mean_recall(items: DataFrame, tier: str, recall: str) -> DataFrame:
    """[A2] Mean of the recalls that are known; no known recall gives 0."""
    return items.groupBy(tier).agg(F.coalesce(F.avg(recall), F.lit(0.0)).alias("mean_recall"), F.count(recall).alias("n"))


def paired_perturbation(pairs: DataFrame, system: str, released: str, perturbed: str) -> DataFrame:
    """[A6] Per system and in all: strict counts under either key, the change in points, and agreement."""
    r, p = F.col(released), F.col(perturbed)
    rolled = pairs.rollup(system).agg(F.count_if(r).alias("released"), F.count_if(p).alias("perturbed"), F.count("*").alias("n"), F.count_if(r == p).alias("agree"), F.grouping(system).alias("whole"))
    n = F.greatest("n", F.lit(1))
    return rolled.select(
        F.when(F.col("whole") == 1, "ALL").otherwise(F.col(system)).alias("system"), "released", "perturbed", "n",
        (F.lit(100.0) * (F.col("perturbed") - F.col("released")) / n).alias("delta_pp"),
        (F.lit(100.0) * F.col("agree") / n).alias("agree_pct"),
    )


def parse_judgement(text: Column, schema: str) -> Column:
    """[C1] The JSON object in a model's reply: reasoning and fences go, first brace to last, permissive parse."""
    clean = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    clean = F.regexp_replace(clean, r"(?U)^\s+|\s+$", "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")
    back = F.instr(F.reverse(clean), "}")
    first, last = F.instr(clean, "{"), F.when(back > 0, F.length(clean) - back + 1).otherwise(0)
    body = F.when((first > 0) & (last > first), F.substring(clean, first, last - first + 1))
    value = F.from_json(body, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    error = F.when(body.isNull(), "parse_fail").when(value["_corrupt"].isNotNull(), "json_fail")
    return F.struct(value.alias("value"), error.alias("error"))


def counters(items: DataFrame, keys: list[str]) -> DataFrame:
    """[A5] Counts by each attribute in one pass; a missing value counts as ``?``."""
    shown = items.select(*(F.coalesce(F.col(k).cast("string"), F.lit("?")).alias(k) for k in keys))
    grouped = shown.groupingSets([[F.col(k)] for k in keys], *(F.col(k) for k in keys)).agg(F.count("*").alias("n"))
    attribute = F.coalesce(*(F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys))
    return grouped.select(attribute.alias("attribute"), F.coalesce(*keys).alias("value"), "n")
