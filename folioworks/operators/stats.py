"""Agreement statistics, ledgers and small descriptive aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """[A10] Bounds of the Wilson score interval in per cent; null for no trials."""
    p, m, zz = k.cast("double") / n, n.cast("double"), z * z
    centre = p + zz / (2 * m)
    half = F.lit(z) * F.sqrt(p * (1 - p) / m + F.lit(zz) / (4 * m * m))
    bound = lambda x: F.when(n > 0, 100.0 * x / (1 + F.lit(zz) / m))
    return bound(centre - half), bound(centre + half)


def rule_of_three(n: Column) -> Column:
    """[A11] Upper 95 % bound of a rate with no hits in n trials, in per cent."""
    return F.when(n > 0, 100.0 * 3.0 / n.cast("double"))


def agreement_by(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """[A9][A10] Agreement by pairing and in all, with direction counts (a says yes alone: lenient) and the interval."""
    x, y = F.col(a), F.col(b)
    rolled = pairs.rollup(key).agg(F.count("*").alias("n"), F.count_if(x == y).alias("agree"), F.count_if(x & ~y).alias("lenient"), F.count_if(~x & y).alias("strict"), F.grouping(key).alias("whole"))
    low, high = wilson(F.col("agree"), F.col("n"))
    name = F.when(F.col("whole") == 1, "TOTAL").otherwise(F.col(key).cast("string"))
    return rolled.select(name.alias("pairing"), "n", "agree", (100.0 * F.col("agree") / F.greatest("n", F.lit(1))).alias("agree_pct"), F.round(low, 6).alias("ci95_lo"), F.round(high, 6).alias("ci95_hi"), "lenient", "strict")


def kappa_ac1(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """[A12] Cohen's kappa and Gwet's AC1 of two raters over any categories, from one pass of the contingency table."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    sides = cells.select("n", (F.col("a") == F.col("b")).alias("same"), F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("value")), F.struct(F.lit("b").alias("side"), F.col("b").alias("value")))).alias("s"))
    by_value = sides.groupBy("s.value").agg(
        F.sum(F.when(F.col("s.side") == "a", F.col("n")).otherwise(0)).alias("na"),
        F.sum(F.when(F.col("s.side") == "b", F.col("n")).otherwise(0)).alias("nb"),
        F.sum(F.when((F.col("s.side") == "a") & F.col("same"), F.col("n")).otherwise(0)).alias("both"),
    )
    totals = by_value.agg(F.sum("na").alias("n"), F.sum("both").alias("agree"), F.count("*").alias("q"), F.collect_list(F.struct("na", "nb")).alias("values"))
    n = F.col("n").cast("double")
    po = F.col("agree") / n
    pe = F.aggregate("values", F.lit(0.0), lambda s, v: s + (v["na"] / n) * (v["nb"] / n))
    share = lambda v: (v["na"] + v["nb"]) / (2 * n)
    pg = F.aggregate("values", F.lit(0.0), lambda s, v: s + share(v) * (1 - share(v))) / (F.col("q") - 1)
    out = totals.where("n > 0").select("n", po.alias("po"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"), F.when(F.col("q") > 1, (po - pg) / (1 - pg)).otherwise(F.lit(1.0)).alias("ac1"))
    return out.select("n", *(F.round(c, 9).alias(c) for c in ("po", "kappa", "ac1")))


def ledger(rows: DataFrame, key: str, kind: str, kinds: list[str], pool: str | None = None) -> DataFrame:
    """[A13] One row per slice: flags in all and by disposition, and the share of flags that led to something."""
    counts = [F.count_if(F.col(kind) == k).alias(k) for k in kinds]
    out = rows.groupBy(key).agg(F.count(kind).alias("flags"), *counts)
    useful = sum((F.col(k) for k in kinds[:2]), F.lit(0))
    return out.withColumn("flag_precision_pct", F.round(100.0 * useful / F.greatest("flags", F.lit(1)), 6))


def disagreement_summary(rows: DataFrame, kind: str, item: str, released: str) -> DataFrame:
    """[A14] Records, distinct items and the released and withheld parts, by kind."""
    return rows.groupBy(kind).agg(F.count("*").alias("records"), F.countDistinct(item).alias("items"), F.count_if(released).alias("released"), F.count_if(~F.col(released)).alias("withheld"))


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """[A16] Exact medians: the mean of the middle two for even counts."""
    return rows.groupBy(key).agg(F.median(value).alias("median"))


def mode_first_seen(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """[A17] The most frequent value; of equally frequent ones, that seen first."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.groupBy(key).agg(F.max_by(F.col(value), F.struct(F.col("n"), (-F.col("first")).alias("early"))).alias("mode"))


def envelope(boxes: DataFrame, key: str) -> DataFrame:
    """[A18] The smallest box around all boxes of a key."""
    return boxes.groupBy(key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def estimated_tokens(text: Column) -> Column:
    """[A19] Four thirds of the words, rounded down, at least 1."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(words * 4 / 3).cast("int"))


def token_log(calls: DataFrame, model: str, order: list[str], prompt: str, completion: str) -> DataFrame:
    """[A19] Calls with the running totals of their model."""
    w = Window.partitionBy(model).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("cum_prompt", F.sum(prompt).over(w)).withColumn("cum_completion", F.sum(completion).over(w)).withColumn("cum_calls", F.count("*").over(w))


def pool_after(pool: Column, *removed: Column) -> Column:
    """[A13] Pool arithmetic: what is left after removals."""
    out = pool
    for r in removed:
        out = out - F.coalesce(r, F.lit(0))
    return out
