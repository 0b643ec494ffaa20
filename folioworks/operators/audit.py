"""Quote verification, verdict fusion, comparison with human labels, and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(x: Column) -> Column:
    """[C2] White space of any kind as single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^ | $", "")


def verify_quotes(verdicts: DataFrame, corpus: DataFrame, key: str, text: str = "text") -> DataFrame:
    """[C3] Verdicts whose quote the item's loaded text does not hold become ``uncertain``; the old one is kept.

    ``verdicts(key, verdict, quote)``; ``corpus(key, text)`` is one row per key. Verdicts ``verified`` and
    ``uncertain`` are not touched, and their quotes count as not verified; a missing verdict without a quote that can be found is demoted too.
    """
    rows = verdicts.join(corpus.select(key, normalised(F.col(text)).alias("loaded")), key, "left")
    quote = normalised(F.coalesce("quote", F.lit("")))
    found = (quote != "") & F.contains(F.coalesce("loaded", F.lit("")), quote)
    open_ = ~F.coalesce(F.col("verdict").isin("verified", "uncertain"), F.lit(False))
    demoted = open_ & ~found
    return rows.select(*verdicts.columns, F.when(demoted, "uncertain").otherwise(F.col("verdict")).alias("checked"), F.when(demoted, F.col("verdict")).alias("original"), (open_ & found).alias("quote_verified"))


def pairing_spine(items: DataFrame, key: str, n: str) -> DataFrame:
    """[J7] One row per fact, 1-based."""
    return items.where(F.col(n) > 0).select(key, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("fact_idx"))


def flagged(verdict: Column) -> Column:
    """[A7] Anything but verified and unknown is a flag, ``uncertain`` too."""
    return ~verdict.isin("verified", "unknown")


def fuse_verdicts(spine: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """[A7][J7] Two auditors' verdicts by fact, missing ones ``unknown``; flagged by either and by both."""
    on = [key, "fact_idx"]
    rows = spine.join(first.select(*on, F.col("verdict").alias("first")), on, "left").join(second.select(*on, F.col("verdict").alias("second")), on, "left")
    a, b = (F.coalesce(c, F.lit("unknown")) for c in ("first", "second"))
    return rows.select(*on, a.alias("first"), b.alias("second"), (flagged(a) | flagged(b)).alias("either"), (flagged(a) & flagged(b)).alias("both"))


def with_labels(flags: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """[J8] Flags with the human label (0-based facts, missing ones ``pass``); fail and uncertain are flags."""
    human = labels.select(key, (F.col("fact_idx0") + 1).alias("fact_idx"), "label")
    return flags.join(human, [key, "fact_idx"], "left").withColumn("label", F.coalesce("label", F.lit("pass"))).withColumn("human", F.col("label").isin("fail", "uncertain"))


def confusion(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """[A8] Micro-averaged counts, precision and recall over all facts."""
    p, a = F.col(predicted), F.col(actual)
    out = rows.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    return out.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)).cast("double")).withColumn("recall", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)).cast("double"))


def item_flag(per_fact: Column) -> Column:
    """[A22] An item is flagged by a fact that is incorrect or cites what isn't there; uncertainty alone never flags."""
    return F.exists(per_fact, lambda f: F.coalesce(f["verdict"].isin("incorrect", "hallucinated_citation"), F.lit(False)))


def validated(validation: DataFrame, full: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """[J9] The rows of both, and the keys that are missing from the full sample."""
    return validation.join(full, key), validation.select(key).join(full, key, "left_anti")


def resume(todo: DataFrame, done: DataFrame, keys: list[str], response: str = "response") -> DataFrame:
    """[J10][Q10] What has no response yet, or an error for one."""
    good = done.where(~F.coalesce(F.startswith(F.col(response), F.lit("[ERROR")), F.lit(True)))
    return todo.join(good.select(*keys).distinct(), keys, "left_anti")


def merged_results(done: DataFrame, fresh: DataFrame, response: str = "response") -> DataFrame:
    """[K3][Q10] Kept good rows and the fresh ones."""
    return done.where(~F.coalesce(F.startswith(F.col(response), F.lit("[ERROR")), F.lit(True))).unionByName(fresh)


def once_per_key(rows: DataFrame, key: str, expensive) -> DataFrame:
    """An expensive transform of the distinct keys only, joined back to all rows."""
    return rows.join(expensive(rows.select(key).distinct()), key, "left")


def apply_repairs(items: DataFrame, repairs: DataFrame, key: str, facts: str) -> DataFrame:
    """Keyed replacement of array elements: ``repairs(key, fact_idx, new_text)`` with 0-based facts; of several the largest text."""
    latest = repairs.groupBy(key, "fact_idx").agg(F.max("new_text").alias("new_text")).groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("fact_idx", "new_text")))).alias("patch"))
    rows = items.join(latest, key, "left")
    patched = F.transform(facts, lambda f, i: F.coalesce(F.element_at("patch", i.cast("int")), f))
    return rows.withColumn(facts, F.when(F.col("patch").isNull(), F.col(facts)).otherwise(patched)).drop("patch")
