"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A document's size is its number of words (runs of anything but ASCII white space; a null text has none). The sources,
by code point with null last, weigh 5, 2, 1, repeating, and share the total of all sizes; a target stops at three times
its source's size and the excess goes to the others by weight until none is above. That sharing has a closed form: by
rising ``size / weight`` the capped sources come first, so two running sums over the sources settle it, in integers.

Each document of a source is expected ``target / source size`` times. Documents are put in an order within their source
(by size to two leading digits' magnitude, then pseudo-randomly), the expected copies are summed along it, one offset
per source is added, and a document is emitted once for each integer that its part of the sum crosses. Sorting by size
first keeps the words taken near the target. As the expectation is the same for all documents of a source, the prefix
sum is the rank times it, and the rank is the rows of earlier groups (counted per source, size class and slot) plus the
row number within the group. A size class has a slot for each ``SLOT_ROWS`` of its rows, so no source is ever one task.

The words are counted once; what is ranked are rows of some fifty bytes. Whole documents join their copies at the end.

Defined results: a null text, or one without words, has size 0 and is taken 0 words; null sources are one source;
repeated rows and ids each count; a source without words has target 0; an empty table gives no rows; columns may have
any name. Reruns agree: the order and offsets come from md5 of the id, the source and the seed, and rows of one id, or
without one, go by a hash of all their columns (but maps), so only rows that are equal in all of them can swap places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
SLOT_ROWS = 100_000
SEED = "mix-1"


def _hex(text, first: int, digits: int):
    return F.conv(F.substring(F.md5(text.cast("binary")), first, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source."""
    exact = lambda x: F.col(x).cast("decimal(38,0)")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    table = table.withColumn("cap", F.col("source_size") * most)
    rising = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    table = table.select(
        "source", "source_size", "weight", "cap",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("rest"),
    )
    table = table.withColumn("capped", (exact("total") - exact("before")) * exact("weight") > exact("cap") * exact("rest"))
    free = lambda x: F.coalesce(F.sum(F.when(~F.col("capped"), F.col(x))).over(everything), F.lit(0))
    fixed = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    table = table.withColumn("left_over", F.col("total") - fixed).withColumn("free_weight", free("weight"))
    share = (F.col("weight") * F.col("left_over")).cast("double") / F.col("free_weight").cast("double")
    return table.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _digest(docs: DataFrame):
    """A hash of a document's columns."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Equal rows told apart by a number."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "digest").orderBy(F.lit(1))))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, slot_rows: int = SLOT_ROWS, whole: bool = False) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)`` per row of ``docs(doc_id, text, source)``; ``whole``: and the row itself, as ``document``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    digits = F.length(F.col("size").cast("string"))
    key = F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.col("digest").cast("string"))))
    rows = docs.select("doc_id", "source", (_digest(docs) if whole else F.xxhash64("text")).alias("digest"), size.alias("size"))
    rows = _numbered(rows) if whole else rows
    rows = cut(rows.withColumn("class", digits * 10 + F.substring(F.col("size").cast("string"), 1, 1).cast("int")).withColumn("draw", _hex(key, 1, 12)))
    counts = cut(rows.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    shares = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    slots = counts.select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), F.ceil(F.col("n") / slot_rows).alias("slots"))
    rows = rows.join(slots, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class"))).withColumn("slot", F.col("draw") % F.col("slots")).drop("c_source", "c_class", "slots")
    groups = rows.groupBy("source", "class", "slot").agg(F.count("*").alias("n"))
    along = Window.partitionBy("source").orderBy("class", "slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("source", "class", "slot", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start"))
    offset = (_hex(F.concat(F.lit(seed + "#"), F.coalesce("source", F.lit("\u0000"))), 1, 4).cast("double") + 0.5) / 65536.0
    plan = starts.alias("s").join(shares.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    plan = plan.select(F.col("s.source").alias("p_source"), F.col("class").alias("p_class"), F.col("slot").alias("p_slot"), "start", "source_size", "target")
    within = Window.partitionBy("source", "class", "slot").orderBy("size", "draw", "doc_id", "digest")
    ranked = rows.withColumn("place", F.row_number().over(within).cast("long"))
    ranked = ranked.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("class") == F.col("p_class")) & (F.col("slot") == F.col("p_slot")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    rank = F.col("start") + F.col("place")
    ranked = ranked.withColumn("rate", rate).withColumn("u", offset)
    crossed = F.floor(F.col("u") + F.col("rate") * rank) - F.floor(F.col("u") + F.col("rate") * (rank - 1))
    out = ranked.withColumn("copies", crossed.cast("long"))
    out = out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["source", "digest", "nth"] if whole else []))
    if not whole:
        return out
    both = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col("d.digest") == F.col("m.digest")) & (F.col("d.nth") == F.col("m.nth"))
    named = _numbered(docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("document"), "doc_id", "source", _digest(docs).alias("digest")))
    return named.alias("d").join(out.alias("m"), both).select("m.doc_id", "size", "source_size", "target", "copies", "taken", "document")
