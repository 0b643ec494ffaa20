"""Items and their sections: filters, validation, lookups, conditions and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_tier(items: DataFrame, tier: int, tier_column: str = "tier") -> DataFrame:
    """[F8]"""
    return items.where(F.col(tier_column) == tier)


def not_released(items: DataFrame, released: DataFrame, key: str, flag: str = "in_paper_analysis") -> DataFrame:
    """Items of the analysis that the released set lacks."""
    return items.where(F.col(flag)).join(released.select(key).distinct(), key, "left_anti")


def validated(items: DataFrame, required: list[str]) -> DataFrame:
    """``problem`` names the first required field that is null or empty; null for a good item."""
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    return items.withColumn("problem", F.coalesce(*(F.when(empty(c), F.lit(c)) for c in required)))


def existing(edges: DataFrame, nodes: DataFrame, target: str, node: str) -> DataFrame:
    """[J2] Edges whose target exists."""
    return edges.join(nodes.select(F.col(node).alias(target)), target, "left_semi")


def with_texts(items: DataFrame, item: str, path: str, sections: DataFrame, section: str = "section_id") -> DataFrame:
    """[J4] The texts of an item's path, in the path's order; an unknown section's text is empty."""
    steps = items.select(item, F.posexplode(path).alias("at", section))
    found = steps.join(sections.select(section, "text"), section, "left").select(item, "at", F.coalesce("text", F.lit("")).alias("text"))
    return found.groupBy(item).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda t: t["text"]).alias("texts"))


def with_operation(rejudged: DataFrame, keys: DataFrame, item: str, op: str) -> DataFrame:
    """[J6] Re-judged rows with the operation that changed their key."""
    return rejudged.join(keys.select(item, op), item)


def closed_book(items: DataFrame) -> DataFrame:
    """[R16] The condition without any context."""
    return items.withColumn("condition", F.lit("closed_book")).withColumn("context", F.lit("")).withColumn("context_chars", F.lit(0))


def together(parts: list[DataFrame]) -> DataFrame:
    """[U1] Rows of all parts, columns by name, in the parts' order (``part``)."""
    return reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)])


def without_repeats(rows: DataFrame, order: str) -> DataFrame:
    """[U2] Equal rows once, where they came first."""
    rest = [c for c in rows.columns if c != order]
    return rows.groupBy(*rest).agg(F.min(order).alias(order))


def less(a: Column, b: Column) -> Column:
    """[U3]"""
    return F.array_except(a, b)


def common(a: Column, b: Column) -> Column:
    """[U4]"""
    return F.array_intersect(a, b)


def ranked(rows: DataFrame, on: list[str], order: list[Column], pos: str) -> DataFrame:
    """[W29] A stable order by several keys: the place of a row among its group's."""
    w = Window.partitionBy(*on).orderBy(*order, pos)
    return rows.withColumn("place", F.row_number().over(w) - 1)


def layout_parts(detections: DataFrame, on: list[str]) -> dict[str, DataFrame]:
    """[W10] Detections by what reads them: text boxes for OCR, tables and formulas, the latter two cleaned of overlaps."""
    from .ordered import drop_overlapping, union_to_fixpoint

    of = lambda *kinds: detections.where(F.col("category_id").isin(*kinds))
    # Category numbers of text-like boxes, tables, and inline and display formulas.
    return {"ocr": of(0, 1, 2, 4, 6, 7), "tables": union_to_fixpoint(of(5), on, 0.7), "formulas": drop_overlapping(of(13, 14), on, 0.9)}


def levelled(titles: DataFrame, levels: DataFrame, on: list[str]) -> DataFrame:
    """[C29] Titles with the levels that a model gave, if it gave as many as there are; else they keep their own.

    ``titles(on, pos, level)``; ``levels(on, levels array<int>)``.
    """
    w = Window.partitionBy(*on)
    rows = titles.withColumn("at", F.row_number().over(w.orderBy("pos"))).withColumn("n", F.count("*").over(w)).join(levels, on, "left")
    return rows.withColumn("level", F.when(F.size("levels") == F.col("n"), F.get("levels", F.col("at") - 1)).otherwise(F.col("level"))).drop("at", "n", "levels")
