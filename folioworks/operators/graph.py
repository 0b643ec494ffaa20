"""Bounded reference chains, their tiers, selection and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacency(edges: DataFrame, distinct: bool) -> DataFrame:
    """[G5] Neighbours by source: all of them in order (corpus 1) or each once (corpus 2)."""
    collect = F.collect_set if distinct else F.collect_list
    return edges.groupBy("source").agg(F.array_sort(collect("target")).alias("targets"))


#: Half paths of one middle node that a task holds on a side; more are dealt to a grid of tasks.
HUB_PATHS = 1 << 14


def _mask(node: str) -> Column:
    """One bit of 64 for a node: paths whose bits are disjoint share no node."""
    return F.expr(f"shiftleft(1L, pmod(hash({node}), 64))")


def _dealt(rows: DataFrame, middle: str, own: str, other: str, own_parts: str, other_parts: str) -> DataFrame:
    """Rows of a crowded middle node by their own part, and once for each part of the other side."""
    own_part = F.when(F.col(own_parts) > 1, F.pmod(F.xxhash64("path"), F.col(own_parts))).otherwise(F.lit(0).cast("long")).cast("int")
    return rows.withColumn(own, own_part).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1)))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths that end where others begin, joined to longer ones without a node twice.

    A node with many paths on either side is met in a grid: each task has some of its left and some of its right paths, so
    that no task holds more than ``HUB_PATHS`` of a side, however many edges the node has.
    """
    sides = left.groupBy(F.col("end").alias("middle")).agg(F.count("*").alias("n_left")).join(right.groupBy(F.col("start").alias("middle")).agg(F.count("*").alias("n_right")), "middle")
    parts = lambda n: F.ceil(F.col(n) / HUB_PATHS).cast("int")
    sides = sides.select("middle", parts("n_left").alias("lefts"), parts("n_right").alias("rights"))
    one = left.withColumnRenamed("end", "middle").drop("internal").join(sides, "middle")
    two = right.withColumnRenamed("start", "middle").join(sides, "middle")
    one = _dealt(one, "middle", "i", "j", "lefts", "rights").drop("lefts", "rights")
    two = _dealt(two, "middle", "j", "i", "rights", "lefts").select("middle", "i", "j", "end", F.slice("path", 2, 1 << 30).alias("tail"), F.col("edges").alias("more"), F.col("mask").alias("ahead"), "internal")
    both = one.join(two, ["middle", "i", "j"]).where((F.col("mask").bitwiseOR(_mask("start")).bitwiseAND(F.col("ahead")) == 0) | ~F.arrays_overlap("path", "tail"))
    whole = F.col("mask").bitwiseOR(F.col("ahead"))
    return both.select("start", "end", F.concat("path", "tail").alias("path"), F.concat("edges", "more").alias("edges"), whole.alias("mask"), "internal")


def chains(edges: DataFrame, starts: DataFrame, nodes: DataFrame, max_depth: int, keep_external: bool = False) -> DataFrame:
    """[G1][G2][J3] All simple paths along edges, one per choice of edges, up to ``max_depth`` of them.

    ``edges(source, target, ...)``: every further column comes back as part of the ``edges`` array. Targets that are no
    node are dropped, or, with ``keep_external``, end a chain. Paths of a depth are two halves that meet in the middle; a
    bitmap of nodes rules out most shared nodes before the paths are compared.
    """
    rest = [c for c in edges.columns if c not in ("source", "target")]
    step = edges.where("source <> target").join(nodes.select(F.col("node").alias("target"), F.lit(True).alias("internal")).distinct(), "target", "left")
    step = step.withColumn("internal", F.coalesce("internal", F.lit(False)))
    if not keep_external:
        step = step.where("internal")
    # the bits of a path leave its start out, which the path before it has
    halves = [step.select(F.col("source").alias("start"), F.col("target").alias("end"), F.array("source", "target").alias("path"), F.array(F.struct("target", *rest)).alias("edges"), _mask("target").alias("mask"), "internal")]
    grown = [halves[0].join(starts.select(F.col("node").alias("start")), "start")]
    for depth in range(2, max_depth + 1):
        first, second = (depth + 1) // 2, depth // 2
        while len(halves) < second:
            n = len(halves) + 1
            halves.append(_met(halves[(n + 1) // 2 - 1].where("internal"), halves[n // 2 - 1]))
        grown.append(_met(grown[first - 1].where("internal"), halves[second - 1]))
    return reduce(DataFrame.unionByName, grown).drop("mask").withColumn("depth", F.size("edges"))


def crossing_tier(edges: Column) -> Column:
    """4 if any edge leaves the part, else 3 for a chapter, 2 for a section, 1."""
    has = lambda flag: F.exists(edges, lambda e: F.coalesce(e[flag], F.lit(False)))
    return F.when(has("crosses_part"), 4).when(has("crosses_chapter"), 3).when(has("crosses_section"), 2).otherwise(1)


def hint_tier(edges: Column) -> Column:
    """[F5]"""
    return F.array_max(F.transform(edges, lambda e: e["tier_hint"]))


def span_hop(edges: Column) -> tuple[Column, Column, Column]:
    """Span (cross_doc, intra_doc, local), hops, and the tier by hops."""
    has = lambda flag: F.exists(edges, lambda e: F.coalesce(e[flag], F.lit(False)))
    span = F.when(has("crosses_part"), "cross_doc").when(has("crosses_chapter") | has("crosses_section"), "intra_doc").otherwise("local")
    hops = F.size(edges)
    return span, hops, F.when(has("crosses_part"), 4).when(hops >= 2, 3).when(hops == 1, 2).otherwise(1)


def useful(end: Column, path: Column, edges: Column, definitions: Column) -> Column:
    """Not through or into a definitions section, and not one edge to a bare numbered clause."""
    rest = F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0)))
    bare = (F.size(edges) == 1) & F.coalesce(F.element_at(edges, 1)["clause"].rlike(r"^[0-9]+$"), F.lit(False))
    return ~F.array_contains(definitions, end) & ~F.arrays_overlap(rest, definitions) & ~bare


def stats(chained: DataFrame) -> DataFrame:
    """[G6] Chains by tier and by depth, in one pass."""
    return chained.groupingSets([[F.col("tier")], [F.col("depth")]], "tier", "depth").agg(F.count("*").alias("n"))


def one_hop(anchors: DataFrame, query: str, section: str, rank: str, refs: str, cap: int = 10) -> DataFrame:
    """[G7] References of the anchors in rank order and then their own order, none an anchor, each once, at most ``cap``."""
    rows = anchors.select(query, rank, F.posexplode(refs).alias("at", "ref"))
    rows = rows.join(anchors.select(query, F.col(section).alias("ref")), [query, "ref"], "left_anti")
    first = rows.groupBy(query, "ref").agg(F.min(F.struct(rank, "at")).alias("seen"))
    w = Window.partitionBy(query).orderBy("seen")
    return first.withColumn("hop_rank", F.row_number().over(w)).where(F.col("hop_rank") <= cap).select(query, "ref", "hop_rank")


def grid_select(chained: DataFrame, order: list[str], per_cell: int = 15) -> DataFrame:
    """[G8] Over the cells (span, hops) in order, distinct by start, end and clauses, the first of each cell."""
    mark = F.concat_ws("|", "start", "end", F.array_join(F.transform("edges", lambda e: F.coalesce(e["clause"], F.lit(""))), ";"))
    once = Window.partitionBy(mark).orderBy("span", "hops", *order)
    cell = Window.partitionBy("span", "hops").orderBy(*order)
    rows = chained.withColumn("k", F.row_number().over(once)).where("k = 1")
    return rows.withColumn("k", F.row_number().over(cell)).where(F.col("k") <= per_cell).withColumnRenamed("k", "cell_rank")


def drawn(key: Column, seed: str) -> Column:
    """A fixed pseudo-random place for a key; the same in every run and on every cluster."""
    return F.md5(F.concat(F.lit(seed + "|"), key.cast("string")).cast("binary"))


def sample_chains(chained: DataFrame, n: int, seed: str) -> DataFrame:
    """[G9] Distinct by start, end and number of edges; of the first ``max(3 n, 500)`` by depth, start and end, n drawn."""
    once = Window.partitionBy("start", "end", "depth").orderBy(F.array_join(F.transform("path", lambda p: p.cast("string")), ">"))
    rows = chained.withColumn("k", F.row_number().over(once)).where("k = 1").drop("k")
    pool = rows.orderBy("depth", "start", "end").limit(max(3 * n, 500))
    return pool.orderBy(drawn(F.concat_ws("|", "start", "end", "depth"), seed)).limit(n)


def round_robin(items: DataFrame, item: str, n: int, seed: str) -> DataFrame:
    """[G10] n rows that go round the shuffled items; ``variant`` counts the rounds."""
    # places by two steps, so that no task sorts all items: ranges of draws, and places within them
    draws = items.select(item, drawn(F.col(item), seed).alias("draw")).withColumn("bucket", F.substring(F.col("draw").cast("string"), 1, 3))
    starts = draws.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = starts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("draw"))
    listed = draws.withColumn("own", own).join(starts, "bucket").select(item, (F.col("start") + F.col("own") - 1).alias("at"))
    length = items.agg(F.count("*").alias("len"))
    turns = items.sparkSession.range(n).withColumnRenamed("id", "i").crossJoin(F.broadcast(length))
    turns = turns.withColumn("at", F.col("i") % F.col("len")).join(listed, "at")
    return turns.select("i", item, F.floor(F.col("i") / F.col("len")).cast("long").alias("variant"))


def balanced_sample(chained: DataFrame, per_tier: int, seed: str) -> DataFrame:
    """[G11] The shallowest chain of each start and end, then so many of each tier, drawn."""
    best = chained.groupBy("start", "end").agg(F.min_by(F.struct("tier", "depth", "path"), F.struct("depth", F.array_join(F.transform("path", lambda p: p.cast("string")), ">").alias("p"))).alias("c"))
    rows = best.select("start", "end", "c.tier", "c.depth", "c.path")
    w = Window.partitionBy("tier").orderBy(drawn(F.concat_ws("|", "start", "end"), seed))
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_tier)
