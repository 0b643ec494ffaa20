"""Chains against a plain search, and a hub of very many edges."""

import random

import pytest
from pyspark.sql import functions as F

from folioworks.operators import graph


def plain(edges, starts, nodes, depth, external):
    out, by = [], {}
    for s, t, c in edges:
        if s is not None and t is not None and s != t:
            by.setdefault(s, []).append((t, c))

    def go(path, labels):
        for t, c in by.get(path[-1], []):
            if t not in path and (t in nodes or external):
                out.append((path[0], t, (*path, t), (*labels, c), len(labels) + 1, t in nodes))
                if len(labels) + 1 < depth and t in nodes:
                    go([*path, t], [*labels, c])

    for s in starts:
        go([s], [])
    return sorted(out)


def found(spark, edges, starts, nodes, depth, external):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "node int")
    rows = graph.chains(spark.createDataFrame(edges, "source int, target int, c string"), one(starts), one(nodes), depth, external)
    return sorted((x.start, x.end, tuple(x.path), tuple(e.c for e in x.edges), x.depth, x.internal) for x in rows.collect())


@pytest.mark.parametrize("depth, external, hub", [(1, False, 1 << 14), (4, False, 3), (4, True, 1 << 14), (5, True, 2)])
def test_chains_are_all_simple_paths(spark, monkeypatch, depth, external, hub):
    """With cycles, parallel edges, loops, nulls and targets that are no node; halves of one node in one task or in many."""
    monkeypatch.setattr(graph, "HUB_PATHS", hub)
    r = random.Random(depth)
    edges = [(r.randrange(9), r.randrange(11), f"e{i}") for i in range(26)] + [(1, 2, "p"), (1, 2, "q"), (2, 1, "back"), (3, 3, "loop"), (None, 1, "n"), (1, None, "n")]
    nodes, starts = list(range(9)), [1, 2, 3, 4, 5]
    want = plain(edges, starts, nodes, depth, external)
    assert found(spark, edges, starts, nodes, depth, external) == want and (depth == 1 or any(x[4] == depth for x in want))


def test_a_hub_is_met_in_a_grid(spark):
    """A node that a hundred thousand edges leave and twenty enter: two million paths, no task with more than its share."""
    out, into = 100_000, 20
    edges = spark.range(out).select(F.lit(0).alias("source"), (F.col("id") + 1000).cast("int").alias("target")).unionByName(spark.range(into).select((F.col("id") + 1).cast("int").alias("source"), F.lit(0).alias("target")))
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    rows = graph.chains(edges, spark.range(into).select((F.col("id") + 1).cast("int").alias("node")), nodes, 2)
    counts = {x.depth: x["count"] for x in rows.groupBy("depth").count().collect()}
    assert counts == {1: into, 2: into * out}
    step = edges.select(F.col("source").alias("start"), F.col("target").alias("end"), F.array("source", "target").alias("path"))
    sides = step.groupBy("start").count().withColumn("rights", F.ceil(F.col("count") / graph.HUB_PATHS).cast("int")).withColumn("lefts", F.lit(1))
    dealt = graph._dealt(step.join(sides, "start"), "start", "j", "i", "rights", "lefts").groupBy("start", "i", "j").count()
    assert dealt.agg(F.max("count")).first()[0] < 1.1 * graph.HUB_PATHS and dealt.where("start = 0").count() == 7
