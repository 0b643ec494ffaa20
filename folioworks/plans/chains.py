"""Chain queries over a graph of suppliers with three references each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.tables import table


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("node"), F.col("s_nationkey").cast("int").alias("ch"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Targets within the next two hundred keys; some are no node, some the source itself; one edge in two is double."""
    own = _nodes(spark, sf)
    refs = F.array(*(F.struct(F.lit(k).alias("k"), ((F.col("node") * a) % 200 + F.floor(F.col("node") / 200).cast("int") * 200 + 1).alias("target")) for k, a in ((1, 7), (2, 11), (3, 7))))
    rows = own.select(F.col("node").alias("source"), "ch", F.explode(refs).alias("r")).select("source", "ch", "r.*").where("k < 3 or source % 2 = 0")
    nations = own.select(F.col("node").alias("target"), F.col("ch").alias("t_ch"))
    rows = rows.join(nations, "target", "left")
    part, t_part = F.floor(F.col("ch") / 5), F.floor(F.col("t_ch") / 5)
    return rows.select(
        "source", "target", F.when(F.col("k") == 3, F.lit("7")).otherwise(F.concat(F.lit("c"), "k")).alias("clause"),
        F.coalesce(part != t_part, F.lit(True)).alias("crosses_part"), F.coalesce((part == t_part) & (F.col("ch") != F.col("t_ch")), F.lit(False)).alias("crosses_chapter"),
        F.coalesce(F.col("ch") == F.col("t_ch"), F.lit(False)).alias("crosses_section"), F.col("k").alias("tier_hint"),
    )


def _chains(spark: SparkSession, sf: str) -> DataFrame:
    edges = _edges(spark, sf)
    found = G.chains(edges, edges.select(F.col("source").alias("node")).distinct(), _nodes(spark, sf).select("node"), 3)
    span, hops, legacy = G.span_hop(F.col("edges"))
    return found.withColumn("tier", G.crossing_tier(F.col("edges"))).withColumn("span", span).withColumn("hops", hops).withColumn("legacy", legacy)


def _path(c: str = "path"):
    return F.array_join(F.transform(c, lambda p: p.cast("string")), ">").alias("path")


def _clauses():
    return F.array_join(F.transform("edges", lambda e: e["clause"]), ";").alias("clauses")


def chain_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _chains(spark, sf).select("start", "end", "depth", _path(), _clauses(), "tier", "span", "legacy", G.hint_tier(F.col("edges")).alias("hint"))


def chains_external(spark: SparkSession, sf: str) -> DataFrame:
    found = G.chains(_edges(spark, sf).select("source", "target").distinct(), _nodes(spark, sf), _nodes(spark, sf), 3, keep_external=True)
    return found.select("start", "end", "depth", _path(), "internal")


def chains_by_tier_depth(spark: SparkSession, sf: str) -> DataFrame:
    return G.stats(_chains(spark, sf))


def useful_chains(spark: SparkSession, sf: str) -> DataFrame:
    definitions = F.array(*(F.lit(k) for k in (8, 15, 22, 30)))
    return _chains(spark, sf).where(G.useful(F.col("end"), F.col("path"), F.col("edges"), definitions)).groupBy("depth").agg(F.count("*").alias("n"))


def one_hop_cap(spark: SparkSession, sf: str) -> DataFrame:
    near = G.adjacency(_edges(spark, sf), True)
    anchors = near.select((F.col("source") % 25).alias("query"), F.col("source").alias("section"), F.col("source").alias("rank"), F.col("targets").alias("refs"))
    return G.one_hop(anchors, "query", "section", "rank", "refs", 10)


def grid_select(spark: SparkSession, sf: str) -> DataFrame:
    rows = _chains(spark, sf).withColumn("p", _path()).withColumn("cl", _clauses())
    return G.grid_select(rows, ["start", "end", "p", "cl"]).select("span", "hops", "cell_rank", "start", "end", F.col("cl").alias("clauses"))


def sample_chains(spark: SparkSession, sf: str) -> DataFrame:
    return G.sample_chains(_chains(spark, sf), 40, "v6").select("start", "end", "depth")


def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return G.round_robin(table(spark, sf, "nation"), "n_name", 60, "t0")


def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return G.balanced_sample(_chains(spark, sf), 12, "v7").select("tier", "k", "start", "end", "depth", _path())


QUERIES = {f.__name__: f for f in (chain_paths, chains_external, chains_by_tier_depth, useful_chains, one_hop_cap, grid_select, sample_chains, round_robin, balanced_sample)}

_E = """n as (select s_suppkey::int as node, s_nationkey::int as ch from supplier),
r as (select node as source, ch, k, ((node * a) % 200 + (node // 200) * 200 + 1)::int as target from n, (values (1, 7), (2, 11), (3, 7)) v(k, a) where k < 3 or node % 2 = 0),
e as (select source, target, case when k = 3 then '7' else 'c' || k end as clause, coalesce(r.ch // 5 <> t.ch // 5, true) as cp, coalesce(r.ch // 5 = t.ch // 5 and r.ch <> t.ch, false) as cc,
  coalesce(r.ch = t.ch, false) as cs, k as hint, t.node is not null as internal from r left join n t on t.node = r.target)"""
_C = f"""with recursive {_E},
c as (
  select source as start, target as "end", [source, target] as path, [clause] as cls, cp, cc, cs, hint, 1 as depth from e where internal and source <> target
  union all
  select start, target, list_append(path, target), list_append(cls, clause), c.cp or e.cp, c.cc or e.cc, c.cs or e.cs, greatest(c.hint, e.hint), depth + 1
  from c join e on e.source = c."end" where depth < 3 and internal and not list_contains(path, target) and e.source <> target),
k as (select *, array_to_string(path, '>') as p, array_to_string(cls, ';') as cl, case when cp then 4 when cc then 3 when cs then 2 else 1 end as tier,
  case when cp then 'cross_doc' when cc or cs then 'intra_doc' else 'local' end as span from c)
"""

ORACLES = {
    "chain_paths": _C + """select start, "end", depth, p as path, cl as clauses, tier, span, case when cp then 4 when depth >= 2 then 3 else 2 end as legacy, hint from k""",
    "chains_external": f"""with recursive {_E},
d as (select distinct source, target, internal from e where source <> target),
c as (select source as start, target as "end", [source, target] as path, 1 as depth, internal from d
  union all select start, target, list_append(path, target), depth + 1, d.internal from c join d on d.source = c."end" where depth < 3 and c.internal and not list_contains(path, target))
select start, "end", depth, array_to_string(path, '>') as path, internal from c""",
    "chains_by_tier_depth": _C + "select tier, depth, count(*) as n from k group by grouping sets ((tier), (depth))",
    "useful_chains": _C + """select depth, count(*) as n from k where not list_has_any(path[2:], [8, 15, 22, 30]) and not (depth = 1 and cls[1] = '7') group by depth""",
    "one_hop_cap": f"""with {_E}, a as (select distinct source % 25 as query, source, target from e),
f as (select query, target as ref, min(source) as s from a where (query, target) not in (select query, source from a) group by query, target),
k as (select *, row_number() over (partition by query order by s, ref) as hop_rank from f) select query, ref, hop_rank from k where hop_rank <= 10""",
    "grid_select": _C + """, o as (select *, row_number() over (partition by start, "end", cl order by span, depth, p) as u from k),
g as (select *, row_number() over (partition by span, depth order by start, "end", p, cl) as cell_rank from o where u = 1)
select span, depth as hops, cell_rank, start, "end", cl as clauses from g where cell_rank <= 15""",
    "sample_chains": _C + """, o as (select distinct start, "end", depth from k), q as (select * from o order by depth, start, "end" limit 500)
select start, "end", depth from q order by md5('v6|' || start || '|' || "end" || '|' || depth) limit 40""",
    "round_robin": """with l as (select n_name, row_number() over (order by md5('t0|' || n_name)) - 1 as at, count(*) over () as len from nation)
select i, n_name, i // len as variant from range(60) r(i) join l on l.at = i % len""",
    "balanced_sample": _C + """, o as (select *, row_number() over (partition by start, "end" order by depth, p) as u, count(*) over () as z from k),
g as (select tier, row_number() over (partition by tier order by md5('v7|' || start || '|' || "end")) as k, start, "end", depth, p as path from o where u = 1) select * from g where k <= 12""",
}
