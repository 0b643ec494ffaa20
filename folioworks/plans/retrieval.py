"""Retrieval queries: benchmark passages against documents, and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import postings as P
from ..operators import retrieve as R
from ..sources.tables import lines, table
from .files import workspace


def _ranked(spark: SparkSession, sf: str, k: int) -> DataFrame:
    docs, queries = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    return R.top_k(R.bm25_scores(docs, "doc_id", queries, "item_id"), docs, "doc_id", queries, "item_id", k)


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, 5).select("query", "doc", "score", "rank")


def index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """[R2][R3] The same by an index that is written and then searched."""
    docs, queries = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    found = P.search(P.write_index(docs, "doc_id", workspace(spark)), queries, "item_id", 5)
    return R.top_k(found.best, docs, "doc_id", queries, "item_id", 5).select("query", "doc", "score", "rank")


def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    docs, queries = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    lines = docs.select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(R.tokens(F.col("text")))).alias("w"))
    first = queries.select(F.col("item_id").alias("query"), F.get(F.array_sort(F.filter(R.tokens(F.col("text")), lambda w: F.length(w) >= 12)), F.lit(0)).alias("w"))
    gold = first.join(lines, "w").select("query", "doc")
    return R.recall_at_k(_ranked(spark, sf, 10), gold, "query", "doc")


def pack_stop(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return R.pack_until_overflow(docs, "source", ["doc_id"], "n_chars", 60_000)


def pack_trunc(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return R.pack_with_tail(docs, "source", ["doc_id"], "n_chars", 40_000, 200, 2_000).select("source", "doc_id", "taken", "overflow")


def middle_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(R.middle_truncated(F.col("text"), 1_000).cast("binary")).alias("digest"))


def cut_joined(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")
    return turns.select("conv_id", F.md5(R.cut_joined(joined, 500, "[cut]").cast("binary")).alias("digest"))


def scope_expand(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("ch"), F.col("n_regionkey").cast("int").alias("pt"))
    sections = table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("section_id"), F.col("s_nationkey").cast("int").alias("ch"), F.col("s_suppkey").cast("int").alias("sec")).join(nations, "ch")
    anchors = nations.select(F.col("ch").alias("query"), "pt", "ch", F.array((F.col("pt") + 1) % 5).alias("parts"))
    return R.full_context_scope(anchors, "query", sections)


def best_strategy(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("q"), (F.col("l_linenumber") % 3).alias("tables"))
    return R.best_strategy(rows, "l_orderkey", "l_returnflag", "l_linenumber", "tables", "q")


def per_tier_limit(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return R.first_per_group(orders, "o_orderpriority", ["o_orderkey"], 3)


def broad_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("section_id"), "text", "source")
    items = docs.select(F.col("source").alias("item"), "section_id", F.col("section_id").alias("pos"))
    return R.broad_sources(items, "item", docs.select("section_id", "text"), 2_000, 20_000).select("item", "section_id", "bytes", "used")


# One row per order and line number.
LINES = """with lines as (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, min(l_quantity) as l_quantity, min(l_returnflag) as l_returnflag,
  min(l_linestatus) as l_linestatus from lineitem group by all)"""

QUERIES = {f.__name__: f for f in (bm25_topk, index_topk, recall_at_k, pack_stop, pack_trunc, middle_truncate, cut_joined, scope_expand, best_strategy, per_tier_limit, broad_sources)}

_BM25 = r"""with w as materialized (select doc_id as doc, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as ts from documents),
t as (select doc, len(ts) as len, unnest(ts) as term from w),
tf as materialized (select doc, len, term, count(*) as tf from t group by all),
z as (select count(*) as n, avg(len(ts)) as avgdl from w),
df as materialized (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) as raw from tf, z group by term),
m as (select avg(raw) as mean from df),
q as (select query, term, count(*) as times from (select item_id as query, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) as term from benchmark) group by all),
s as (select query, doc, round(sum(times * case when raw < 0 then 0.25::double * mean else raw end * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * len / avgdl))), 6) as score
  from q join df using (term) join tf using (term), z, m group by query, doc),
f as (select item_id as query, doc_id as doc from benchmark, (select doc_id from documents order by doc_id limit 10)),
a as (select * from s union all select query, doc, 0 from f where (query, doc) not in (select query, doc from s)),
k as (select *, row_number() over (partition by query order by score desc, doc) as rank from a)
"""

ORACLES = {
    "bm25_topk": _BM25 + "select query, doc, score, rank from k where rank <= 5",
    "index_topk": _BM25 + "select query, doc, score, rank from k where rank <= 5",
    "recall_at_k": _BM25 + """, g as (select query, doc from (select query, min(term) as term from q where length(term) >= 12 group by query) join tf using (term))
select g.query, count(*) as n_gold, count(k.doc) as n_found, count(k.doc)::double / count(*) as recall from g left join (select * from k where rank <= 10) k using (query, doc) group by g.query""",
    "pack_stop": "select * from (select doc_id, source, n_chars, (sum(n_chars) over (partition by source order by doc_id rows unbounded preceding))::bigint as used from documents) where used <= 60000",
    "pack_trunc": """with a as (select source, doc_id, n_chars, coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from documents),
b as (select *, case when before + n_chars <= 40000 then n_chars when before <= 40000 and 40000 - before - 200 > 2000 then least(40000 - before - 200, n_chars) end as taken,
  bool_or(before + n_chars > 40000) over (partition by source) as overflow from a)
select source, doc_id, taken, overflow from b where taken is not null""",
    "middle_truncate": "select doc_id, md5(case when length(text) <= 1000 then text else substr(text, 1, 650) || chr(10) || '[...]' || chr(10) || right(text, 300) end) as digest from documents",
    "cut_joined": """with j as (select conv_id, string_agg(text, chr(10) || chr(10) order by turn, role, text) as t from conversations group by conv_id)
select conv_id, md5(case when length(t) > 500 then substr(t, 1, 500) || '[cut]' else t end) as digest from j""",
    "scope_expand": """with n as (select n_nationkey::int as ch, n_regionkey::int as pt from nation),
s as (select 'S' || s_suppkey as section_id, s_nationkey::int as ch, s_suppkey::int as sec, pt from supplier join n on n.ch = s_nationkey),
a as (select ch as query, pt as a_pt, ch as a_ch, unnest(list_distinct([pt, (pt + 1) % 5])) as pt from n)
select query, section_id, s.pt, s.ch, s.sec, min(case when s.pt = a_pt and s.ch = a_ch then 0 when s.pt = a_pt then 1 else 2 end) as priority
from a join s on a.pt = s.pt group by all""",
    "best_strategy": LINES + """ select l_orderkey, l_returnflag as best from (
  select *, row_number() over (partition by l_orderkey order by l_linenumber % 3 desc, l_quantity::double desc, l_linenumber) as k from lines) where k = 1""",
    "per_tier_limit": "select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by o_orderkey) as k from orders) where k <= 3",
    "broad_sources": """with a as (select source as item, doc_id as section_id, least(strlen(text), 2000)::int as bytes from documents),
b as (select *, (sum(bytes) over (partition by item order by section_id rows unbounded preceding))::bigint as used from a) select * from b where used <= 20000""",
}
