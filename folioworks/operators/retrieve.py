"""Lexical retrieval, budgeted context packing, scopes and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of the queries' terms that are sent to all executors.
BROADCAST_BYTES = 1 << 24


def tokens(text: Column) -> Column:
    """[R1b] Lower-cased words between white space of any kind."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def bm25_scores(docs: DataFrame, doc: str, queries: DataFrame, query: str, text: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """[R2] Okapi scores of all pairs with a term in common: ``(query, doc, score)``.

    Terms that are more frequent than half the documents get ``epsilon`` times the mean raw idf of the vocabulary.
    Repeated query terms count each time. Documents without text are not in the index. Document frequencies are summed
    before they move; term counts are made of the queries' terms alone. If these are at most ``BROADCAST_BYTES`` long, they go
    to all executors, and texts move once, to the task of their document, where all its scores are summed. The number of
    documents, their mean length and the mean idf are one row.
    """
    texts = docs.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    words = lambda rows: rows.select("doc", tokens(F.col("text")).alias("ts"))
    posted = words(texts)
    size = posted.agg(F.count("*").alias("n_docs"), F.avg(F.size("ts")).alias("avgdl"))
    df = posted.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size))
    raw = df.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_raw"))
    asked = queries.select(F.col(query).alias("query"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    wanted = asked.select("term").distinct()
    idf = raw.join(wanted, "term", "left_semi").crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("raw") < 0, epsilon * F.col("mean_raw")).otherwise(F.col("raw")))
    known = asked.join(idf.select("term", "idf", "avgdl"), "term")
    few = (asked.agg(F.sum(F.octet_length("term") + F.octet_length(F.col("query").cast("string")) + 48)).first()[0] or 0) <= BROADCAST_BYTES
    # texts move once, by document: counts, terms met in place and sums need no other shuffle
    terms = words(texts.repartition("doc") if few else texts)
    terms = terms.select("doc", F.size("ts").alias("len"), F.explode("ts").alias("term")).join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    terms = terms.groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))
    hits = terms.join(F.broadcast(known) if few else known, "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return hits.groupBy("query", "doc").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, docs: DataFrame, doc: str, queries: DataFrame, query: str, k: int, digits: int = 6) -> DataFrame:
    """[R3] The k best documents of each query; ties by document, and documents without a hit fill up with score 0."""
    ranked = scores.select("query", "doc", F.round("score", digits).alias("score"))
    first = docs.select(F.col(doc).alias("doc")).orderBy("doc").limit(k)
    # of the k least ids at least as many lack a hit as the query lacks hits; the hits of these few are looked up, not all
    held = ranked.join(F.broadcast(first), "doc", "left_semi").select("query", "doc")
    fill = queries.select(F.col(query).alias("query")).crossJoin(F.broadcast(first)).join(held, ["query", "doc"], "left_anti").withColumn("score", F.lit(0.0))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")
    return ranked.unionByName(fill).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: Parts that a query's documents are packed in before they meet.
SALTS = 64


def _in_reach(ranked: DataFrame, query: str, order: list[str], size: str, cap: int) -> DataFrame:
    """The documents that a cap can reach: by parts of a query's documents, those before the part alone exceeds it.

    What is left out has more than the cap before it, and so has all that follows it, so that sums up to the cap stay
    right; of a query with very many documents hardly any go to the one task that packs them.
    """
    part = Window.partitionBy(query, F.pmod(F.xxhash64(*order), F.lit(SALTS))).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("before", F.coalesce(F.sum(size).over(part), F.lit(0))).where(F.col("before") <= cap).drop("before")


def pack_until_overflow(ranked: DataFrame, query: str, order: list[str], size: str, cap: int) -> DataFrame:
    """[R4] In order, what fits before the first that does not."""
    w = Window.partitionBy(query).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _in_reach(ranked, query, order, size, cap).withColumn("used", F.sum(size).over(w)).where(F.col("used") <= cap)


def pack_with_tail(ranked: DataFrame, query: str, order: list[str], size: str, cap: int, reserve: int = 200, least: int | None = 1000) -> DataFrame:
    """[R5][R6][R7] As above, and the first that doesn't fit is cut to what remains.

    The remainder is ``cap - used - reserve`` and is taken if above ``least`` (full context: 200 and 1000, expanded
    context: 200 and 2000, gold chain: no reserve and no least). ``taken`` is the number of characters, ``overflow``
    marks queries that lost text.
    """
    w = Window.partitionBy(query).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = _in_reach(ranked, query, order, size, cap).withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0)))
    after = F.col("before") + F.col(size)
    room = F.lit(cap) - F.col("before") - reserve
    take = F.when(after <= cap, F.col(size)).when((F.col("before") <= cap) & (room > (least or 0)), F.least(room, F.col(size)))
    rows = rows.withColumn("taken", take).withColumn("overflow", F.max(after > cap).over(Window.partitionBy(query)))
    return rows.where("taken is not null")


def cut_joined(text: Column, cap: int, marker: str) -> Column:
    """[R8] A joined context cut to the cap, marked if it was."""
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit(marker))).otherwise(text)


def middle_truncated(text: Column, most: int, marker: str = "\n[...]\n") -> Column:
    """[R12] The head and the last 30 % of the allowance, with a marker of at most 50 characters between."""
    tail = int(0.3 * most)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - tail - 50), F.lit(marker), F.right(text, F.lit(tail))))


def head_truncated(text: Column, most: int) -> Column:
    """[R13]"""
    return F.substring(text, 1, most)


def document_order(part: str = "pt", chapter: str = "ch", section: str = "sec") -> list[Column]:
    """[R9] Sort keys in document order; what has no number comes last."""
    return [F.coalesce(F.col(c), F.lit(99)) for c in (part, chapter, section)]


def full_context_scope(anchors: DataFrame, query: str, sections: DataFrame, parts: str = "parts") -> DataFrame:
    """[R11] Sections of the anchor's chapter, then the rest of its part, then the other parts involved; each once.

    ``anchors(query, pt, ch, parts array)`` against ``sections(section_id, pt, ch, sec)``.
    """
    wanted = anchors.select(query, F.col("pt").alias("a_pt"), F.col("ch").alias("a_ch"), F.explode(F.array_distinct(F.concat(F.array("pt"), F.coalesce(F.col(parts), F.array().cast("array<int>"))))).alias("pt"))
    rows = wanted.join(sections, "pt")
    priority = F.when((F.col("pt") == F.col("a_pt")) & (F.col("ch") == F.col("a_ch")), 0).when(F.col("pt") == F.col("a_pt"), 1).otherwise(2)
    return rows.groupBy(query, "section_id", "pt", "ch", "sec").agg(F.min(priority).alias("priority"))


def oracle_scope(anchor: Column, path: Column) -> Column:
    """[R10] The source section and the chain's path, each once."""
    return F.array_distinct(F.concat(F.array(anchor), F.coalesce(path, F.array().cast("array<string>"))))


def recall(retrieved: Column, gold: Column) -> Column:
    """[R15][J5] Gold found over gold; null without gold."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(F.array_distinct(gold), retrieved)) / F.size(F.array_distinct(gold)).cast("double"))


def recall_at_k(ranked: DataFrame, gold: DataFrame, query: str, doc: str) -> DataFrame:
    """[R15] The same over rows: one row per query of ``gold``."""
    found = gold.join(ranked.select(query, doc).withColumn("hit", F.lit(1)), [query, doc], "left")
    return found.groupBy(query).agg(F.count("*").alias("n_gold"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*").cast("double")).alias("recall"))


def best_strategy(rows: DataFrame, key: str, strategy: str, position: str, *measures: str) -> DataFrame:
    """[R17] The strategy with the lexicographically largest measures; the first of equals."""
    best = F.max_by(F.col(strategy), F.struct(*measures, (-F.col(position)).alias("early")))
    return rows.groupBy(key).agg(best.alias("best"))


def first_per_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """[R14] n rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def broad_sources(items: DataFrame, item: str, sections: DataFrame, per_section: int = 140_000, in_all: int = 500_000) -> DataFrame:
    """[R18] Every section that an item names, the anchor first, under byte caps per section and in all.

    ``items(item, section_id, pos)`` against ``sections(section_id, text)``; unknown sections are empty.
    """
    rows = items.join(sections, "section_id", "left").withColumn("bytes", F.least(F.octet_length(F.coalesce("text", F.lit(""))), F.lit(per_section)))
    return pack_until_overflow(rows, item, ["pos", "section_id"], "bytes", in_all)
