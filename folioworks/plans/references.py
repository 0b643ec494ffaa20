"""Reference extraction over section texts written from line items, and over page links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import refs as R
from ..sources.tables import lines, table
from .retrieval import LINES


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """One section per order; its line items name other sections in the three forms in turn."""
    line = lines(spark, sf).select("l_orderkey", "l_linenumber", *(F.col(c).cast("int").alias(c) for c in ("l_partkey", "l_suppkey")), "l_returnflag")
    p, c, s = F.col("l_suppkey") % 5 + 1, F.col("l_partkey") % 20 + 1, F.col("l_partkey") % 97 + 1
    clause = F.concat(F.lit(" ["), "l_returnflag", F.lit("."), "l_linenumber", F.lit("]"))
    form = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Pt."), p, F.lit(" Ch."), c, F.lit(" Sec."), s, clause)).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("Sec."), s, clause))
    form = form.otherwise(F.concat(F.lit("Ch."), c, F.lit(" Sec."), s))
    gap = F.repeat(F.lit(" "), F.col("l_partkey") % 2 + 1)
    bits = line.select("l_orderkey", F.struct("l_linenumber", F.concat(F.lit("as given in "), form, gap, F.lit("and so on. ")).alias("bit")).alias("b"))
    texts = bits.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("b"))["bit"], "").alias("text"))
    key = F.col("l_orderkey").cast("int")
    return texts.select((key % 5 + 1).alias("pt"), (key % 20 + 1).alias("ch"), (key % 97 + 1).alias("sec"), F.concat(F.lit("N"), key.cast("string")).alias("section_id"), "text")


def xref_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = R.corpus1_edges(sections(spark, sf))
    return edges.select("source", "target_clause", "raw", "pattern_no", "crosses_part", "crosses_chapter", "crosses_section", "char_offset")


def xref_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_edges(R.corpus1_edges(sections(spark, sf)), ["source", "target_clause"]).select("source", "target_clause", "pattern_no", "char_offset")


def xref_context(spark: SparkSession, sf: str) -> DataFrame:
    return R.corpus1_edges(sections(spark, sf)).select("source", "pattern_no", "char_offset", F.md5(F.col("context").cast("binary")).alias("context_md5"))


def clause_context(spark: SparkSession, sf: str) -> DataFrame:
    return sections(spark, sf).select("section_id", R.clause_window(F.col("text"), F.lit("R.1"), 40).alias("window"))


def loose_references(spark: SparkSession, sf: str) -> DataFrame:
    own = sections(spark, sf)
    refs = R.loose_references(F.col("text"), F.col("pt"), F.col("ch"), R.canonical(F.col("pt"), F.col("ch"), F.col("sec")))
    return own.select("section_id", F.array_join(refs, "|").alias("refs"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "html")
    found = R.find_all(pages, R.Pattern(9, r'href="([^"]*)"', 1), "html")
    return found.select("page_id", F.col("g1").alias("href"), "char_offset")


# Questions on both sides of every pattern.
_LEAKY = (
    "Under § 217.3(a)(1), ", "According  to 12CFR 225, ", "see subpart b and paragraph (c)(2)(iv) ", "Section 217 says ", "section 2170 says ", "Part217 has ", "apart 217 ", "(a ) ( 1 of ", "( 2)( iv ) ",
    "as  defined in ", "thunder § x ", "sub part A ", "subpart K ", "paragraphs (a) ", "accordingto ", "has defined in ", "12 cfr of sec.217 ", "Sec 217.5 ", "what ",
)


def leak_scan(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    form = F.get(F.array(*map(F.lit, _LEAKY)), (F.col("l_partkey") % len(_LEAKY)).cast("int"))
    text = F.concat(F.lit("Q: "), form, F.lit("holds for "), "l_suppkey", F.lit("?"))
    return line.select("l_orderkey", "l_linenumber", F.array_join(R.leak_scan(text), "|").alias("leaks"))


def part_sections(spark: SparkSession, sf: str) -> DataFrame:
    """One section per order, in ten subparts, and two appendices; line items name others in five forms."""
    line = lines(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("int").alias("p"), F.col("l_suppkey").cast("int").alias("s"))
    p, s, n = F.col("p"), F.col("s"), F.col("l_linenumber") % 6
    form = (
        F.when(n == 0, F.concat(F.lit("§ 217."), p, F.when(p % 2 == 0, "(a)(1)").otherwise("(A)(1)"))).when(n == 1, F.concat(F.lit("12 CFR part "), s % 5 + 214))
        .when(n == 2, F.concat(F.when(s % 2 == 0, "subpart ").otherwise("Subpart "), F.when(s % 3 == 0, F.char(p % 12 + 97)).otherwise(F.char(p % 12 + 65)), F.lit(" of this part")))
        .when(n == 3, F.concat(F.lit("appendix "), F.char(s % 4 + 65), F.when(p % 2 == 0, " to this part").otherwise(" of part"))).when(n == 4, F.lit("paragraph (b)(2) of this section"))
        .otherwise(F.concat(F.lit("12 CFR "), s % 5 + 214, F.lit("."), p % 50))
    )
    bits = line.select("l_orderkey", F.struct("l_linenumber", F.concat(F.lit("see "), form, F.lit(" too. ")).alias("bit")).alias("b"))
    texts = bits.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("b"))["bit"], "").alias("text"))
    key = F.col("l_orderkey").cast("int")
    part = F.char(key % 10 + 65)
    own = texts.select(F.concat(F.lit("Pt217.Subpart"), part, F.lit(".Sec217."), key).alias("section_id"), part.alias("subpart"), key.cast("string").alias("sec"), F.lit(None).cast("string").alias("appendix"), "text")
    appendices = spark.createDataFrame([("Pt217.AppendixA", None, None, "A", ""), ("Pt217.AppendixC", None, None, "C", "")], own.schema)
    return own.unionByName(appendices)


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    return R.corpus2_edges(part_sections(spark, sf)).select("source", "target", "kind", "tier_hint", "raw", "paragraphs", "char_offset", "pattern_no", F.md5(F.col("context").cast("binary")).alias("context_md5"))


def marker_scan(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return turns.select("conv_id", "turn", "role", R.marker_scan(F.col("text"), ["éren", "THAT"], F.lit(20)).alias("hit"))


QUERIES = {f.__name__: f for f in (xref_edges, xref_dedup, xref_context, clause_context, loose_references, page_links, leak_scan, marker_scan, part_edges)}

# The edges follow from the line items; places from the lengths of the bits before.
_LINES = LINES + """, l as (select l_orderkey::int as k, l_linenumber as n, l_suppkey::int % 5 + 1 as p, l_partkey::int % 20 + 1 as c, l_partkey::int % 97 + 1 as s, l_returnflag || '.' || l_linenumber as clause from lines),
f as (select l.*, case n % 3 when 0 then 'Pt.' || p || ' Ch.' || c || ' Sec.' || s || ' [' || clause || ']' when 1 then 'Sec.' || s || ' [' || clause || ']' else 'Ch.' || c || ' Sec.' || s end as form, repeat(' ', l_partkey::int % 2 + 1) as gap
  from l join (select l_orderkey::int as k, l_linenumber as n, l_partkey from lines) using (k, n)),
o as (select *, case when n % 3 = 2 then form || gap else form end as raw, 'as given in ' || form || gap || 'and so on. ' as bit,
  coalesce(sum(length(form) + length(gap) + 23) over (partition by k order by n rows between unbounded preceding and 1 preceding), 0) + 12 as off, k % 5 + 1 as pt, k % 20 + 1 as ch, k % 97 + 1 as sec from f),
x as (select *, case when n % 3 = 0 then 'Pt' || p || '.Ch' || c || '.Sec' || s || '.[' || clause || ']' when n % 3 = 1 then 'Pt' || pt || '.Ch' || ch || '.Sec' || s || '.[' || clause || ']' else 'Pt' || pt || '.Ch' || c || '.Sec' || s end as tc,
  case n % 3 when 0 then 1 when 1 then 2 else 3 end as pat from o where n % 3 = 0 or (n % 3 = 1 and s <> sec) or (n % 3 = 2 and c <> ch)),
t as (select k, string_agg(bit, '' order by n) as text, any_value(pt) as pt, any_value(ch) as ch, any_value(sec) as sec from o group by k)
"""

ORACLES = {
    "xref_edges": _LINES + """select 'N' || k as source, tc as target_clause, raw, pat as pattern_no,
  pat = 1 and p <> pt as crosses_part, (pat = 1 and p = pt and c <> ch) or pat = 3 as crosses_chapter, (pat = 1 and p = pt and c = ch and s <> sec) or pat = 2 as crosses_section, off::int as char_offset from x""",
    "xref_dedup": _LINES + """select source, target_clause, pattern_no, char_offset from (
  select 'N' || k as source, tc as target_clause, pat as pattern_no, off::int as char_offset, row_number() over (partition by k, tc order by pat, off) as r from x) where r = 1""",
    "xref_context": _LINES + """select 'N' || x.k as source, pat as pattern_no, off::int as char_offset,
  md5(trim(substr(text, greatest(off - 200, 0)::int + 1, (off + length(raw) + 200 - greatest(off - 200, 0))::int))) as context_md5 from x join t on x.k = t.k""",
    "clause_context": _LINES + """, w as (select k, text, case when strpos(text, '[R.1]') > 0 then strpos(text, '[R.1]') when strpos(text, 'R.1') > 0 then strpos(text, 'R.1') end as spot from t)
select 'N' || k as section_id, substr(text, greatest(spot - 41, 0) + 1, spot - 1 + 3 + 40 - greatest(spot - 41, 0)) as "window" from w""",
    "loose_references": _LINES + """, y as (
  select k, 'Pt' || p || '.Ch' || c || '.Sec' || s as r from o where n % 3 = 0 union select k, 'Pt' || pt || '.Ch' || ch || '.Sec' || s from o where n % 3 = 1
  union select k, 'Pt' || pt || '.Ch' || c || '.Sec' || s from o where n % 3 <> 1),
w as (select distinct k, 'Pt' || pt || '.Ch' || ch || '.Sec' || sec as own from o)
select 'N' || w.k as section_id, coalesce((select string_agg(r, '|' order by r) from y where y.k = w.k and r <> own), '') as refs from w""",
    "page_links": """with h as (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 0) as m, regexp_extract_all(html, 'href="([^"]*)"', 1) as g, string_split_regex(html, 'href="[^"]*"') as p from pages),
e as (select page_id, m, g, p, unnest(range(1, len(m) + 1)) as i from h)
select page_id, g[i] as href, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::int as char_offset from e""",
    "leak_scan": f"""with q as (select l_orderkey, l_linenumber, 'Q: ' || ({list(_LEAKY)}::varchar[])[l_partkey % {len(_LEAKY)} + 1] || 'holds for ' || l_suppkey || '?' as t from lineitem)
"""
    + r"""select l_orderkey, l_linenumber, array_to_string(list_filter([regexp_extract(t, '(?i)§\s*\d'), regexp_extract(t, '(?i)\bSec(?:tion)?\.?\s*217\b'), regexp_extract(t, '(?i)\bPart\s*217\b'), regexp_extract(t, '(?i)12\s*CFR'),
  regexp_extract(t, '(?i)\bSubpart\s+[A-J]\b'), regexp_extract(t, '(?i)\bparagraph\s*\('), regexp_extract(t, '(?i)\(\s*[a-z]\s*\)\s*\(\s*\d'), regexp_extract(t, '(?i)\(\s*\d+\s*\)\s*\(\s*[ivx]+\s*\)'),
  regexp_extract(t, '(?i)\baccording\s+to\b'), regexp_extract(t, '(?i)\bunder\s+§'), regexp_extract(t, '(?i)\bas\s+defined\s+in')], lambda x: x <> ''), '|') as leaks from q""",
    "part_edges": LINES + r""", l as (select l_orderkey::int as k, l_linenumber as n, l_partkey::int as p, l_suppkey::int as s from lines),
f as (select *, case n % 6 when 0 then '§ 217.' || p || case when p % 2 = 0 then '(a)(1)' else '(A)(1)' end when 1 then '12 CFR part ' || (s % 5 + 214)
  when 2 then case when s % 2 = 0 then 'subpart ' else 'Subpart ' end || chr(p % 12 + case when s % 3 = 0 then 97 else 65 end) || ' of this part'
  when 3 then 'appendix ' || chr(s % 4 + 65) || case when p % 2 = 0 then ' to this part' else ' of part' end when 4 then 'paragraph (b)(2) of this section' else '12 CFR ' || (s % 5 + 214) || '.' || p % 50 end as form from l),
o as (select *, chr(k % 10 + 65) as sub, coalesce(sum(length(form) + 10) over (partition by k order by n rows between unbounded preceding and 1 preceding), 0) + 4 as off from f),
t as (select k, string_agg('see ' || form || ' too. ', '' order by n) as text from o group by k),
i as (select k as t, chr(k % 10 + 65) as tsub, 'Pt217.Subpart' || chr(k % 10 + 65) || '.Sec217.' || k as id from (select distinct k from l)),
m as (select tsub, min(id) as id from i group by tsub),
e as (
  select o.k, off, i.id as target, case when i.t = o.k then 'same_section' when tsub = sub then 'same_subpart' else 'cross_subpart' end as kind, case when i.t = o.k then 1 when tsub = sub then 2 else 3 end as tier_hint,
    case when p % 2 = 0 then form else regexp_replace(form, '\(A\)\(1\)$', '') end as raw, case when p % 2 = 0 then '(a)(1)' else '' end as paragraphs, 4 as pattern_no from o join i on i.t = p where n % 6 = 0
  union all select k, off, 'Pt' || (s % 5 + 214) || case when n % 6 = 5 then '.Sec' || (s % 5 + 214) || '.' || p % 50 else '' end, 'cross_part', 4, form, '', 5 from o where n % 6 in (1, 5) and s % 5 <> 3
  union all select k, off, m.id, 'subpart_rep', 3, form, '', 6 from o join m on m.tsub = chr(p % 12 + 65) where n % 6 = 2 and s % 3 <> 0 and m.tsub <> sub
  union all select k, off, 'Pt217.Appendix' || chr(s % 4 + 65), 'appendix_ref', 3, form, '', 7 from o where n % 6 = 3 and s % 4 in (0, 2)
  union all select k, off, 'Pt217.Subpart' || sub || '.Sec217.' || k, 'same_section_paragraph', 1, form, '(b)(2)', 8 from o where n % 6 = 4)
select 'Pt217.Subpart' || chr(e.k % 10 + 65) || '.Sec217.' || e.k as source, target, kind, tier_hint, raw, paragraphs, off::int as char_offset, pattern_no,
  md5(trim(substr(text, greatest(off - 200, 0)::int + 1, (off + length(raw) + 200 - greatest(off - 200, 0))::int))) as context_md5 from e join t using (k)""",
    "marker_scan": """select conv_id, turn, role, (strpos(lower(text), 'éren') - 1 >= 20) or (strpos(lower(text), 'that') - 1 >= 20) as hit from conversations""",
}
