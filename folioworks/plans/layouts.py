"""Text, layout and table queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import layout as L
from ..operators import ordered as O
from ..operators import tables as T
from ..sources.tables import lines, table
from .pages import _AA, _AC, _E, _I, ON, boxes
from .pages import ORACLES as _PAGES
from .retrieval import LINES

_B = _PAGES["page_envelope"].split(" select page, min(x0)")[0]


def para_merge(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return L.merge_lines(docs, ["doc_id"], "line").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    wide = F.translate(key, "0123456789", "０１２３４５６７８９")
    hashes = X.digests(F.col("s_name"))
    return table(spark, sf, "supplier").select(
        "s_suppkey", X.half_width(wide).alias("half"), X.item_id("B_T1_", F.col("s_suppkey")).alias("item_id"), X.cache_name(F.col("s_name")).alias("cache_name"), X.section_anchor(F.concat(F.lit("Pt5.Ch"), key)).alias("anchor"),
        X.numbered(F.array("s_name", key)).alias("facts"), X.filled("{a} of {b}", a=key, b=F.col("s_name")).alias("prompt"), *(v.alias(k) for k, v in hashes.items()), X.escaped_markdown(F.concat(F.lit("*"), key, F.lit("$"))).alias("escaped"),
    )


def language_guess(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.language_guess(F.col("text")).alias("guess"))


def _grids(spark: SparkSession, sf: str) -> DataFrame:
    cells = lines(spark, sf).select("l_orderkey", F.struct("l_linenumber", F.array("l_returnflag", F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 2 == 0, "").otherwise(F.col("l_linestatus")).alias("s")).alias("row")).alias("r"))
    return cells.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]).alias("grid"))


def _odd_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Grids on both sides of the tests: narrow, wide with fragments or letters, and terms with definitions, some of them not."""
    f, st, p, q, o = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int"), F.col("l_orderkey").cast("int")
    pick = lambda test, a, b: F.when(test, F.lit(a)).otherwise(F.lit(b))
    narrow = F.array(f, p.cast("string"), F.when(p % 2 != 0, st))
    wide = F.array(pick(p % 4 == 0, "x", "word"), pick(p % 3 == 0, "yy", " some  text "), pick(q % 3 == 0, "z", "other"), pick(q % 2 == 0, "12", "number"), pick(o % 3 == 0, "a", "cell one"), pick(o % 5 < 2, "b", "42"), F.lit(""), pick((p + q) % 4 != 0, "c", "long cell"), f)
    terms = F.array(F.concat(pick(p % 7 == 0, "—", "term "), pick(p % 7 == 0, "", "t")), pick(q % 5 == 0, " ", "and so on"), pick(p % 4 == 0, "The class is", ""), pick(q % 6 == 0, "more", ""))
    row = F.when(o % 3 == 0, narrow).when(o % 3 == 1, wide).otherwise(terms)
    head = F.array(F.lit(" Term"), F.lit("Definition "), pick(o % 4 == 1, "Note", "—"), F.lit(None).cast("string"))
    cells = lines(spark, sf).select("l_orderkey", F.struct("l_linenumber", row.alias("row")).alias("r"))
    grids = cells.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]).alias("grid"))
    return grids.withColumn("grid", F.when(o % 3 == 2, F.concat(F.array(head), F.col("grid"))).otherwise(F.col("grid")))


def _shown(grid: Column) -> Column:
    return F.array_join(F.transform(grid, lambda r: F.array_join(r, "|", "~")), "/")


def table_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _odd_grids(spark, sf).select("l_orderkey", T.structure_reason(F.col("grid")).alias("reason"), T.low_quality(F.col("grid")).alias("low"), T.definition_table(F.col("grid")).alias("definitions"))


def definition_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _odd_grids(spark, sf).select("l_orderkey", _shown(T.collapsed_definitions(F.col("grid"))).alias("rows"))


def table_repair(spark: SparkSession, sf: str) -> DataFrame:
    p, q = F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int")
    rest = F.get(F.array(*map(F.lit, ("goes on", "4.2 new rule", "see Table 7 here", "Section two", "", "the Definition of", "12 more", "subsections"))), p % 8)
    row = F.array(F.when(q % 3 == 0, F.lit(" —: ")).when(q % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("key "), q)), rest, F.when(p % 3 == 0, F.lit("and  more")))
    cells = lines(spark, sf).select("l_orderkey", F.struct("l_linenumber", row.alias("row")).alias("r"))
    grids = cells.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]).alias("grid"))
    return grids.select("l_orderkey", _shown(T.repaired_rows(F.col("grid"))).alias("rows"))


# Fixed values of the fixture: texts on both sides of the rules.
_FRAMES = ("Page 12 of DNV AS rules", "page12 by dnv as", "pages 12 of dnv as", "page 3 of dnv", "Class  notation, application and rule reference", "class notation and application", "a 5TR b", "ShisWthTheNotation x", "plain")


def noisy_blocks(spark: SparkSession, sf: str) -> DataFrame:
    line = lines(spark, sf)
    return line.select("l_orderkey", "l_linenumber", T.noisy(F.get(F.array(*map(F.lit, _FRAMES)), (F.col("l_partkey") % len(_FRAMES)).cast("int"))).alias("noisy"))


def table_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return _grids(spark, sf).select("l_orderkey", F.md5(T.grid_markdown(F.col("grid")).cast("binary")).alias("markdown_md5"))


def markdown_table_blocks(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.text_lines(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return T.markdown_blocks(docs, "doc_id").select("doc_id", "first", "last")


def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    a = turns.where("role = 'user'").select("conv_id", "turn", T.similarity_tokens(F.col("text")).alias("ta"))
    b = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("turn_b"), T.similarity_tokens(F.col("text")).alias("tb"))
    return a.join(b, "conv_id").select("conv_id", "turn", "turn_b", F.round(T.overlap_coefficient(F.col("ta"), F.col("tb")), 9).alias("score")).distinct()


def table_choice(spark: SparkSession, sf: str) -> DataFrame:
    c = lambda x, n: (F.col(x) % n).cast("int")
    stats = lines(spark, sf).select("l_orderkey", "l_linenumber", c("l_partkey", 40).alias("wireless_cells"), c("l_suppkey", 37).alias("wired_cells"), c("l_partkey", 23).alias("wireless_filled"), c("l_suppkey", 19).alias("wired_filled"), c("l_partkey", 15).alias("wireless_hits"), c("l_suppkey", 11).alias("wired_hits"))
    return T.arbitration(stats).select("l_orderkey", "l_linenumber", "choice")


def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    cells = T.row_groups(boxes(spark, sf).withColumn("x0", F.col("x0") + F.col("pos") / 100), ON, 10.0)
    return cells.select("page", "pos", "row")


def chars_text(spark: SparkSession, sf: str) -> DataFrame:
    chars = boxes(spark, sf).select("page", F.lit(1).alias("span_ix"), F.col("pos").alias("char_idx"), F.col("kind").alias("ch"), "x0", "x1")
    return L.chars_to_text(chars, ON).select("page", "content")


def parse_mode(spark: SparkSession, sf: str) -> DataFrame:
    pages = lines(spark, sf).select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page"), (F.col("l_partkey") % 90).alias("chars"), (F.col("l_partkey") % 7).alias("cid_chars"), ((F.col("l_partkey") % 10) / 10.0).alias("image_share"))
    return L.parse_mode(pages, "doc")


def list_groups(spark: SparkSession, sf: str) -> DataFrame:
    blocks = boxes(spark, sf).select("page", "pos", F.when(F.col("kind") == "R", "title").otherwise("text").alias("kind"), (F.col("x0") % 5).cast("int").alias("n_lines"))
    return L.list_groups(blocks, ON, "pos").select("page", "pos", "list_group")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("kind") == "R", "title").when(F.col("kind") == "A", "table").otherwise("text")
    return boxes(spark, sf).select(
        F.col("page").alias("doc"), F.lit(0).alias("page"), "pos", kind.alias("kind"), F.concat(F.lit("words "), "pos").alias("text"), (F.col("pos") - 1).alias("level"), F.lit("i.png").alias("image"), F.lit("<table></table>").alias("html"),
        F.when(F.col("pos") % 2 == 0, "cap").otherwise("").alias("caption"), F.when(F.col("pos") % 3 == 0, "note").otherwise("").alias("footnote"), "x0", "y0", "x1", "y1", F.lit(900.0).alias("page_w"), F.lit(700.0).alias("page_h"),
    )


def markdown_pages(spark: SparkSession, sf: str) -> DataFrame:
    shown = _blocks(spark, sf).withColumn("m", L.markdown_block(*(F.col(c) for c in ("kind", "text", "level", "image", "caption", "footnote", "html"))))
    return L.render_markdown(shown, ["doc"], "pos", "m").select("doc", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


def content_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.content_list(_blocks(spark, sf))
    return rows.select("doc", "pos", "type", "text_level", F.array_join(F.transform("bbox", lambda b: b.cast("string")), ",").alias("bbox"), F.size("captions").alias("n_captions"))


# Order-dependent operators: their SQL folds the pairs of a page in order.


def sequential_nms(spark: SparkSession, sf: str) -> DataFrame:
    return O.drop_overlapping(boxes(spark, sf), ON, 0.2)


def smaller_spans(spark: SparkSession, sf: str) -> DataFrame:
    return O.drop_smaller(boxes(spark, sf), ON)


def absorbed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return O.absorb_smaller(boxes(spark, sf), ON)


def united_tables(spark: SparkSession, sf: str) -> DataFrame:
    return O.union_to_fixpoint(boxes(spark, sf), ON, 0.3)


def containers(spark: SparkSession, sf: str) -> DataFrame:
    return O.container_or_children(boxes(spark, sf), ON)


def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return O.xy_cut(boxes(spark, sf), ON)


def captions_by_distance(spark: SparkSession, sf: str) -> DataFrame:
    return O.caption_by_distance(boxes(spark, sf).withColumn("role", F.when(F.col("kind") == "N", "caption").otherwise("body")), ON)


def block_matches(spark: SparkSession, sf: str) -> DataFrame:
    scores = lines(spark, sf).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("table_ix"), (F.col("l_partkey") % 5).cast("int").alias("block_ix"), ((F.col("l_partkey") % 11) / 10.0).alias("score"))
    return O.greedy_one_to_one(scores, "doc")


def grid_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    row = F.concat(F.lit("<tr><td colspan=2>a</td><td rowspan=\"2\">"), "l_returnflag", F.lit("</td></tr><tr><th>c</th><td>d</td></tr>"))
    html = lines(spark, sf).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("table_id"), F.concat(F.lit("<table>"), row, F.lit("</table>")).alias("html"))
    return O.grid_cells(html, "table_id")


def otsl_html(spark: SparkSession, sf: str) -> DataFrame:
    otsl = lines(spark, sf).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("table_id"), F.concat(F.lit("<ched>a<lcel><nl><fcel>"), "l_returnflag", F.lit("<fcel>b<nl><ucel><ecel><nl>")).alias("otsl"))
    return O.otsl_to_html(otsl, "table_id")


QUERIES = {
    f.__name__: f
    for f in (
        para_merge, text_functions, language_guess, table_quality, definition_columns, table_repair, noisy_blocks, table_markdown, markdown_table_blocks, token_overlap, table_choice, table_rows, chars_text, parse_mode, list_groups, markdown_pages, content_list,
        sequential_nms, smaller_spans, absorbed_blocks, united_tables, containers, reading_order, captions_by_distance, block_matches, grid_occupancy, otsl_html,
    )
}

_G = LINES + """, g as (select l_orderkey, l_linenumber as n, l_returnflag as a, l_partkey::varchar as b, case when l_partkey % 2 = 0 then '' else l_linestatus end as c from lines)
"""
# The odd grids, their clean cells, and whether they are of terms.
_Q = LINES + r""", r as (select l_orderkey, l_linenumber, l_orderkey::int % 3 as kind, case l_orderkey::int % 3 when 0 then [l_returnflag, l_partkey::varchar, case when l_partkey % 2 <> 0 then l_linestatus end]
  when 1 then [case when l_partkey % 4 = 0 then 'x' else 'word' end, case when l_partkey % 3 = 0 then 'yy' else ' some  text ' end, case when l_suppkey % 3 = 0 then 'z' else 'other' end, case when l_suppkey % 2 = 0 then '12' else 'number' end,
    case when l_orderkey % 3 = 0 then 'a' else 'cell one' end, case when l_orderkey % 5 < 2 then 'b' else '42' end, '', case when (l_partkey + l_suppkey) % 4 <> 0 then 'c' else 'long cell' end, l_returnflag]
  else [case when l_partkey % 7 = 0 then '—' else 'term t' end, case when l_suppkey % 5 = 0 then ' ' else 'and so on' end, case when l_partkey % 4 = 0 then 'The class is' else '' end, case when l_suppkey % 6 = 0 then 'more' else '' end] end as row from lines),
g as (select l_orderkey, any_value(kind) as kind, list(row order by l_linenumber) as rows from r group by l_orderkey),
h as (select l_orderkey, case when kind = 2 then list_concat([[' Term', 'Definition ', case when l_orderkey::int % 4 = 1 then 'Note' else '—' end, null]], rows) else rows end as grid from g),
c as (select *, list_max(list_transform(grid, lambda r: len(r))) as n_cols, list_transform(grid, lambda r: list_transform(r, lambda x: trim(regexp_replace(coalesce(x, ''), '\s+', ' ', 'g')))) as c from h),
z as (select *, list_filter(flatten(c), lambda x: x <> '') as solid, coalesce(lower(c[1][1]) = 'term' and lower(c[1][2]) = 'definition' and not regexp_matches(array_to_string(c[1][3:], ' '), '[A-Za-z0-9]') and len(c) > 1
  and len(list_filter(c[2:], lambda r: array_to_string(r[3:], '') <> '')) <= greatest(1, trunc((len(c) - 1) * 0.25::double)) and len(list_filter(c[2:], lambda r: r[1] <> '' and r[2] <> '')) >= greatest(2, trunc((len(c) - 1) * 0.4::double)), false) as terms from c)
"""
_K = _B + """, k as (select page as doc, pos, case kind when 'R' then 'title' when 'A' then 'table' else 'text' end as kind, pos - 1 as level, case when pos % 2 = 0 then 'cap' else '' end as cap,
  case when pos % 3 = 0 then 'note' else '' end as note, x0, y0, x1, y1 from b)
"""

# The places that go, by folding ordered pairs of (first, second, loser or 0) of which both are still there.
_GONE = "list_reduce(ps, lambda acc, p: case when p[3] > 0 and not list_contains(acc, p[1]) and not list_contains(acc, p[2]) then list_append(acc, p[3]) else acc end, []::int[])"
_IOU = f"{_I} / ({_AA} + {_AC} - {_I})"
_GOES = "list_transform(acc, lambda y: case when y % 100 = 0 then y // 100 else y % 100 end)"

ORACLES = {
    "para_merge": r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
o as (select doc_id, n, regexp_replace(t, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') as own, lead(t) over (partition by doc_id order by n) as nx from l),
b as (select doc_id, n, case when own = '' then '' when not regexp_matches(own, '[A-Za-z]+-\s*$') then own || ' ' when regexp_matches(coalesce(nx, ''), '^\p{Ll}') then regexp_replace(own, '-$', '') else own end as bit from o)
select doc_id, md5(regexp_replace(string_agg(bit, '' order by n), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) as text_md5 from b group by doc_id""",
    "text_functions": r"""select s_suppkey, s_suppkey::varchar as half, 'B_T1_' || lpad(s_suppkey::varchar, greatest(4, length(s_suppkey::varchar))::int, '0') as item_id, regexp_replace(s_name, '[^a-zA-Z0-9_]', '_', 'g') as cache_name,
  'pt5-ch' || s_suppkey as anchor, '1. ' || s_name || chr(10) || '2. ' || s_suppkey as facts, s_suppkey || ' of ' || s_name as prompt, upper(md5(s_name)) as md5_upper, md5(s_name) as md5, sha256(s_name) as sha256,
  left(sha256(s_name), 16) as request, left(sha256(s_name), 8) as response, '\*' || s_suppkey || '\$' as escaped from supplier""",
    "language_guess": "select doc_id, case when regexp_matches(text, '[^\\s]') then 'en' else '' end as guess from documents",
    "table_quality": _Q + r"""
select l_orderkey, case when len(grid) < 2 then 'too_few_rows' when n_cols < 2 then 'too_few_columns' when len(solid) < 4 then 'too_few_cells' when len(list_filter(c, lambda r: len(list_filter(r, lambda x: x <> '')) >= 2)) < 2 then 'too_few_full_rows' else 'ok' end as reason,
  len(solid) = 0 or (n_cols >= 8 and len(list_filter(solid, lambda x: length(x) <= 2)) / len(solid)::double > 0.55::double)
    or (n_cols >= 8 and len(list_filter(solid, lambda x: regexp_full_match(x, '[A-Za-z]'))) / greatest(len(list_filter(solid, lambda x: regexp_matches(x, '[A-Za-z]'))), 1)::double > 0.35::double) as low, terms as definitions from z""",
    "definition_columns": _Q + r"""
select l_orderkey, array_to_string(case when not terms or n_cols <= 2 then list_transform(grid, lambda r: array_to_string(list_transform(r, lambda x: coalesce(x, '~')), '|'))
  else list_concat(['Term|Definition'], list_transform(c[2:], lambda r: r[1] || '|' || array_to_string(list_concat(list_filter(r[2:], lambda x: x <> '' and (regexp_matches(x, '(?i)^(a|an|the|class|assignment|verbal)\b') or regexp_matches(x, '^[A-Z]'))),
    list_filter(r[2:], lambda x: x <> '' and not (regexp_matches(x, '(?i)^(a|an|the|class|assignment|verbal)\b') or regexp_matches(x, '^[A-Z]')))), ' '))) end, '/') as rows from z""",
    "table_repair": LINES + r""", r as (select l_orderkey, l_linenumber, [case l_suppkey::int % 3 when 0 then '—:' when 1 then '' else 'key ' || l_suppkey::int end, ['goes on', '4.2 new rule', 'see Table 7 here', 'Section two', '', 'the Definition of', '12 more', 'subsections'][l_partkey::int % 8 + 1],
  case when l_partkey::int % 3 = 0 then 'and more' else '' end] as row from lines),
g as (select l_orderkey, list([row] order by l_linenumber) filter (array_to_string(row, '') <> '') as rows from r group by l_orderkey),
x as (select l_orderkey, list_reduce(rows, lambda kept, new: case
  when regexp_full_match(new[1][1], '[-–—|:;.,_~`]*') and trim(new[1][2] || new[1][3]) <> '' and kept[-1][1] <> ''
    and not regexp_matches(lower(trim(new[1][2] || ' ' || new[1][3])), '\b(table\s+\d+|class notation|description|application|rule reference|term|definition)\b|^\d+(\.\d+)+\b|^section |^chapter ')
  then list_concat(kept[:-2], [[kept[-1][1], trim(kept[-1][2] || ' ' || trim(new[1][2] || ' ' || new[1][3])), kept[-1][3]]]) else list_concat(kept, new) end) as rows from g)
select r.l_orderkey, coalesce(array_to_string(list_transform(rows, lambda r: array_to_string(r, '|')), '/'), '') as rows from (select distinct l_orderkey from r) r left join x using (l_orderkey)""",
    "noisy_blocks": LINES + f", t as (select l_orderkey, l_linenumber, lower(regexp_replace(({list(_FRAMES)}::varchar[])[l_partkey % {len(_FRAMES)} + 1], '\\s+', ' ', 'g')) as t from lines)"
    + r""" select l_orderkey, l_linenumber, (regexp_matches(t, '\bpage\s*\d+\b') and regexp_matches(t, '\bdnv as\b')) or (regexp_matches(t, '\bclass notation\b') and regexp_matches(t, '\bapplication\b') and regexp_matches(t, '\brule reference\b'))
  or contains(t, '5tr') or contains(t, 'shiswththenotation') as noisy from t""",
    "table_markdown": _G + """, m as (select l_orderkey, n, '| ' || a || ' | ' || b || ' | ' || c || ' |' as t, row_number() over (partition by l_orderkey order by n) as k from g)
select l_orderkey, md5(string_agg(t || case when k = 1 then chr(10) || '| --- | --- | --- |' else '' end, chr(10) order by n)) as markdown_md5 from m group by l_orderkey""",
    "markdown_table_blocks": """with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents),
p as (select doc_id, line, line - row_number() over (partition by doc_id order by line) as run from l where contains(t, '|'))
select doc_id, min(line)::int as first, max(line)::int as last from p group by doc_id, run having count(*) >= 2""",
    "token_overlap": """with t as (select conv_id, turn, role, list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 3)) as w from conversations)
select distinct a.conv_id, a.turn, b.turn as turn_b, round(case when least(len(a.w), len(b.w)) > 0 then len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::double else 0 end, 9) as score
from t a join t b using (conv_id) where a.role = 'user' and b.role = 'assistant'""",
    "table_choice": LINES + """, s as (select l_orderkey, l_linenumber, l_partkey % 40 as a, l_suppkey % 37 as b, l_partkey % 23 as fa, l_suppkey % 19 as fb, l_partkey % 15 as ha, l_suppkey % 11 as hb, round_even(sqrt(l_suppkey % 19), 0) as s from lines)
select l_orderkey, l_linenumber, case when (fa > fb and fa + 3 >= greatest(fb + 2 * s, s * (s + 2))) or (a - b between 0 and 5 and b <= round_even(a * 0.75::double, 0)) or (a = b and b <= 4) or (hb <= 0.6::double * ha and ha >= 10) then 'wireless' else 'wired' end as choice from s""",
    "table_rows": _B + """, o as (select page, pos, y0, x0, case when abs(y0 - lag(y0) over (partition by page order by y0, x0 + pos / 100.0::double)) <= 10 then 0 else 1 end as o from b)
select page, pos, (sum(o) over (partition by page order by y0, x0 + pos / 100.0::double rows unbounded preceding) - 1)::bigint as row from o""",
    "chars_text": _B + """, m as (select page, median(x1 - x0) as m from b group by page),
g as (select b.page, pos, kind || case when lead(x0) over (partition by b.page order by pos) - x1 > 0.25::double * m.m then ' ' else '' end as bit from b join m on m.page = b.page)
select page, string_agg(bit, '' order by pos) as content from g group by page""",
    "parse_mode": LINES + """, p as (select l_suppkey as doc, l_orderkey * 10 + l_linenumber as page, l_partkey % 90 as chars, l_partkey % 7 as cids, (l_partkey % 10) / 10.0::double as share from lines),
k as (select *, row_number() over (partition by doc order by md5(doc || '|' || page)) as k from p)
select doc, case when avg(chars) < 50 or sum(cids)::double / greatest(sum(chars), 1) > 0.05 or avg((share >= 0.8)::int) >= 0.8 then 'ocr' else 'txt' end as mode from k where k <= 10 group by doc""",
    "list_groups": _B + """, g as (select page, pos, kind, (x0 % 5)::int as n, sum((kind = 'R')::int) over (partition by page order by pos rows unbounded preceding) as grp from b)
select page, pos, kind <> 'R' and count(*) filter (kind <> 'R') over w > 1 and bool_and(n <= 3) filter (kind <> 'R') over w as list_group from g window w as (partition by page, grp)""",
    "markdown_pages": _K + """, m as (select doc, pos, case kind when 'title' then case when level > 0 then repeat('#', least(level, 4)) || ' ' else '' end || 'words ' || pos
  when 'table' then concat_ws('  ' || chr(10), nullif(cap, ''), '<table></table>', nullif(note, '')) else 'words ' || pos end as m from k)
select doc, md5(string_agg(m, chr(10) || chr(10) order by pos)) as markdown_md5 from m group by doc""",
    "content_list": _K + """select doc, pos, case kind when 'title' then 'text' else kind end as type, case when kind = 'title' and level > 0 then least(level, 4) end as text_level,
  trunc(x0 * 1000 / 900)::int || ',' || trunc(y0 * 1000 / 700)::int || ',' || trunc(x1 * 1000 / 900)::int || ',' || trunc(y1 * 1000 / 700)::int as bbox, (cap <> '')::int as n_captions from k""",
    "sequential_nms": _B + f""", p as (select a.page, list([a.pos, c.pos, case when {_IOU} > 0.2::double then case when a.score < c.score then a.pos else c.pos end else 0 end] order by a.pos, c.pos) as ps
  from b a join b c on a.page = c.page and a.pos < c.pos group by a.page),
g as (select page, {_GONE} as gone from p) select b.* from b left join g using (page) where not coalesce(list_contains(gone, pos), false)""",
    "smaller_spans": _B + f""", p as (select a.page, list([a.pos, c.pos, case when {_I} / least({_AA}, {_AC}) > 0.65::double then case when {_AA} <= {_AC} then a.pos else c.pos end else 0 end] order by a.pos, c.pos) as ps
  from b a join b c on a.page = c.page and a.pos < c.pos group by a.page),
g as (select page, {_GONE} as gone from p) select b.* from b left join g using (page) where not coalesce(list_contains(gone, pos), false)""",
    "containers": _B + f""", i as (select a.page, a.pos, list(c.pos) filter (a.pos <> c.pos and {_I} > 0 and {_I} >= 0.8::double * {_AC}) as inner_pos from b a join b c on a.page = c.page group by a.page, a.pos),
p as (select page, list([pos] order by pos) as ps, map(list(pos), list(score)) as score, map(list(i.pos), list(coalesce(inner_pos, []))) as inners from b join i using (page, pos) group by page),
-- what happens, as 100 i for a container that goes, and 100 i + j for what i takes in
f as (select page, list_reduce(ps, lambda acc, k: case when list_contains({_GOES}, k[1]) or len(list_filter(inners[k[1]], lambda x: not list_contains({_GOES}, x))) < 2 then acc
  when score[k[1]] > list_avg(list_transform(list_filter(inners[k[1]], lambda x: not list_contains({_GOES}, x)), lambda x: score[x])) then list_concat(acc, list_transform(list_filter(inners[k[1]], lambda x: not list_contains({_GOES}, x)), lambda x: k[1] * 100 + x))
  else list_append(acc, k[1] * 100) end, []::int[]) as acc from p),
u as (select a.page, a.pos, min(least(a.x0, c.x0)) as x0, min(least(a.y0, c.y0)) as y0, max(greatest(a.x1, c.x1)) as x1, max(greatest(a.y1, c.y1)) as y1 from b a join f on a.page = f.page join b c on a.page = c.page and (c.pos = a.pos or list_contains(acc, a.pos * 100 + c.pos)) group by a.page, a.pos)
select u.*, b.score, b.kind from u join b using (page, pos) join f using (page) where not list_contains({_GOES}, pos)""",
    "block_matches": LINES + """, s as (select l_orderkey as doc, l_linenumber::int as t, (l_partkey % 5)::int as b, (l_partkey % 11) / 10.0::double as score from lines),
p as (select doc, list([t, b] order by t) as ps, map(list(t), list(score)) as score from s group by doc),
g as (select doc, list_reduce(ps, lambda acc, x: case when score[x[1]] >= 0.6::double and not list_contains(list_transform(acc, lambda y: y % 100), x[2]) then list_append(acc, x[1] * 100 + x[2]) else acc end, []::int[]) as kept from p)
select doc, t as table_ix, b as block_ix, score from s join g using (doc) where list_contains(kept, t * 100 + b)""",
    "grid_occupancy": LINES + """ select l_orderkey * 10 + l_linenumber as table_id, r0, r1, c0, c1, coalesce(text, l_returnflag) as text, header from lines, (values (0, 0, 0, 1, 'a', false), (0, 1, 2, 2, null, false), (1, 1, 0, 0, 'c', true), (1, 1, 1, 1, 'd', false)) v(r0, r1, c0, c1, text, header)""",
    "otsl_html": LINES + """ select l_orderkey * 10 + l_linenumber as table_id, '<table><tr><th colspan="2">a</th></tr><tr><td rowspan="2">' || l_returnflag || '</td><td>b</td></tr><tr><td></td></tr></table>' as html from lines""",
}
