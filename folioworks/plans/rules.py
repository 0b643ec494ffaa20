"""Rules of pages, spans, tables and texts that other plans don't reach, over fixtures on both sides of each condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model_calls as M
from ..functions import text as X
from ..operators import geometry as G
from ..operators import items as I
from ..operators import layout as L
from ..operators import ordered as O
from ..operators import retrieve as R
from ..operators import tables as T
from ..operators import taskqueue as Q
from ..sources.tables import lines, table
from .pages import _AA, _AC, _B, _E, _I, ON, boxes
from .retrieval import LINES


def _choice(values: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def _sql_choice(values: tuple[str, ...], number: str) -> str:
    return "(['" + "', '".join(v.replace("'", "''") for v in values) + f"'])[{number} % {len(values)} + 1]"


def confident_boxes(spark: SparkSession, sf: str) -> DataFrame:
    rows = boxes(spark, sf).withColumn("x1", F.when(F.col("pos") % 4 == 0, F.col("x0")).otherwise(F.col("x1")))
    return L.confident(rows, 0.3).select("page", "pos")


def unreleased_items(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("in_paper_analysis"))
    return I.not_released(orders, orders.where("o_orderkey % 3 = 0"), "o_orderkey").select("o_orderkey")


_MARKS = (".", "(", "a", "-", "【", "b", "。")


def char_spans(spark: SparkSession, sf: str) -> DataFrame:
    line = lines(spark, sf).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int").alias("pos"), F.col("l_partkey").cast("int").alias("p"), F.col("l_suppkey").cast("int").alias("s"))
    n = lambda c: c.cast("double")
    spans = line.where("pos % 2 = 1").select("page", F.col("pos").alias("span_ix"), F.lit(0.0).alias("x0"), n(10 * F.col("pos")).alias("y0"), F.lit(100.0).alias("x1"), n(10 * F.col("pos") + 12).alias("y1"))
    x, y = F.col("p") % 125 - 15, 10 * (F.col("s") % 8) + F.col("p") % 7
    chars = line.where("pos % 2 = 0").select("page", F.col("pos").alias("char_idx"), _choice(_MARKS, F.col("s")).alias("ch"), n(x).alias("x0"), n(y).alias("y0"), n(x + 9).alias("x1"), n(y + 8).alias("y1"))
    return G.assign_chars(chars, spans, ON, 12.0)


_SPANS = ("text", "inline_equation", "interline_equation", "image", "table", "other")
_BLOCKS = ("text", "title", "list", "index", "image_caption", "image_footnote", "table_caption", "table_footnote", "discarded", "interline_equation", "image_body", "table_body")


def span_block_fit(spark: SparkSession, sf: str) -> DataFrame:
    kinds = lines(spark, sf).select(_choice(_SPANS, F.col("l_partkey")).alias("span"), _choice(_BLOCKS, F.col("l_suppkey")).alias("block")).distinct()
    return kinds.select("span", "block", L.span_fits_block(F.col("span"), F.col("block")).alias("fits"))


def ocr_rules(spark: SparkSession, sf: str) -> DataFrame:
    """[F20][F21][F22]"""
    p, s, q = F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int"), F.col("l_quantity").cast("int")
    garbage = L.ocr_garbage(_choice(("口", "word", "l"), p), (s % 11) / 10.0, p % 9, s % 7, ["口", "l"])
    routed = L.vlm_ocr(F.when(p % 2 == 0, "ocr").otherwise("txt"), _choice(("ch", "en", "fr"), s), q % 3 != 0)
    forced = L.vlm_ocr(F.lit("txt"), F.lit("fr"), F.lit(False), F.when(p % 5 == 0, True).when(p % 5 == 1, False))
    return lines(spark, sf).select("l_orderkey", "l_linenumber", garbage.alias("garbage"), routed.alias("routed"), forced.alias("forced"), L.low_contrast((p % 40).cast("double"), (100 + s % 100).cast("double")).alias("faint"))


def html_tables(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.concat(F.lit("<td> "), F.col("l_partkey").cast("string"), F.lit("</td><TH align=left>b <b>"), "l_returnflag", F.lit("</b>\n c</TH>"))
    body = F.concat(F.lit("x <table border=1><tr>"), cell, F.lit("</tr><tr><td></td></tr></table> y <tablet></tablet>"), F.when(F.col("l_suppkey") % 2 == 0, "<TABLE><tr><td>z</td></tr></TABLE>").otherwise("<table><tr>"))
    rows = lines(spark, sf).select("l_orderkey", "l_linenumber", T.html_blocks(body).alias("found"))
    return rows.select("l_orderkey", "l_linenumber", F.size("found").alias("n"), F.array_join(F.transform("found", lambda f: T.html_text(f["html"])), "#").alias("text"), F.array_join(F.transform("found", lambda f: f["offset"].cast("string")), ",").alias("at"))


def cell_matches(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    return G.match_cells(b.where("kind <> 'N'"), b.where("kind = 'N'"), ON).select("page", "pos", "pos_b")


def gold_sections(spark: SparkSession, sf: str) -> DataFrame:
    """[J5][R10][U3][U4] Retrieved and wanted sections of each order: what is found, what is missed, and the oracle's scope."""
    name = lambda c, n: F.concat(F.lit("S"), (F.col(c) % n).cast("string"))
    rows = lines(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(name("l_partkey", 7))).alias("got"), F.array_sort(F.collect_list(name("l_suppkey", 5))).alias("gold"))
    shown = lambda x: F.array_join(F.array_sort(x), ",")
    return rows.select("l_orderkey", F.round(R.recall(F.col("got"), F.col("gold")), 9).alias("recall"), shown(I.common(F.col("got"), F.col("gold"))).alias("found"), shown(I.less(F.col("gold"), F.col("got"))).alias("missed"), F.array_join(R.oracle_scope(F.lit("S1"), F.col("gold")), ",").alias("scope"))


def document_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """[R9] Places in document order, where some sections have no numbers."""
    p = F.col("l_partkey").cast("int")
    rows = lines(spark, sf).select("l_orderkey", "l_linenumber", F.when(p % 4 != 0, p % 5).alias("pt"), F.when(p % 4 != 0, F.col("l_suppkey").cast("int") % 3).alias("ch"), F.when(p % 4 != 0, p % 11).alias("sec"))
    return I.ranked(rows, ["l_orderkey"], R.document_order(), "l_linenumber").select("l_orderkey", "l_linenumber", "place")


def head_cut(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", *(F.md5(R.head_truncated(F.col("text"), n).cast("binary")).alias(f"head_{n}") for n in (40_000, 25_000)))


def pack_variants(spark: SparkSession, sf: str) -> DataFrame:
    """[R6][R7] The expanded context's and the gold chain's packing."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang"), "n_chars").where("lang is not null")
    each = (("expanded", 200, 2_000), ("gold", 0, None))
    return I.together([R.pack_with_tail(docs, "lang", ["doc_id"], "n_chars", 30_000, reserve, least).select("lang", "doc_id", "taken", "overflow") for _, reserve, least in each])


def title_heights(spark: SparkSession, sf: str) -> DataFrame:
    return L.mean_title_height(boxes(spark, sf).where("kind = 'R'"), ON).select("page", F.round("mean_height", 9).alias("mean_height"))


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of a page, each beside another of about its place."""
    near = boxes(spark, sf).withColumn("x0", F.col("x0") % 60).withColumn("y0", F.col("y0") % 40 + F.when(F.col("kind") == "A", 450).otherwise(0)).withColumn("x1", F.col("x0") + 200 + F.col("pos")).withColumn("y1", F.col("y0") + 150 + F.col("pos") * 3)
    return near.withColumn("kind", _choice(("text", "title", "interline_equation", "image_body", "table_body", "discarded"), F.col("pos") + F.col("page")))


def block_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _kinds(spark, sf)
    return G.resolve_blocks(rows.where("kind <> 'discarded'"), rows.where("kind = 'discarded'"), ON, "pos", F.lit(400.0), F.lit(620.0)).select("page", "pos", "kind")


def outside_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = _kinds(spark, sf)
    spans = boxes(spark, sf).withColumn("type", _choice(("text", "image", "table"), F.col("pos"))).drop("kind")
    return G.spans_in_blocks(spans, rows.where("kind <> 'discarded'").withColumnRenamed("kind", "kind"), rows.where("kind = 'discarded'"), ON, "pos").select("page", "pos")


def row_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of two rows a page, in order of place."""
    row = F.col("pos") % 2 * 30
    cells = boxes(spark, sf).select("page", "pos", "x0", (row + F.col("x0") % 2).cast("double").alias("y0"), "x1", (row + 20).cast("double").alias("y1"), F.concat("kind", F.col("pos").cast("string")).alias("content"))
    return O.gathered_rows(cells, ON)


_FORMULAS = (
    "for hatchway corners A\n$$\n\\begin{array}{l} { a } \\\\ & b \\end{array}\n$$\n\nFor  hatchway corners B\nrest", "x\n\n\n\n$$\na\n$$", "for hatchway corners A\n$$\n\\begin{array}{l} a \\\\ b \\end{array}\n$$\nno", "$$\nopen",
)


def split_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """[X17]"""
    return O.conditions_split(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc"), _choice(_FORMULAS, F.col("s_suppkey")).alias("text")), "doc")


def nesting_tables(spark: SparkSession, sf: str) -> DataFrame:
    """[W8] Three tables beside each other in a large one, which they fill or not."""
    n = lambda c: c.cast("double")
    row = boxes(spark, sf).select("page", "pos", F.when(F.col("pos") == 4, 0.0).otherwise(n(F.col("pos") * 100)).alias("x0"), F.lit(0.0).alias("y0"), F.when(F.col("pos") == 4, 400.0).otherwise(n(F.col("pos") * 100 + 90 - F.col("y0") % 3 * 20)).alias("x1"), F.when(F.col("pos") == 4, 50.0).otherwise(50.0 + F.col("x0") % 2 * 30).alias("y1"))
    return O.drop_nesting(row, ON).select("page", "pos")


def index_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).select("l_orderkey", (F.col("l_partkey") % 9).cast("int").alias("index")).distinct()
    return G.runs_of_index(rows, ["l_orderkey"], "index")


def nearer_figures(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    kind = lambda k: b.where(F.col("pos") % 3 == k)
    return G.nearer_kind(kind(0), kind(1), kind(2), ON, "pos").select("page", "pos", "first_nearer")


def replaced_tables(spark: SparkSession, sf: str) -> DataFrame:
    line = lines(spark, sf).select("l_orderkey", F.col("l_linenumber").cast("int").alias("line"), "l_returnflag", F.col("l_partkey").cast("int").alias("p"))
    text = line.select("l_orderkey", "line", F.concat(F.lit("line "), F.col("line").cast("string")).alias("content"))
    placed = line.where("p % 4 = 0").select("l_orderkey", F.col("line").alias("first"), F.col("line").alias("last"), F.concat(F.lit("|"), "l_returnflag", F.lit("|")).alias("markdown"))
    loose = line.where("p % 7 = 0").select("l_orderkey", F.col("line").alias("table_ix"), F.concat(F.lit("loose "), F.col("p").cast("string")).alias("markdown"))
    return T.replace_blocks(text, "l_orderkey", placed, loose)


def paragraph_kinds(spark: SparkSession, sf: str) -> DataFrame:
    p, s = F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int")
    rows = lines(spark, sf).select(
        F.col("l_orderkey").alias("block"), F.col("l_linenumber").cast("int").alias("line"), _choice_number((0.0, 0.0, 0.0, 6.0, 12.0, 40.0), p).alias("x0"), (F.col("l_linenumber") * 10).cast("double").alias("y0"), _choice_number((100.0, 100.0, 95.0, 85.0, 60.0, 50.0), s).alias("x1"),
        (F.col("l_linenumber") * 10 + 8).cast("double").alias("y1"), _choice(("1 one", "word", "ends.", "12", "x 7", " two;"), p + F.col("l_orderkey") % 2).alias("text"), F.lit(0.0).alias("bx0"), F.lit(0.0).alias("by0"), F.lit(100.0).alias("bx1"), F.lit(60.0).alias("by1"),
        F.when(F.col("l_orderkey") % 2 == 0, 150.0).otherwise(400.0).alias("page_w"),
    )
    return L.classify_paragraphs(rows, ["block"])


def _choice_number(values: tuple[float, ...], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def paragraph_islands(spark: SparkSession, sf: str) -> DataFrame:
    p, s = F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int")
    rows = lines(spark, sf).select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int").alias("pos"), F.when(p % 5 == 0, "title").otherwise("text").alias("kind"), F.lit(0.0).alias("x0"), (100.0 + s % 3 * 60).alias("x1"),
        F.when(p % 4 == 0, 5.0).otherwise(1.0).alias("first_x0"), F.lit(8.0).alias("first_h"), _choice(("goes on", "New", "1st", "ändert"), p).alias("first_text"), (100.0 + s % 3 * 60 - s % 2 * 9).alias("last_x1"), F.lit(8.0).alias("last_h"),
        _choice(("and", "ends.", "more,", "so: ", "a"), s).alias("last_text"), (F.col("l_quantity") % 7 == 0).alias("list_group"),
    )
    return L.merge_paragraphs(rows, ON, "pos").select("page", "pos", "paragraph")


def title_levels(spark: SparkSession, sf: str) -> DataFrame:
    titles = boxes(spark, sf).select("page", "pos", F.lit(1).alias("level"))
    levels = titles.groupBy("page").agg(F.count("*").cast("int").alias("n")).select("page", F.sequence(F.lit(2), F.col("n") + 1 + (F.col("page") % 2).cast("int")).alias("levels"))
    return I.levelled(titles, levels.where("page % 5 <> 0"), ON)


def table_shapes(spark: SparkSession, sf: str) -> DataFrame:
    html = _choice(("<table><tr><td>a</td></tr></table>", '<table><td colspan="2">a</td></table>', "<table><td><TABLE></TABLE></td></table>", "<table><td rowspan=2></td></table>"), F.col("l_partkey"))
    kind, level = X.table_shape(html)
    return lines(spark, sf).select("l_orderkey", "l_linenumber", kind.alias("kind"), level.alias("level"))


def table_texts(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    spans = b.where("kind <> 'R'").select(*ON, *G.SIDES, F.concat("kind", F.col("pos").cast("string")).alias("content"))
    found = L.text_boxes_for_tables(spans, b.where("kind = 'R'").select(*ON, F.col("pos").alias("table_ix"), F.col("x0"), F.col("y0"), (F.col("x1") + 150).alias("x1"), (F.col("y1") + 150).alias("y1")), ON)
    return found.withColumn("contents", F.array_join("contents", ","))


def enqueued_tasks(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("/in/"), "s_name").alias("path"))
    rows = Q.enqueue(files, "name", "path", F.lit("2024-01-02 03:04:05").cast("timestamp"), 3)
    return rows.withColumn("created_at", F.col("created_at").cast("string"))


_TEXTS = ("```python\nx = 1\n```", "no fence", "  \\[ a + b \\] ", "ﬁnd the ﬂow", "../a b?.pdf", "___", "a\\]", "```\ny")


def text_cleaners(spark: SparkSession, sf: str) -> DataFrame:
    """[C8][C20][C30][X19]"""
    t, s = _choice(_TEXTS, F.col("s_suppkey")), F.col("s_suppkey").cast("int")
    signals = F.transform(F.sequence(F.lit(1), s % 5 + 1), lambda k: F.repeat(F.concat(F.lit("s"), k.cast("string")), F.when(k == 2, 60).otherwise(1)))
    return table(spark, sf, "supplier").select(
        "s_suppkey", X.without_fences(t).alias("code"), X.without_display_marks(t).alias("formula"), X.plain_characters(t).alias("plain"), X.safe_file_name(t).alias("file"),
        X.integrity_notice(signals, F.when(s % 3 != 0, "clean"), F.when(s % 4 != 0, s % 4 / 4.0)).alias("notice"), X.bulleted(signals).alias("bullets"),
    )


def vertical_lines(spark: SparkSession, sf: str) -> DataFrame:
    return G.group_lines(boxes(spark, sf).withColumn("alone", F.lit(False)), ON, "pos", 0.3, vertical=True).select("page", "pos", "line")


def retry_waits(spark: SparkSession, sf: str) -> DataFrame:
    return Q.with_backoff(lines(spark, sf).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 7).cast("int").alias("attempt"))).select("l_orderkey", "l_linenumber", F.coalesce("wait_s", F.lit(-1)).alias("wait_s"))


def selected_pages(spark: SparkSession, sf: str) -> DataFrame:
    p, n = F.col("l_linenumber").cast("int") - 1, F.col("l_quantity").cast("int") % 8 + 1
    last = F.when(F.col("l_partkey") % 3 == 0, F.lit(None)).when(F.col("l_partkey") % 3 == 1, -1).otherwise(F.col("l_suppkey").cast("int") % 9)
    return lines(spark, sf).where(X.page_range(p, F.when(F.col("l_partkey") % 2 == 0, 1), last.cast("int"), n)).select("l_orderkey", "l_linenumber")


def ocr_parts(spark: SparkSession, sf: str) -> DataFrame:
    """[W10]"""
    rows = boxes(spark, sf).withColumn("category_id", (F.col("pos") * 2 + F.col("page") % 3).cast("int"))
    return I.layout_parts(rows, ON)["ocr"].select("page", "pos")


_CODE = ("<!DOCTYPE html><p>", '{"a": 1}', "#!/bin/bash\nls", "import os\nx = 1", "#include <a.h>", "public class A {", "select a from b", "const x = 1", "plain words", "<?xml version='1'?>")


def code_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """[C14]"""
    code = _choice(_CODE, F.col("l_partkey"))
    content = F.concat(F.when(F.col("l_suppkey") % 3 == 0, F.lit("%PDF-1.7")).otherwise(""), code).cast("binary")
    path = F.when(F.col("l_suppkey") % 2 == 0, "a/b.PDF").otherwise("a/b.html")
    return lines(spark, sf).select("l_orderkey", "l_linenumber", X.code_language(code).alias("code"), X.suffix_guess(content, path).alias("suffix"))


def cached_calls(spark: SparkSession, sf: str) -> DataFrame:
    """[J11] Prompts that a cache answers, and those that a model must."""
    prompts = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("key"), F.col("n_name").alias("prompt"))
    held = prompts.where("key % 3 <> 0").select(M.cache_key(F.col("prompt"), F.lit("m"), F.lit("")).alias("cache_key"), F.when(F.col("key") % 3 == 1, "known").otherwise("[ERROR: down]").alias("response"))
    return M.call_model(prompts, held, lambda prompt, model: f"{model}: {prompt.lower()}", "m")[0].select("key", "response")


def distinct_tables(spark: SparkSession, sf: str) -> DataFrame:
    """[C5] Tables of an order less those too like one before them."""
    first, n = F.col("l_suppkey").cast("int") % 4, F.col("l_partkey").cast("int") % 6
    tokens = F.transform(F.sequence(first, first + n), lambda k: F.concat(F.lit("w"), k.cast("string")))
    return O.keep_first_distinct(lines(spark, sf).select("l_orderkey", F.col("l_linenumber").cast("int").alias("pos"), tokens.alias("tokens")), "l_orderkey").select("l_orderkey", "pos")


def box_order(spark: SparkSession, sf: str) -> DataFrame:
    """[W21] The first two boxes of a page, on about one line or not."""
    two = boxes(spark, sf).where("pos <= 2").withColumn("y0", F.col("y0") % 17).select("page", "pos", "x0", "y0")
    return O.text_box_order(two, ON).select("page", "pos", "read_index")


def page_tables(spark: SparkSession, sf: str) -> DataFrame:
    """[C28] Tables of an order's pages, which go on over a page break or don't: by captions, footnotes, widths and columns."""
    p, cols = F.col("l_partkey").cast("int"), (1 + F.col("l_suppkey") % 2).cast("int")
    cells = lambda tag, text: F.concat(F.lit("<tr>"), F.repeat(F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>")), cols), F.lit("</tr>"))
    tables = lines(spark, sf).select(
        "l_orderkey", F.col("l_linenumber").cast("int").alias("page"), F.lit(True).alias("is_first"), F.lit(True).alias("is_last"),
        F.concat(F.lit("<table>"), cells("th", F.lit("h")), cells("td", F.concat(F.lit("b"), "l_linenumber")), F.lit("</table>")).alias("html"),
        F.when(p % 5 == 0, "Table X").when(p % 5 == 1, "Table X (continued)").alias("caption"), F.when(p % 11 == 0, 2).when(p % 7 == 0, 1).otherwise(0).alias("n_footnotes"),
        F.lit(0.0).alias("x0"), (100 + p % 3 * 8).cast("double").alias("x1"),
    )
    return O.merge_page_tables(tables, "l_orderkey").select("l_orderkey", "page", "html", "n_footnotes")


QUERIES = {
    f.__name__: f
    for f in (
        page_tables, cached_calls, distinct_tables, box_order, code_kinds, confident_boxes, unreleased_items, char_spans, span_block_fit, ocr_rules, html_tables, cell_matches, gold_sections, document_ranks, head_cut, pack_variants, title_heights, block_conflicts, outside_spans, row_texts, split_formulas, nesting_tables,
        index_runs, nearer_figures, replaced_tables, paragraph_kinds, paragraph_islands, title_levels, table_shapes, table_texts, enqueued_tasks, text_cleaners, vertical_lines, retry_waits, selected_pages, ocr_parts,
    )
}

_N = _B + """, k as (select page, pos, x0 % 60 as x0, y0 % 40 + case when kind = 'A' then 450 else 0 end as y0, x0 % 60 + 200 + pos as x1, y0 % 40 + case when kind = 'A' then 450 else 0 end + 150 + pos * 3 as y1,
  (['text', 'title', 'interline_equation', 'image_body', 'table_body', 'discarded'])[(pos + page) % 6 + 1] as kind from b)
"""
_OF = f"{_I} / ({_AA})"
_IOU = f"{_I} / ({_AA} + {_AC} - {_I})"

_KINDS = "(['html', 'json', 'shell', 'python', 'c', 'java', 'sql', 'javascript', 'txt', 'xml'])[l_partkey % 10 + 1]"

ORACLES = {
    "page_tables": LINES + """, t as (select l_orderkey, l_linenumber::int as page, 1 + l_suppkey::int % 2 as cols, l_partkey::int % 5 as cap, case when l_partkey::int % 11 = 0 then 2 when l_partkey::int % 7 = 0 then 1 else 0 end as notes, 100 + l_partkey::int % 3 * 8 as w from lines),
m as (select b.*, a.page is not null and b.cap <> 0 and a.notes <= case when b.cap = 1 then 1 else 0 end and abs(a.w - b.w) * 10 < least(a.w, b.w) and a.cols = b.cols as more from t b left join t a on a.l_orderkey = b.l_orderkey and a.page = b.page - 1),
i as (select *, count(*) filter (not more) over (partition by l_orderkey order by page) as island from m),
g as (select l_orderkey, island, min(page) as page, sum(notes) as notes, string_agg('<tr>' || repeat('<td>b' || page || '</td>', cols) || '</tr>', '' order by page) as body from i group by all)
select i.l_orderkey, i.page, case when g.page = i.page then '<table><tr>' || repeat('<th>h</th>', i.cols) || '</tr>' || body || '</table>' else '' end as html, case when g.page = i.page then g.notes else 0 end::int as n_footnotes from i join g using (l_orderkey, island)""",
    "cached_calls": "select n_nationkey::int as key, case when n_nationkey % 3 = 1 then 'known' else 'm: ' || lower(n_name) end as response from nation",
    "distinct_tables": LINES + """, p as (select l_orderkey, list([l_linenumber::int] order by l_linenumber) as ps, map(list(l_linenumber::int), list(l_suppkey::int % 4)) as a, map(list(l_linenumber::int), list(l_partkey::int % 6 + 1)) as n from lines group by l_orderkey),
g as (select l_orderkey, list_reduce(ps, lambda acc, k: case when len(list_filter(acc, lambda u: greatest(0, least(a[u] + n[u], a[k[1]] + n[k[1]]) - greatest(a[u], a[k[1]]))::double / least(n[u], n[k[1]]) >= 0.92::double)) > 0 then acc else list_append(acc, k[1]) end, []::int[]) as kept from p)
select l_orderkey, unnest(kept) as pos from g""",
    "box_order": _B + """, t as (select page, pos, x0, y0 % 17 as y0 from b where pos <= 2), o as (select *, row_number() over w as k, lead(y0) over w as ny, lead(x0) over w as nx, lag(y0) over w as py, lag(x0) over w as px from t window w as (partition by page order by y0, x0, pos))
select page, pos, case when k = 1 then case when abs(ny - y0) < 10 and nx < x0 then 1 else 0 end else case when abs(y0 - py) < 10 and x0 < px then 0 else 1 end end::int as read_index from o""",
    "code_kinds": LINES + f" select l_orderkey, l_linenumber, {_KINDS} as code, case when l_suppkey % 3 = 0 then 'pdf' else {_KINDS} end as suffix from lines",
    "confident_boxes": _B + " select page, pos from b where score > 0.3::double and pos % 4 <> 0 and x1 > x0 and y1 > y0",
    "unreleased_items": "select o_orderkey from orders where o_orderstatus = 'F' and o_orderkey % 3 <> 0",
    "char_spans": LINES + f""", l as (select l_orderkey as page, l_linenumber::int as pos, l_partkey::int as p, l_suppkey::int as s from lines),
sp as (select page, pos as span_ix, 0 as x0, 10 * pos as y0, 100 as x1, 10 * pos + 12 as y1 from l where pos % 2 = 1),
c as (select page, pos as char_idx, {_sql_choice(_MARKS, 's')} as ch, (p % 125 - 15)::double as x0, (10 * (s % 8) + p % 7)::double as y0, (p % 125 - 6)::double as x1, (10 * (s % 8) + p % 7 + 8)::double as y1 from l where pos % 2 = 0),
j as (select c.page, char_idx, span_ix, sp.y0 as top, ch, c.x0 as a0, c.x1 as a1, (c.x0 + c.x1) / 2 as cx, (c.y0 + c.y1) / 2 as cy, sp.* exclude (page, span_ix) from c join sp on c.page = sp.page),
f as (select *, cy > y0 and cy < y1 and abs(cy - (y0 + y1) / 2.0::double) < 12 * 0.33::double as level from j)
select page, char_idx, arg_min(span_ix, top) as span_ix from f where level and ((x0 < cx and cx < x1) or (ch in ('.', '-', '。') and x1 - 12 < a0 and a0 < x1 and cx > x0) or (ch in ('(', '【') and x0 < a1 and a1 < x0 + 12 and cx < x1)) group by page, char_idx""",
    "span_block_fit": LINES + f""" select distinct span, block, case when span in ('text', 'inline_equation') then block in ('text', 'title', 'image_caption', 'image_footnote', 'table_caption', 'table_footnote', 'discarded')
  when span = 'interline_equation' then block in ('interline_equation', 'text') when span = 'image' then block = 'image_body' when span = 'table' then block = 'table_body' else false end as fits
from (select {_sql_choice(_SPANS, 'l_partkey')} as span, {_sql_choice(_BLOCKS, 'l_suppkey')} as block from lines)""",
    "ocr_rules": LINES + """, r as (select l_orderkey, l_linenumber, l_partkey::int as p, l_suppkey::int as s, l_quantity::int as q from lines)
select l_orderkey, l_linenumber, (s % 11) / 10.0::double < 0.5 or (p % 3 <> 1 and (s % 11) / 10.0::double < 0.8 and p % 9 < s % 7) as garbage, p % 2 = 0 and s % 3 <> 2 and q % 3 <> 0 as routed, p % 5 = 0 as forced,
  round_even((p % 40)::double / (100 + s % 100 + 1e-6::double), 2) <= 0.17::double as faint from r""",
    "html_tables": LINES + r""", h as (select l_orderkey, l_linenumber, 'x <table border=1><tr><td> ' || l_partkey || '</td><TH align=left>b <b>' || l_returnflag || '</b>' || chr(10) || ' c</TH></tr><tr><td></td></tr></table> y <tablet></tablet>' as a, l_suppkey % 2 = 0 as two, l_partkey, l_returnflag from lines)
select l_orderkey, l_linenumber, case when two then 2 else 1 end as n, l_partkey || ' | b ' || l_returnflag || ' c' || chr(10) || case when two then '#z' else '' end as text, '2' || case when two then ',' || length(a) else '' end as at from h""",
    "cell_matches": _B + f" select a.page, a.pos, c.pos as pos_b from b a join b c on a.page = c.page where a.kind <> 'N' and c.kind = 'N' and (1 - {_OF} < 0.6::double or {_IOU} > 0.8::double)",
    "gold_sections": LINES + """, g as (select l_orderkey, list('S' || l_partkey % 7) as got, list('S' || l_suppkey % 5 order by 'S' || l_suppkey % 5) as gold from lines group by l_orderkey),
d as (select l_orderkey, list_distinct(got) as got, list_distinct(gold) as gold, gold as raw from g)
select l_orderkey, round(len(list_filter(gold, lambda x: list_contains(got, x)))::double / len(gold), 9) as recall, array_to_string(list_sort(list_filter(gold, lambda x: list_contains(got, x))), ',') as found,
  array_to_string(list_sort(list_filter(gold, lambda x: not list_contains(got, x))), ',') as missed, array_to_string(list_concat(['S1'], list_sort(list_filter(gold, lambda x: x <> 'S1'))), ',') as scope from d""",
    "document_ranks": LINES + """ select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by case when l_partkey % 4 <> 0 then l_partkey % 5 else 99 end, case when l_partkey % 4 <> 0 then l_suppkey % 3 else 99 end,
  case when l_partkey % 4 <> 0 then l_partkey % 11 else 99 end, l_linenumber) - 1 as place from lines""",
    "head_cut": "select doc_id, md5(substr(text, 1, 40000)) as head_40000, md5(substr(text, 1, 25000)) as head_25000 from documents",
    "pack_variants": """with a as (select lang, doc_id, n_chars, coalesce(sum(n_chars) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from documents where lang is not null),
b as (select *, bool_or(before + n_chars > 30000) over (partition by lang) as overflow from a),
c as (select 0 as part, 200 as reserve, 2000 as least union all select 1, 0, -1),
d as (select *, case when before + n_chars <= 30000 then n_chars when before <= 30000 and 30000 - before - reserve > least then least(30000 - before - reserve, n_chars) end as taken from b, c)
select lang, doc_id, taken, overflow, part from d where taken is not null""",
    "title_heights": _B + " select page, round(avg(y1 - y0), 9) as mean_height from b where kind = 'R' group by page",
    "block_conflicts": _N + f""", r1 as (select * from k a where kind <> 'discarded' and not (kind = 'title' and exists (select 1 from k c where c.page = a.page and c.kind = 'text' and {_IOU} > 0.8::double))),
r2 as (select * from r1 a where not exists (select 1 from k c where c.page = a.page and c.kind = 'discarded' and {_OF} > 0.6::double)),
r3 as (select * from r2 a where not (kind = 'text' and exists (select 1 from r2 c where c.page = a.page and c.kind = 'interline_equation' and {_IOU} > 0.8::double)))
select page, pos, kind from r3 a where not exists (select 1 from k c where c.page = a.page and c.kind = 'discarded' and c.x1 - c.x0 > 400.0::double / 3 and c.y1 - c.y0 > 10 and c.y0 > 0.7::double * 620
  and a.y0 >= c.y1 and greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) / (a.x1 - a.x0) >= 0.8::double)""",
    "outside_spans": _N + f""" select page, pos from b a where exists (select 1 from k c where c.page = a.page and c.kind = 'discarded' and {_OF} > 0.4::double)
  or exists (select 1 from k c where c.page = a.page and c.kind <> 'discarded' and {_OF} > 0.5::double and case a.pos % 3 when 1 then c.kind = 'image_body' when 2 then c.kind = 'table_body' else c.kind not in ('image_body', 'table_body') end)""",
    "row_texts": _B + """, g as (select page, pos, pos % 2 as r, x0, kind || pos as content, max(x1) over (partition by page, pos % 2 order by pos rows between unbounded preceding and 1 preceding) as reach from b)
select page, min(pos)::int as pos, string_agg(case when reach is null then '' else repeat(' ', trunc(greatest(x0 - reach, 0) / 10)::int) end || content, '' order by pos) as text from g group by page, r""",
    "split_formulas": r"""select s_suppkey as doc, (['for hatchway corners A' || chr(10) || chr(10) || '$$' || chr(10) || 'a' || chr(10) || '$$' || chr(10) || chr(10) || 'For  hatchway corners B' || chr(10) || chr(10) || '$$' || chr(10) || 'b' || chr(10) || '$$' || chr(10) || chr(10) || 'rest' || chr(10),
  'x' || chr(10) || chr(10) || '$$' || chr(10) || 'a' || chr(10) || '$$' || chr(10), 'for hatchway corners A' || chr(10) || '$$' || chr(10) || '\begin{array}{l} a \\ b \end{array}' || chr(10) || '$$' || chr(10) || 'no' || chr(10), '$$' || chr(10) || 'open' || chr(10)])[s_suppkey % 4 + 1] as text from supplier""",
    "nesting_tables": _B + """, t as (select page, pos, case when pos = 4 then 0 else pos * 100 end::double as x0, 0.0::double as y0, case when pos = 4 then 400 else pos * 100 + 90 - y0 % 3 * 20 end::double as x1, case when pos = 4 then 50 else 50 + x0 % 2 * 30 end::double as y1 from b),
i as (select a.page, a.pos, c.pos as o, c.x0, c.x1, (c.x1 - c.x0) * (c.y1 - c.y0) as area, (a.x1 - a.x0) * (a.y1 - a.y0) as big from t a join t c on a.page = c.page and a.pos <> c.pos
  where greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) > 0 and greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) >= 0.8::double * (c.x1 - c.x0) * (c.y1 - c.y0)),
m as (select a.page, a.pos from i a join i c on a.page = c.page and a.pos = c.pos and a.o < c.o where least(a.x1, c.x1) > greatest(a.x0, c.x0)),
g as (select page, pos from i group by page, pos having count(*) >= 3 and sum(area) > 0.8::double * any_value(big)) select page, pos from t where (page, pos) not in (select (page, pos) from g where (page, pos) not in (select (page, pos) from m))""",
    "index_runs": LINES + """, d as (select distinct l_orderkey, (l_partkey % 9)::int as "index" from lines), o as (select *, case when "index" - lag("index") over (partition by l_orderkey order by "index") <= 1 then 0 else 1 end as opens from d)
select l_orderkey, "index", (sum(opens) over (partition by l_orderkey order by "index" rows unbounded preceding))::bigint as run from o""",
    "nearer_figures": _B + f""", d as (select a.page, a.pos, min(case when c.pos % 3 = 1 then {_E} end) as d1, min(case when c.pos % 3 = 2 then {_E} end) as d2 from b a left join b c on a.page = c.page and c.pos % 3 > 0 where a.pos % 3 = 0 group by a.page, a.pos)
select page, pos, coalesce(d1 < d2, d2 is null and d1 is not null) as first_nearer from d""",
    "replaced_tables": LINES + """, l as (select l_orderkey, l_linenumber::int as line, l_returnflag as f, l_partkey::int as p from lines),
e as (select l_orderkey, max(line) as last_line, max(case when p % 4 = 0 then line end) as after, count(*) filter (p % 4 = 0) as replaced, count(*) filter (p % 7 = 0) as appended from l group by l_orderkey),
r as (select l_orderkey, line as place, 0 as sub, case when p % 4 = 0 then '|' || f || '|' else 'line ' || line end as t from l union all select l_orderkey, coalesce(after, last_line), line + 1, 'loose ' || p from l join e using (l_orderkey) where p % 7 = 0)
select l_orderkey, string_agg(t, chr(10) order by place, sub, t) || chr(10) as text, any_value(replaced) as replaced, any_value(appended) as appended from r join e using (l_orderkey) group by l_orderkey""",
    "paragraph_kinds": LINES + """, r as (select l_orderkey as block, l_linenumber as line, ([0, 0, 0, 6, 12, 40]::double[])[l_partkey % 6 + 1] as x0, ([100, 100, 95, 85, 60, 50]::double[])[l_suppkey % 6 + 1] as x1,
  trim((['1 one', 'word', 'ends.', '12', 'x 7', ' two;'])[(l_partkey + l_orderkey % 2) % 6 + 1]) as t, case when l_orderkey % 2 = 0 then 150 else 400 end as pw from lines),
m as (select *, 8 as h, case when 100.0::double / pw >= 0.5::double then 26 else 36 end as area, row_number() over (partition by block order by line) as k, count(*) over (partition by block) as n from r),
a as (select block, any_value(n) as n, count(*) filter (x0 < 4) as lc, count(*) filter (x0 >= 4 and x0 > 8) as ln, count(*) filter (100 - x1 < 8) as rc, count(*) filter (100 - x1 >= 8 and 100 - x1 > area) as rn,
  count(*) filter (abs((x0 + x1) / 2 - 50) < 4) as cc, count(*) filter (x0 > 5.6::double and 100 - x1 > 5.6::double) as ex, count(*) filter (regexp_matches(t, '^[0-9]')) as ns, count(*) filter (regexp_matches(t, '[0-9]$')) as ne, count(*) filter (regexp_matches(t, '[.;]$')) as fe,
  bool_or(k = 1 and x0 > 4) and bool_or(k = n and x0 < 4 and 100 - x1 > 8) as para from m group by block)
select block, case when n < 2 then 'text' when (lc / n::double >= 0.8::double or rc / n::double >= 0.8::double) and (ns / n::double >= 0.8::double or ne / n::double >= 0.8::double) then 'index'
  when ex >= 2 and cc = n and ex / n::double >= 0.5::double and 0.6::double > 0.4::double then 'list' when lc >= 2 and (rn >= 2 or fe / n::double >= 0.8::double or ln >= 2) and not para then 'list' else 'text' end as kind from a""",
    "paragraph_islands": LINES + """, r as (select l_orderkey as page, l_linenumber::int as pos, case when l_partkey % 5 = 0 then 'title' else 'text' end as kind, 100 + l_suppkey % 3 * 60 as x1, l_partkey % 4 <> 0 as flush, l_partkey % 4 in (0, 3) as small,
  l_suppkey % 2 = 0 as full_line, l_suppkey % 5 in (1, 3) as stop, l_quantity % 7 = 0 as grp from lines),
o as (select page, pos, case when kind = 'text' and lag(kind) over w = 'text' and flush and lag(full_line) over w and not lag(stop) over w and abs(x1 - lag(x1) over w) < least(x1, lag(x1) over w) and small and not grp and not lag(grp) over w then 0 else 1 end as opens
  from r window w as (partition by page order by pos))
select page, pos, (sum(opens) over (partition by page order by pos rows unbounded preceding))::bigint as paragraph from o""",
    "title_levels": _B + " select page, pos, case when page % 2 = 0 and page % 5 <> 0 then 1 + row_number() over (partition by page order by pos) else 1 end::int as level from b",
    "table_shapes": LINES + " select l_orderkey, l_linenumber, case when l_partkey % 4 = 0 then 'simple_table' else 'complex_table' end as kind, case when l_partkey % 4 = 2 then 2 else 1 end as level from lines",
    "table_texts": _B + f""", t as (select page, pos, x0, y0, x1 + 150 as x1, y1 + 150 as y1 from b where kind = 'R')
select a.page, c.pos as table_ix_b, min(a.x0) as x0, min(a.y0) as y0, max(a.x1) as x1, max(a.y1) as y1, string_agg(a.kind || a.pos, ',' order by a.y0, a.x0, a.kind || a.pos) as contents from b a join t c on a.page = c.page where a.kind <> 'R' and {_OF} > 0.5::double group by a.page, c.pos""",
    "enqueued_tasks": """select left(sha256('/in/' || s_name || '|2024-01-02 03:04:05'), 32) as task_id, s_name as file_name, '/in/' || s_name as file_path, 'pending' as status, 3 as priority, '2024-01-02 03:04:05' as created_at, 0 as retry_count from supplier""",
    "text_cleaners": r"""with t as (select s_suppkey, s_suppkey::int % 8 as k, s_suppkey::int as s from supplier),
g as (select *, list_transform(range(1, s % 5 + 2), lambda k: repeat('s' || k, case when k = 2 then 60 else 1 end)) as sig from t)
select s_suppkey, (['x = 1', 'no fence', '  \[ a + b \] ', 'ﬁnd the ﬂow', '../a b?.pdf', '___', 'a\]', 'y'])[k + 1] as code,
  (['```python' || chr(10) || 'x = 1' || chr(10) || '```', 'no fence', ' a + b ', 'ﬁnd the ﬂow', '../a b?.pdf', '___', 'a', '```' || chr(10) || 'y'])[k + 1] as formula,
  (['```python' || chr(10) || 'x = 1' || chr(10) || '```', 'no fence', '  \[ a + b \] ', 'find the flow', '../a b?.pdf', '___', 'a\]', '```' || chr(10) || 'y'])[k + 1] as plain,
  (['python_x_1', 'no_fence', 'a_b', 'ﬁnd_the_ﬂow', 'a_b_.pdf', 'unnamed', 'a', 'y'])[k + 1] as file,
  case when s % 3 <> 0 then 'clean' else 'unknown' end || ' (weight ' || (['1.00', '0.25', '0.50', '0.75'])[s % 4 + 1] || '): ' || array_to_string(list_transform(sig[1:3], lambda x: left(x, 100)), '; ') as notice,
  array_to_string(list_transform(sig, lambda x: '- ' || x), chr(10)) as bullets from g""",
    "vertical_lines": _B + """, p as (select *, lag(pos) over w as lp, lag(x0) over w as l0, lag(x1) over w as l1 from b window w as (partition by page order by x1 desc, pos)),
o as (select *, (lp is null or (least(x1, l1) - greatest(x0, l0)) / least(x1 - x0, l1 - l0) <= 0.3::double)::int as o from p)
select page, pos, (sum(o) over (partition by page order by x1 desc, pos rows unbounded preceding))::bigint as line from o""",
    "retry_waits": LINES + " select l_orderkey, l_linenumber, coalesce(([30, 90, 180, 600, 1200])[l_partkey % 7 + 1], -1) as wait_s from lines",
    "selected_pages": LINES + """ select l_orderkey, l_linenumber from (select *, l_linenumber::int - 1 as p, l_quantity::int % 8 + 1 as n, case when l_partkey % 2 = 0 then 1 else 0 end as f, case when l_partkey % 3 = 2 then l_suppkey::int % 9 end as l from lines)
where p between f and case when l is null or l > n - 1 then n - 1 else l end""",
    "ocr_parts": _B + " select page, pos from b where pos * 2 + page % 3 in (0, 1, 2, 4, 6, 7)",
}
