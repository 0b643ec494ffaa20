"""Lines, paragraphs and rendered text from recognised page elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, ends_in_hyphen, language_guess
from .refs import stripped

# Marks that end a sentence or a list item.
LINE_STOPS = (".", "!", "?", "。", "！", "？", ")", "）", '"', "”", ":", "：", ";", "；")
ITEM_STOPS = (".", "。", ";", "；")


def confident(boxes: DataFrame, least: float = 0.05) -> DataFrame:
    """Low scores and boxes without area go."""
    return boxes.where((F.col("score") > least) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def ocr_garbage(text: Column, score: Column, width: Column, height: Column, tokens: list[str]) -> Column:
    """Too low a score, or a known misreading, narrow and not too sure."""
    return (score < 0.5) | (text.isin(*tokens) & (score < 0.8) & (width < height))


def low_contrast(std: Column, mean: Column) -> Column:
    """[F22]"""
    return F.bround(std / (mean + 1e-6), 2) <= 0.17


def span_fits_block(span_type: Column, block_type: Column) -> Column:
    """Which kinds of spans a block takes."""
    # Kinds of blocks that hold text, and the spans that the others hold.
    textual = ("text", "title", "image_caption", "image_footnote", "table_caption", "table_footnote", "discarded")
    return F.when(span_type.isin("text", "inline_equation"), block_type.isin(*textual)).when(span_type == "interline_equation", block_type.isin("interline_equation", "text")).when(span_type == "image", block_type == "image_body").when(span_type == "table", block_type == "table_body").otherwise(False)


def parse_mode(pages: DataFrame, doc: str) -> DataFrame:
    """``txt`` or ``ocr`` per document from features of sampled pages.

    ``pages(doc, page, chars, cid_chars, image_share)``: ten pages at most, drawn by hash. Too little text, too many
    unmapped glyphs, or nearly all pages covered by images mean ``ocr``.
    """
    w = Window.partitionBy(doc).orderBy(F.md5(F.concat_ws("|", F.col(doc).cast("string"), F.col("page").cast("string")).cast("binary")))
    sample = pages.withColumn("k", F.row_number().over(w)).where("k <= 10")
    seen = sample.groupBy(doc).agg(F.avg("chars").alias("avg_chars"), F.sum("cid_chars").alias("cids"), F.sum("chars").alias("all_chars"), F.avg((F.col("image_share") >= 0.8).cast("double")).alias("covered"))
    ocr = (F.col("avg_chars") < 50) | (F.col("cids") / F.greatest("all_chars", F.lit(1)) > 0.05) | (F.col("covered") >= 0.8)
    return seen.select(doc, F.when(F.coalesce(ocr, F.lit(True)), "ocr").otherwise("txt").alias("mode"))


def vlm_ocr(mode: Column, lang: Column, formula: Column, forced: Column | None = None) -> Column:
    """[F20]"""
    rule = (mode == "ocr") & lang.isin("ch", "en") & formula
    return rule if forced is None else F.coalesce(forced, rule)


def chars_to_text(chars: DataFrame, on: list[str], span: str = "span_ix") -> DataFrame:
    """[C9] Characters of a span, by index, as text, with a blank where the gap exceeds a quarter of the median width."""
    width = F.median(F.col("x1") - F.col("x0")).alias("median_w")
    rows = chars.join(chars.groupBy(*on, span).agg(width), [*on, span])
    w = Window.partitionBy(*on, span).orderBy("char_idx")
    gap = F.lead("x0").over(w) - F.col("x1")
    blank = (gap > 0.25 * F.col("median_w")) & (F.col("ch") != " ") & (F.lead("ch").over(w) != " ")
    bits = rows.withColumn("bit", F.concat("ch", F.when(F.coalesce(blank, F.lit(False)), " ").otherwise("")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("char_idx", "bit"))), lambda b: b["bit"]), "")
    return bits.groupBy(*on, span).agg(joined.alias("content"))


def merge_lines(lines: DataFrame, on: list[str], order: str, text: str = "text") -> DataFrame:
    """[C10] Lines as one paragraph: without blanks if its text is Chinese, Japanese or Korean, else with a blank between
    lines, but a word broken by a hyphen is put together, without the hyphen if the next line starts with a small letter.
    Blank lines go."""
    w = Window.partitionBy(*on).orderBy(order)
    own = stripped(F.col(text))
    rows = lines.withColumn("own", own).withColumn("next_small", F.coalesce(F.lead(text).over(w).rlike(r"^\p{IsLowercase}"), F.lit(False)))
    members = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), "own", "next_small"))), lambda r: F.struct(r["own"].alias("own"), r["next_small"].alias("next_small")))
    blocks = rows.groupBy(*on).agg(members.alias("rows"))
    cjk = language_guess(F.array_join(F.transform("rows", lambda r: r["own"]), "")).isin("zh", "ja", "ko")
    western = lambda r: F.when(~ends_in_hyphen(r["own"]), F.concat(r["own"], F.lit(" "))).when(r["next_small"], F.regexp_replace(r["own"], "-$", "")).otherwise(r["own"])
    bits = lambda c: F.transform(F.filter("rows", lambda r: r["own"] != ""), lambda r: F.when(c, r["own"]).otherwise(western(r)))
    # a text's language is a variable of its lines: as an expression it would be guessed from the whole text for each of them
    return blocks.select(*on, stripped(F.array_join(F.transform(F.array(cjk), bits)[0], "")).alias("text"))


def classify_paragraphs(lines: DataFrame, on: list[str]) -> DataFrame:
    """[C25] ``text``, ``list`` or ``index`` per block, from how its lines sit in its box.

    ``lines(on, line, x0, y0, x1, y1, text, bx0, by0, bx1, by1, page_w)``, the b-columns being the block's box.
    """
    w = Window.partitionBy(*on).orderBy("line")
    h = F.first(F.col("y1") - F.col("y0")).over(w)
    width, left, right = F.col("bx1") - F.col("bx0"), F.abs(F.col("x0") - F.col("bx0")), F.col("bx1") - F.col("x1")
    # all windows stand on one order: each other one would be a sort of its own in the same task
    cjk = language_guess(F.array_join(F.collect_list(F.col("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "")).isin("zh", "ja", "ko")
    ragged = F.when(cjk | (F.coalesce(width / F.nullif(F.col("page_w"), F.lit(0.0)), F.lit(0.0)) >= 0.5), 0.26).otherwise(0.36) * width
    last = F.lead(F.lit(1)).over(w).isNull()
    inset = (F.col("x0") - F.col("bx0") > 0.7 * h) & (right > 0.7 * h)
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("bx0") + F.col("bx1")) / 2) < h / 2
    clean = stripped(F.col("text"))
    rows = lines.select(
        *on, "line", F.lit(0).alias("z"), (left < h / 2).alias("flush"), ((left >= h / 2) & (F.col("x0") - F.col("bx0") > h)).alias("indented"), (F.abs(right) < h).alias("right_flush"), ((F.abs(right) >= h) & (right > ragged)).alias("ragged"), inset.alias("inset"), centred.alias("centred"),
        clean.rlike(r"(?U)^\d").alias("d0"), clean.rlike(r"(?U)\d$").alias("d1"), F.right(clean, F.lit(1)).isin(*ITEM_STOPS).alias("stop"),
        ((F.col("by1") - F.col("by0")) / width).alias("shape"),
        ((F.row_number().over(w) == 1) & (F.col("x0") - F.col("bx0") > h / 2)).alias("first_in"), (last & (left < h / 2) & (right > h)).alias("last_short"),
    )
    n = F.count("*")
    share = lambda c: F.count_if(F.col(c)) / n
    agg = rows.groupBy(*on).agg(
        n.alias("n"), *(F.count_if(F.col(c)).alias(c) for c in ("flush", "indented", "right_flush", "ragged", "inset")), F.bool_and("centred").alias("all_centred"), F.max("shape").alias("shape"),
        ((share("d0") >= 0.8) | (share("d1") >= 0.8)).alias("digits"), (share("stop") >= 0.8).alias("stops"),
        F.bool_or("first_in").alias("first_in"), F.bool_or("last_short").alias("last_short"),
    )
    few = F.col("n") < 2
    index = ((F.col("flush") / F.col("n") >= 0.8) | (F.col("right_flush") / F.col("n") >= 0.8)) & F.col("digits")
    middle = (F.col("inset") >= 2) & (F.col("inset") / F.col("n") >= 0.5) & F.col("all_centred") & (F.col("shape") > 0.4)
    plain_shape = F.col("first_in") & F.col("last_short")
    items = (F.col("flush") >= 2) & ((F.col("ragged") >= 2) | F.col("stops") | (F.col("indented") >= 2)) & ~plain_shape
    return agg.select(*on, F.when(few, "text").when(index, "index").when(middle | items, "list").otherwise("text").alias("kind"))


def merge_paragraphs(blocks: DataFrame, on: list[str], order: str) -> DataFrame:
    """[C26] Islands of text blocks that continue each other.

    ``blocks(on, order, kind, x0, x1, first_x0, first_h, first_text, last_x1, last_h, last_text, list_group)``; a block
    goes on with its predecessor if its first line is flush left, the predecessor's last line flush right and without
    a stop, their widths are alike, it starts neither with a digit nor a capital, and neither stands in a list group.
    """
    w = Window.partitionBy(*on).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    width, width_before = F.col("x1") - F.col("x0"), before("x1") - before("x0")
    goes_on = (
        (F.col("kind") == "text") & (before("kind") == "text")
        & (F.abs(F.col("first_x0") - F.col("x0")) < F.col("first_h") / 2)
        & (F.abs(before("x1") - before("last_x1")) < before("last_h"))
        & ~F.right(F.trim(before("last_text")), F.lit(1)).isin(*LINE_STOPS)
        & (F.abs(width - width_before) < F.least(width, width_before))
        & ~F.col("first_text").rlike(r"(?U)^\s*(\d|\p{Lu})")
        & ~F.col("list_group") & ~before("list_group")
    )
    opened = blocks.withColumn("opens", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    return opened.withColumn("paragraph", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def list_groups(blocks: DataFrame, on: list[str], order: str, flush_at_tables: bool = False) -> DataFrame:
    """[C27] Runs of text blocks between titles and display equations; a group of blocks of three lines at most is a list.

    A table or image in between doesn't end a group unless asked to.
    """
    w = Window.partitionBy(*on).orderBy(order)
    ends = F.col("kind").isin("title", "interline_equation", *(("image", "table") if flush_at_tables else ()))
    rows = blocks.withColumn("grp", F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*on, "grp")
    is_list = F.bool_and(F.when(F.col("kind") == "text", F.col("n_lines") <= 3)).over(whole)
    return rows.withColumn("list_group", F.coalesce(is_list & (F.count_if(F.col("kind") == "text").over(whole) > 1), F.lit(False)) & (F.col("kind") == "text")).drop("grp")


def title_level(level: Column) -> Column:
    """[C12]"""
    return F.least(F.greatest(level, F.lit(0)), F.lit(4))


def markdown_block(kind: Column, text: Column, level: Column, image: Column, caption: Column, footnote: Column, html: Column) -> Column:
    """[C11] A block as markdown; captions stand before a body that has a footnote, and after one that hasn't."""
    parts = lambda body: F.when(F.coalesce(footnote, F.lit("")) != "", F.concat_ws("  \n", F.nullif(caption, F.lit("")), body, footnote)).otherwise(F.concat_ws("  \n", body, F.nullif(caption, F.lit(""))))
    title = F.when(title_level(level) > 0, F.concat(F.repeat(F.lit("#"), title_level(level)), F.lit(" "), text)).otherwise(text)
    return F.when(kind == "title", title).when(kind == "interline_equation", F.concat(F.lit("$$\n"), text, F.lit("\n$$"))).when(kind == "image", parts(F.concat(F.lit("![]("), image, F.lit(")")))).when(kind == "table", F.concat_ws("  \n", F.nullif(caption, F.lit("")), html, F.nullif(footnote, F.lit("")))).otherwise(text)


def render_markdown(blocks: DataFrame, on: list[str], order: str, markdown: str) -> DataFrame:
    """[C11] A document's blocks in order, a blank line between them; empty ones go."""
    solid = blocks.where(F.coalesce(F.trim(F.col(markdown)), F.lit("")) != "")
    return solid.groupBy(*on).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(markdown).alias("m")))), lambda b: b["m"]), "\n\n").alias("markdown"))


def content_list(blocks: DataFrame) -> DataFrame:
    """[C11][W28] One typed row per block, with its box in thousandths of the page.

    ``blocks(doc, page, pos, kind, text, level, image, html, caption, footnote, x0, y0, x1, y1, page_w, page_h)``
    """
    text_kind = F.when(F.col("kind") == "interline_equation", "equation").when(F.col("kind").isin("title", "text", "index"), "text").otherwise(F.col("kind"))
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    box = F.array(*((F.col(c) * 1000 / F.col(size)).cast("int") for c, size in (("x0", "page_w"), ("y0", "page_h"), ("x1", "page_w"), ("y1", "page_h"))))
    return blocks.select(
        "doc", "page", "pos", text_kind.alias("type"), F.when(F.col("kind").isin("title", "text", "interline_equation", "list", "index"), F.col("text")).alias("text"),
        F.when((F.col("kind") == "title") & (title_level(F.col("level")) > 0), title_level(F.col("level"))).alias("text_level"), F.when(F.col("kind") == "interline_equation", "latex").alias("text_format"),
        F.when(F.col("kind").isin("image", "table"), F.col("image")).alias("img_path"), F.when(F.col("kind") == "table", F.col("html")).alias("table_body"), some("caption").alias("captions"), some("footnote").alias("footnotes"), box.alias("bbox"), F.col("page").alias("page_idx"),
    )


def mean_title_height(lines: DataFrame, on: list[str]) -> DataFrame:
    """[A21]"""
    return lines.groupBy(*on).agg(F.avg(F.col("y1") - F.col("y0")).alias("mean_height"))


def text_boxes_for_tables(spans: DataFrame, tables: DataFrame, on: list[str]) -> DataFrame:
    """[C32] A table's text boxes out of the page's own text: spans with more than half their area in it."""
    from .geometry import Box, overlap_of_first, page_pairs

    inside = page_pairs(spans, tables, on).where(overlap_of_first(Box(), Box("_b")) > 0.5)
    ordered = F.sort_array(F.collect_list(F.struct("y0", "x0", "content")))
    return inside.groupBy(*on, "table_ix_b").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.transform(ordered, lambda s: s["content"]).alias("contents"))
