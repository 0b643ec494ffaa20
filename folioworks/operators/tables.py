"""Tables found in text: blocks, grids, quality tests, repairs and similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .refs import matches, stripped

CELLS = "array<array<string>>"


def text_lines(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    return docs.select(doc, F.posexplode(F.split(F.col(text), "\n")).alias("line", "content"))


def markdown_blocks(lines: DataFrame, doc: str, least: int = 2) -> DataFrame:
    """[X14] Maximal runs of at least two lines with a pipe."""
    piped = lines.where(F.contains("content", F.lit("|")))
    w = Window.partitionBy(doc).orderBy("line")
    runs = piped.withColumn("run", F.col("line") - F.row_number().over(w))
    rows = F.sort_array(F.collect_list(F.struct("line", "content")))
    blocks = runs.groupBy(doc, "run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.transform(rows, lambda r: r["content"]).alias("rows"))
    return blocks.where(F.size("rows") >= least).drop("run")


def html_blocks(text: Column) -> Column:
    """[X15] Complete ``<table>`` blocks; one that doesn't end is ignored."""
    return F.transform(matches(text, r"(?is)<table\b.*?</table>", 0), lambda m: F.struct(m["raw"].alias("html"), m["offset"].alias("offset")))


def html_grid(html: Column) -> Column:
    """[X16] Rows of cell texts."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(rows, lambda row: F.transform(cells(row), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"(?U)\s+", " "))))


def html_text(html: Column) -> Column:
    """[X16] Cells joined by a pipe, rows by line breaks."""
    return F.array_join(F.transform(html_grid(html), lambda r: F.array_join(r, " | ")), "\n")


def pipe_grid(rows: Column) -> Column:
    """Rows of markdown as rows of cells, without the rule under the header."""
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(F.trim(r), r"^\||\|$", ""), r"\|"), F.trim))
    return F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike(r"^:?-{2,}:?$")))


def _cells(grid: Column) -> Column:
    return F.flatten(grid)


def clean(cell: Column) -> Column:
    """A cell's text with white space of any kind as single blanks; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"(?U)\s+", " "))


def _solid(cells: Column) -> Column:
    return F.filter(F.transform(cells, clean), lambda c: c != "")


def _padded(grid: Column) -> Column:
    """Clean cells, all rows of one width."""
    n = columns_of(grid)
    return F.transform(grid, lambda r: F.concat(F.transform(r, clean), F.array_repeat(F.lit(""), n - F.size(r))))


def columns_of(grid: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))


def structure_reason(grid: Column) -> Column:
    """``ok``, or why a grid isn't a table."""
    full_rows = F.size(F.filter(grid, lambda r: F.size(_solid(r)) >= 2))
    return F.when(F.size(grid) < 2, "too_few_rows").when(columns_of(grid) < 2, "too_few_columns").when(F.size(_solid(_cells(grid))) < 4, "too_few_cells").when(full_rows < 2, "too_few_full_rows").otherwise("ok")


def low_quality(grid: Column) -> Column:
    """Empty, or eight columns and more with mostly short cells, or with many single letters among cells with letters."""
    cells = _solid(_cells(grid))
    n = F.greatest(F.size(cells), F.lit(1))
    short = F.size(F.filter(cells, lambda c: F.length(c) <= 2)) / n
    alpha = F.size(F.filter(cells, lambda c: c.rlike("[A-Za-z]")))
    single = F.size(F.filter(cells, lambda c: c.rlike("^[A-Za-z]$"))) / F.greatest(alpha, F.lit(1))
    return (F.size(cells) == 0) | ((columns_of(grid) >= 8) & ((short > 0.55) | (single > 0.35)))


def _rest(row: Column, first: int) -> Column:
    return F.slice(row, F.lit(first), F.greatest(F.size(row) - first + 1, F.lit(0)))


def definition_table(grid: Column) -> Column:
    """A header of term and definition, with little in any further column, and rows enough that have both."""
    rows = _padded(grid)
    head, body = F.get(rows, F.lit(0)), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    named = (F.lower(F.get(head, F.lit(0))) == "term") & (F.lower(F.get(head, F.lit(1))) == "definition")
    bare = F.forall(_rest(head, 3), lambda c: ~c.rlike("[A-Za-z0-9]"))
    extra = F.size(F.filter(body, lambda r: F.exists(_rest(r, 3), lambda c: c != "")))
    both = F.size(F.filter(body, lambda r: (F.get(r, F.lit(0)) != "") & (F.get(r, F.lit(1)) != "")))
    n = F.size(body)
    return F.coalesce(named & bare & (n > 0) & (extra <= F.greatest(F.lit(1), (n * 0.25).cast("int"))) & (both >= F.greatest(F.lit(2), (n * 0.4).cast("int"))), F.lit(False))


def noisy(text: Column) -> Column:
    """What a page's frame leaves behind: a page number with the publisher's name, a header of three names, or misread words."""
    low = F.lower(clean(text))
    # Words of frames and headers, and misread ones.
    frame = low.rlike(r"(?U)\bpage\s*\d+\b") & low.rlike(r"(?U)\bdnv as\b")
    header = low.rlike(r"(?U)\bclass notation\b") & low.rlike(r"(?U)\bapplication\b") & low.rlike(r"(?U)\brule reference\b")
    return frame | header | F.contains(low, F.lit("5tr")) | F.contains(low, F.lit("shiswththenotation"))


# What a cell of symbols holds, the words and forms that open a new block, and words that start a sentence.
SYMBOLS = r"^[-–—|:;.,_~`]*$"
NEW_BLOCK = r"(?U)\b(table\s+\d+|class notation|description|application|rule reference|term|definition)\b|^\d+(\.\d+)+\b|^section |^chapter "
SENTENCE_START = r"(?i)^(a|an|the|class|assignment|verbal)\b"


def repaired_rows(grid: Column) -> Column:
    """[C21] Rows that go on with the one before end its second cell.

    Cells are cleaned, empty rows go, short rows are filled up. A row goes on if its first cell is empty or symbols only,
    the others hold text that opens no new block, and the row before has a first cell; grids of one column stay as they are.
    """
    rows = F.filter(_padded(grid), lambda r: F.exists(r, lambda c: c != ""))
    text = lambda r: F.array_join(F.filter(_rest(r, 2), lambda c: c != ""), " ")

    def step(kept, row):
        last, more = F.element_at(kept, -1), text(row)
        goes_on = (F.size(kept) > 0) & F.get(row, F.lit(0)).rlike(SYMBOLS) & (more != "") & (F.get(last, F.lit(0)) != "") & ~F.lower(more).rlike(NEW_BLOCK)
        longer = F.concat(F.slice(last, 1, 1), F.array(F.trim(F.concat_ws(" ", F.nullif(F.get(last, F.lit(1)), F.lit("")), more))), _rest(last, 3))
        return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(longer))).otherwise(F.concat(kept, F.array(row)))

    return F.when(columns_of(rows) < 2, rows).otherwise(F.aggregate(rows, F.array().cast(CELLS), step))


def collapsed_definitions(grid: Column) -> Column:
    """[C22] A table of definitions with more than two columns as two: the term, and all further cells as one text,
    fragments that start a sentence first. Any other grid stays as it is."""
    starts = lambda c: c.rlike(SENTENCE_START) | c.rlike("^[A-Z]")

    def row(r):
        more = F.filter(_rest(r, 2), lambda c: c != "")
        return F.array(F.get(r, F.lit(0)), F.array_join(F.concat(F.filter(more, starts), F.filter(more, lambda c: ~starts(c))), " "))

    rows = _padded(grid)
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), row)
    collapsed = F.concat(F.array(F.array(F.lit("Term"), F.lit("Definition"))), body)
    return F.when((columns_of(grid) > 2) & definition_table(grid), collapsed).otherwise(grid)


def grid_markdown(grid: Column) -> Column:
    """[C23] A markdown table; short rows are filled up."""
    n = columns_of(grid)
    fill = lambda r: F.concat(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), n - F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rows = F.transform(grid, lambda r: line(fill(r)))
    return F.array_join(F.concat(F.slice(rows, 1, 1), F.array(line(F.array_repeat(F.lit("---"), n))), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")


def similarity_tokens(text: Column) -> Column:
    """[C4] Distinct lower-cased words of three characters or more, tags and marks gone."""
    plain = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"[^A-Za-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(F.lower(plain), " "), lambda w: F.length(w) >= 3))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """[C4] Shared tokens over the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least.cast("double")).otherwise(0.0)


def block_scores(tables: DataFrame, blocks: DataFrame, doc: str) -> DataFrame:
    """[J18] Similarity of every extracted table to every block of its document."""
    a = tables.select(doc, "table_ix", similarity_tokens(F.col("text")).alias("ta"))
    b = blocks.select(doc, "block_ix", similarity_tokens(F.col("text")).alias("tb"))
    return a.join(b, doc).select(doc, "table_ix", "block_ix", overlap_coefficient(F.col("ta"), F.col("tb")).alias("score"))


def arbitration(stats: DataFrame) -> DataFrame:
    """[A20] Wireless or wired by physical cells (a, b), cells that aren't blank, and text hits."""
    a, b, fa, fb = (F.col(c) for c in ("wireless_cells", "wired_cells", "wireless_filled", "wired_filled"))
    s = F.bround(F.sqrt(fb))
    many = (fa > fb) & (fa + 3 >= F.greatest(fb + 2 * s, s * (s + 2)))
    near = (a - b).between(0, 5) & (b <= F.bround(a * 0.75))
    tiny = (a == b) & (b <= 4)
    hits = (F.col("wired_hits") <= 0.6 * F.col("wireless_hits")) & (F.col("wireless_hits") >= 10)
    return stats.withColumn("choice", F.when(F.coalesce(many | near | tiny | hits, F.lit(True)), "wireless").otherwise("wired"))


def replace_blocks(lines: DataFrame, doc: str, placed: DataFrame, loose: DataFrame) -> DataFrame:
    """[C24] Matched blocks replaced by their tables; unmatched tables follow the last replaced one, or the text.

    ``lines(doc, line, content)``, ``placed(doc, first, last, markdown)``, ``loose(doc, table_ix, markdown)``; returns the
    text, stripped and with a line break at its end, and how many tables were replaced and appended.
    """
    spans = F.collect_list(F.struct("first", "last", "markdown"))
    held = lines.join(placed.groupBy(doc).agg(spans.alias("spans"), F.max("first").alias("after")), doc, "left")
    own = F.get(F.filter(F.coalesce("spans", F.array().cast("array<struct<first:int,last:int,markdown:string>>")), lambda s: F.col("line").between(s["first"], s["last"])), F.lit(0))
    content = F.when(own.isNull(), F.col("content")).when(own["first"] == F.col("line"), own["markdown"])
    kept = held.select(doc, F.col("line").cast("int").alias("at"), F.lit(0).alias("sub"), content.alias("content"), "after", F.size(F.coalesce("spans", F.array().cast("array<struct<first:int,last:int,markdown:string>>"))).alias("replaced"))
    ends = kept.groupBy(doc).agg(F.max("at").alias("end"), F.max("after").alias("after"), F.max("replaced").alias("replaced"))
    more = loose.join(ends, doc).select(doc, F.coalesce("after", "end").alias("at"), (F.col("table_ix") + 1).alias("sub"), F.col("markdown").alias("content"), "after", "replaced")
    rows = kept.where("content is not null").unionByName(more)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "sub", "content"))), lambda r: r["content"]), "\n")
    return rows.groupBy(doc).agg(F.concat(stripped(text), F.lit("\n")).alias("text"), F.max("replaced").alias("replaced"), F.count_if(F.col("sub") > 0).alias("appended"))


def row_groups(cells: DataFrame, on: list[str], gap: float = 10.0) -> DataFrame:
    """[W23] Rows of cells by their tops: a step of more than the gap opens a row."""
    w = Window.partitionBy(*on).orderBy("y0", "x0")
    opened = cells.withColumn("opens", F.coalesce(F.abs(F.col("y0") - F.lag("y0").over(w)) > gap, F.lit(True)).cast("int"))
    return opened.withColumn("row", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("opens")


def column_groups(cells: DataFrame, on: list[str], tolerance: float = 15.0) -> DataFrame:
    """[W23] Columns by left edges, those within the tolerance of their predecessor being one."""
    w = Window.partitionBy(*on).orderBy("x0")
    opened = cells.withColumn("opens", F.coalesce(F.col("x0") - F.lag("x0").over(w) > tolerance, F.lit(True)).cast("int"))
    return opened.withColumn("col", F.sum("opens").over(w.rangeBetween(Window.unboundedPreceding, 0)) - 1).drop("opens")
