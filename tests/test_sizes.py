"""Inputs that small tables don't hold."""

from pyspark.sql import functions as F

from folioworks.functions import text as X
from folioworks.operators import layout as L
from folioworks.operators import ordered as O


def test_long_item_ids(spark):
    rows = spark.createDataFrame([(7,), (9999,), (10000,), (123456,), (None,)], "n long").coalesce(1)
    assert [r[0] for r in rows.select(X.item_id("R_", F.col("n"))).collect()] == ["R_0007", "R_9999", "R_10000", "R_123456", None]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_groups_of_lines_move_once(spark, tmp_path):
    from folioworks.plans import layouts

    line = [(k, n, k * 3 + n, k + n, 5.0, "N", "O") for k in range(9) for n in (1, 2, 2)]
    rows = spark.createDataFrame(line, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    for query in (layouts.smaller_spans, layouts.sequential_nms, layouts.reading_order, layouts.absorbed_blocks):
        found = query(spark, str(tmp_path))
        assert _plan(found)[1].count("Exchange hashpartitioning") == 1
        assert {r.page for r in found.collect()} == set(range(9))


def test_values_of_groups(spark):
    rows = spark.createDataFrame([(1, 2, None, "é", [1], True), (1, 1, 2, None, None, None), (2, 1, 3, "", [], False)], "k long, pos int, n int, t string, a array<int>, b boolean").repartition(1)
    assert sorted(map(tuple, O._per_group(rows, ["k"], lambda x: x).collect())) == sorted(map(tuple, rows.collect()))
    assert O._per_group(rows, ["k"], lambda x: []).count() == 0


def test_tables_alike_are_read_once(spark):
    html = "<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><th>c</th></tr></table>"
    assert O.occupancy(html) is O.occupancy(html)
    texts = [html, None, "", html, "<table></table>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, html string").coalesce(1)
    assert sorted(map(tuple, O.grid_cells(rows, "k").collect())) == sorted((k, *c) for k, t in enumerate(texts) for c in O.occupancy(t))
    assert O.grid_cells(rows.where("k in (1, 2)"), "k").count() == 0
    cells = tuple(O.occupancy(html))
    assert O._written(cells) is O._written(cells) and O._written(cells) == O.cells_html(list(cells))


def test_paragraphs_of_many_lines(spark):
    import time

    def seconds(n: int) -> float:
        rows = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("line"), F.lit("some words of a line that is not short").alias("text"))
        start = time.time()
        assert L.merge_lines(rows, ["doc_id"], "line").select(F.length("text").alias("n")).first().n == 39 * n - 1
        return time.time() - start

    seconds(100)
    # a line costs no more among many than among few: four times as many lines, sixteen times the time if each reads all
    assert seconds(8000) < 8 * max(seconds(2000), 0.5)


def test_paragraph_kinds_sort_once(spark, capsys):
    """Every further order of windows was a sort of its own, held by the same task."""
    from folioworks.operators import layout

    spec = "block long, line int, x0 double, y0 double, x1 double, y1 double, text string, bx0 double, by0 double, bx1 double, by1 double, page_w double"
    rows = [(b, i, 0.0, 10.0 * i, 100.0 - 20 * (i == 3), 10.0 * i + 8, f"{i} word {i}", 0.0, 0.0, 100.0, 60.0, 150.0) for b in (1, 2) for i in range(1, 4)]
    kinds = layout.classify_paragraphs(spark.createDataFrame(rows, spec), ["block"])
    kinds.explain()
    assert capsys.readouterr().out.count("Sort [") == 1
    assert [r.kind for r in kinds.orderBy("block").collect()] == ["index", "index"]


def test_references_are_looked_up_without_their_texts(spark, capsys):
    """Every match moved with its whole text, those that name no section to few tasks."""
    from folioworks.operators import refs as R

    rows = [(f"S{i}", "AB"[i % 2], str(i), None, f"see § 217.{(i + 3) % 9}(a)(1), subpart B of this part, appendix A to this part, paragraph (c)(2) of this section, 12 CFR part 225.") for i in range(9)] + [("X", None, None, "A", "")]
    edges = R.corpus2_edges(spark.createDataFrame(rows, "section_id string, subpart string, sec string, appendix string, text string"))
    assert sorted((x.kind, x.target) for x in edges.collect() if x.source == "S0") == [("appendix_ref", "X"), ("cross_part", "Pt225"), ("cross_subpart", "S3"), ("same_section_paragraph", "S0"), ("subpart_rep", "S1")]
    edges.explain()
    assert "hashpartitioning(pattern_no" not in capsys.readouterr().out


def test_places_of_matches(spark):
    """Places by looking up what matched, by splitting for patterns that look around, and Python's own; texts that hold a match's start before it."""
    import re

    from folioworks.operators import refs as R

    texts = ["a 12 CFR 217.5 then 12 CFR 217 and é 12  CFR part 9.1a12 CFR 3", "Sec.1 [x] Ch.2 Sec.3 [Sec.1 [x]] Sec.1 [x]", "Pt. Ch. 1 Sec. 2 Ch. 1 Sec. 2", "", "😀§ 217.1(a)§ 217.1(a)(b) § 217.1"]
    patterns = (R.ABSOLUTE, R.SECTION, R.CHAPTER, R.SAME_PART, R.OTHER_PART, R.PARAGRAPH)
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    for p in patterns:
        for row in table.select("text", R.matches(F.col("text"), p.regex, p.groups).alias("m")).collect():
            assert [(m.raw, m.offset) for m in row.m] == [(m.group(), m.start()) for m in re.finditer(p.regex.replace("(?U)", "").replace("(?Ui)", "(?i)"), row.text)]
    # a text is searched once, unless its pattern looks around
    one, two = (table.select(R.matches(F.col("text"), p.regex, p.groups).alias("m"))._jdf.queryExecution().optimizedPlan().toString() for p in (R.SAME_PART, R.CHAPTER))
    assert "split(" not in one and "split(" in two


def test_white_space_of_any_kind_is_stripped(spark):
    from folioworks.operators import refs as R

    texts = [f"{c}a{c}b{c}{c}" for c in R.WHITE] + ["", " 　", "​a﻿", "a"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(R.stripped(F.col("t"))).collect()]
    assert got == [*(f"a{c}b" for c in R.WHITE), "", "", "​a﻿", "a"]


def _as_sql(spark, folder, query, rows):
    """What a query over line items ``(order, number, part)`` lacks or has beyond its SQL."""
    import duckdb

    from folioworks.plans import pages

    line = spark.createDataFrame([(*r, 3, 5.0, "N", "O") for r in rows], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string")
    line.coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    got, want = (sorted(map(repr, map(tuple, x))) for x in (pages.QUERIES[query](spark, str(folder)).collect(), con.execute(pages.ORACLES[query]).fetchall()))
    return got, want


#: Part keys of orders, null ones too: absent, below zero, beyond 32 bits.
ODD = [(1, 1, 10), (1, 2, None), (1, 3, 60), (2, 1, None), (2, 2, None), (3, 1, -55), (3, 2, 5), (4, 1, 5_000_000_033), (4, 2, 12), (None, 1, 9), (None, 2, 41), (5, 1, -56), (6, 1, 7)]


def test_unions_of_odd_intervals(spark, tmp_path):
    """A null interval used to come first and open a piece of its own."""
    for query in ("interval_merge", "line_merge"):
        got, want = _as_sql(spark, tmp_path / query, query, ODD)
        assert got == want and len(want) > 8


def test_what_odd_masks_leave(spark, tmp_path):
    """Pages without a mask in reach used to be whole, and a null page lost its masks."""
    got, want = _as_sql(spark, tmp_path, "interval_subtract", ODD)
    assert got == want and any(x.startswith("(None") for x in want) and not any(x.startswith("(2,") for x in want)
