"""Published values, and small cases that were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from folioworks.functions import model_calls
from folioworks.functions import text as X
from folioworks.operators import audit, geometry, grading, layout, ordered, refs, retrieve, stats, tables, taskqueue


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("k", "n", "low", "high"),
    [(2261, 2313, 97.06, 98.28), (1107, 1117, 98.36, 99.51), (198, 200, 96.43, 99.73), (76, 79, 89.42, 98.70), (453, 478, 92.39, 96.43), (526, 564, 90.89, 95.05), (2088, 2143, 96.67, 98.02)],
)
def test_wilson(spark, k, n, low, high):
    a, b = stats.wilson(F.lit(k), F.lit(n))
    assert (round(one(spark, a), 2), round(one(spark, b), 2)) == (low, high)


def test_rule_of_three_and_pool(spark):
    assert round(one(spark, stats.rule_of_three(F.lit(446))), 2) == 0.67
    assert round(one(spark, stats.rule_of_three(F.lit(122))), 2) == 2.46
    assert one(spark, stats.rule_of_three(F.lit(0))) is None
    assert one(spark, stats.pool_after(F.lit(837), F.lit(2), F.lit(1), F.lit(7))) == 827


def test_kappa_of_a_known_table(spark):
    rows = [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15 + [(None, "y")]
    got = stats.kappa_ac1(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert got.n == 50 and got.po == pytest.approx(0.7) and got.kappa == pytest.approx(0.4)
    assert got.ac1 == pytest.approx((0.7 - 2 * 0.55 * 0.45) / (1 - 2 * 0.55 * 0.45))


def test_judgements(spark):
    raw = {
        "clean": '{"a": 1}', "fenced": '```json\n{"a": 2}\n```', "thought": '<think>{"a": 9}</think>{"a": 3}', "prose": 'Well: {"a": 4} so.', "none": "no object", "cut": '{"a": ',
    }
    rows = spark.createDataFrame(list(raw.items()), "k string, raw string").select("k", grading.parse_judgement(F.col("raw"), "a int").alias("p")).collect()
    got = {r.k: (r.p.value.a if r.p.value else None, r.p.error) for r in rows}
    assert got == {"clean": (1, None), "fenced": (2, None), "thought": (3, None), "prose": (4, None), "none": (None, "parse_fail"), "cut": (None, "parse_fail")}


def test_strict_needs_facts(spark):
    rows = [(1, [(True,), (True,)]), (2, [(True,), (False,)]), (3, []), (4, [(None,)])]
    got = spark.createDataFrame(rows, "i int, v array<struct<present:boolean>>").select("i", grading.derived_strict(F.col("v")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {1: True, 2: False, 3: False, 4: False}


def test_references(spark):
    text = "See Pt.3 Ch.2 Sec.1 [4.1.2], Sec.9 [a], Ch.2 Sec.7 and Ch.5 Sec.3 [b]; Pt 3 Ch 2 Sec 1 without; Sec.4 [own]."
    rows = spark.createDataFrame([("S", 5, 2, 4, text)], "section_id string, pt int, ch int, sec int, text string")
    got = refs.corpus1_edges(rows).collect()
    assert sorted((r.pattern_no, r.target_clause, text[r.char_offset : r.char_offset + len(r.raw)] == r.raw) for r in got) == [
        (1, "Pt3.Ch2.Sec1.[4.1.2]", True), (2, "Pt5.Ch2.Sec9.[a]", True), (3, "Pt5.Ch5.Sec3.[b]", True),
    ]
    other = [
        ("Pt217.SubpartA.Sec217.1", "A", "1", None, "as in § 217.2(a)(1) and § 217.99, 12 CFR part 225, 12 CFR 225.8, 12 CFR 217.3; subpart B of this part; subpart b of this part; appendix A to this part; paragraph (c)(1) of this section"),
        ("Pt217.SubpartB.Sec217.2", "B", "2", None, ""), ("Pt217.AppA", None, None, "A", ""),
    ]
    found = refs.corpus2_edges(spark.createDataFrame(other, "section_id string, subpart string, sec string, appendix string, text string")).collect()
    assert sorted((r.kind, r.target, r.tier_hint) for r in found) == [
        ("appendix_ref", "Pt217.AppA", 3), ("cross_part", "Pt225", 4), ("cross_part", "Pt225.Sec225.8", 4), ("cross_subpart", "Pt217.SubpartB.Sec217.2", 3), ("same_section_paragraph", "Pt217.SubpartA.Sec217.1", 1), ("subpart_rep", "Pt217.SubpartB.Sec217.2", 3),
    ]


def test_quotes(spark):
    verdicts = [("q", "wrong_value", "two  words"), ("q", "wrong_value", "absent"), ("q", "verified", ""), ("q", None, ""), ("z", "wrong_value", "two")]
    got = audit.verify_quotes(spark.createDataFrame(verdicts, "k string, verdict string, quote string"), spark.createDataFrame([("q", "has two words here")], "k string, text string"), "k").collect()
    assert [(r.checked, r.quote_verified) for r in got] == [("wrong_value", True), ("uncertain", False), ("verified", False), ("uncertain", False), ("uncertain", False)]


def test_leaks_and_loose_references(spark):
    """Texts on both sides of the patterns."""
    leaks = lambda t: one(spark, refs.leak_scan(F.lit(t)))
    assert [leaks(t) for t in ("Part217", "12CFR 3", "according  to", "( a ) ( 1", "section 2170", "apart 217", "under§ 3")] == [["Part217"], ["12CFR"], ["according  to"], ["( a ) ( 1"], [], [], ["§ 3"]]
    loose = lambda t: one(spark, refs.loose_references(F.lit(t), F.lit(5), F.lit(2), F.lit("Pt5.Ch2.Sec1")))
    assert loose("Ch.2Sec.3 [a]") == [] and loose("Sec.3 [a], Sec.1 [b] and Sec.4") == ["Pt5.Ch2.Sec3"]
    assert loose("Pt.3 Ch.6 Sec.7") == ["Pt3.Ch6.Sec7", "Pt5.Ch6.Sec7"] and loose("Ch.3 Sec.7  [x]") == ["Pt5.Ch3.Sec7"]
    rows = spark.createDataFrame([("S", 5, 2, 4, "see Ch.3 Sec.7  and")], "section_id string, pt int, ch int, sec int, text string")
    assert [r.raw for r in refs.corpus1_edges(rows).collect()] == ["Ch.3 Sec.7  "]


def test_characters_and_intervals(spark):
    chars = spark.createDataFrame([("p", 1, 0, "a", 5.0, 6.0), ("p", 1, 1, "b", 0.0, 1.0), ("p", 1, 2, "c", 9.0, 10.0)], "page string, span_ix int, char_idx int, ch string, x0 double, x1 double")
    assert [r.content for r in layout.chars_to_text(chars, ["page"]).collect()] == ["ab c"]
    span = [("p", 7, 0.0, 0.0, 100.0, 10.0), ("p", 8, 0.0, 1.0, 100.0, 11.0)]
    marks = [(0, "a", 50.0, 60.0), (1, "a", 98.0, 106.0), (2, "-", 98.0, 106.0), (3, ".", 89.0, 113.0), (4, "(", -4.0, 3.0), (5, "(", -30.0, 11.0), (6, "。", 101.0, 104.0)]
    boxes = spark.createDataFrame([("p", i, c, a, 2.0, b, 8.0) for i, c, a, b in marks], "page string, char_idx int, ch string, x0 double, y0 double, x1 double, y1 double")
    got = geometry.assign_chars(boxes, spark.createDataFrame(span, "page string, span_ix int, x0 double, y0 double, x1 double, y1 double"), ["page"], 5.0)
    assert {r.char_idx: r.span_ix for r in got.collect()} == {0: 7, 2: 7, 4: 7}
    whole = spark.createDataFrame([("p", 0, 10)], "page string, lo int, hi int")
    left = lambda *masks: [(r.lo, r.hi) for r in geometry.subtract_intervals(whole, spark.createDataFrame([("p", *m) for m in masks], whole.schema), ["page"]).orderBy("lo").collect()]
    assert left((3, 5)) == [(0, 2), (6, 10)] and left((0, 4), (6, 10)) == [(5, 5)] and left((20, 30)) == [(0, 10)] and left((-3, 12)) == []


def test_recall_and_packing(spark):
    assert one(spark, retrieve.recall(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) == 0.5
    assert one(spark, retrieve.recall(F.array(F.lit("a")), F.array().cast("array<string>"))) is None
    rows = spark.createDataFrame([("q", i, n) for i, n in enumerate((50, 40, 30, 5))], "q string, i int, n int")
    assert [r.i for r in retrieve.pack_until_overflow(rows, "q", ["i"], "n", 100).collect()] == [0, 1]
    assert [(r.i, r.taken) for r in retrieve.pack_with_tail(rows, "q", ["i"], "n", 100, 0, None).orderBy("i").collect()] == [(0, 50), (1, 40), (2, 10)]


def test_geometry(spark):
    boxes = [("p", 0, 0.0, 0.0, 10.0, 10.0, 0.9), ("p", 1, 0.0, 0.0, 10.0, 10.0, 0.9), ("p", 2, 2.0, 2.0, 4.0, 4.0, 0.5), ("p", 3, 50.0, 0.0, 50.0, 9.0, 0.5)]
    b = spark.createDataFrame(boxes, "page string, pos int, x0 double, y0 double, x1 double, y1 double, score double")
    assert [r.pos for r in geometry.drop_contained(b, ["page"], "pos").collect()] == [3]
    assert [r.pos for r in geometry.iou_losers(b, ["page"], "pos").collect()] == [1]
    assert sorted(r.pos for r in ordered.drop_overlapping(b, ["page"]).collect()) == [0, 2, 3]
    assert sorted(r.pos for r in ordered.drop_smaller(b, ["page"]).collect()) == [1, 3]  # of equals the first goes
    grown = spark.createDataFrame([("p", 0, 0.0, 0.0, 10.0, 10.0, 0.9), ("p", 1, 9.0, 0.0, 10.5, 2.0, 0.5), ("p", 2, 10.1, 0.1, 10.6, 1.0, 0.5)], b.schema)
    got = ordered.absorb_smaller(grown, ["page"], 0.6).collect()
    assert [(r.pos, r.x1) for r in got] == [(0, 10.6)]
    united = ordered.union_to_fixpoint(b, ["page"]).collect()
    assert sorted(r.pos for r in united) == [0, 2, 3]
    kept = spark.createDataFrame([("p", 0, 0.0, 0.0, 10.0, 10.0, 0.5), ("p", 1, 1.0, 1.0, 4.0, 4.0, 0.9), ("p", 2, 5.0, 5.0, 9.0, 9.0, 0.8)], b.schema)
    assert sorted(r.pos for r in ordered.container_or_children(kept, ["page"]).collect()) == [1, 2]


def test_reading_order(spark):
    boxes = [("p", 0, 0.0, 0.0, 100.0, 10.0), ("p", 1, 55.0, 20.0, 100.0, 90.0), ("p", 2, 0.0, 20.0, 45.0, 50.0), ("p", 3, 0.0, 60.0, 45.0, 90.0)]
    got = ordered.xy_cut(spark.createDataFrame(boxes, "page string, pos int, x0 double, y0 double, x1 double, y1 double"), ["page"]).orderBy("read_index").collect()
    assert [r.pos for r in got] == [0, 2, 3, 1]
    touching = [("p", 0, 50.0, 0.0, 100.0, 10.0), ("p", 1, 0.0, 10.0, 40.0, 20.0), ("p", 2, 20.0, 20.0, 45.0, 30.0)]
    got = ordered.xy_cut(spark.createDataFrame(touching, "page string, pos int, x0 double, y0 double, x1 double, y1 double"), ["page"]).orderBy("read_index").collect()
    assert [r.pos for r in got] == [1, 2, 0]  # one band, as nothing lies between; columns, the left one of touching boxes
    near = ordered.text_box_order(spark.createDataFrame(boxes[1:3], "page string, pos int, x0 double, y0 double, x1 double, y1 double"), ["page"]).orderBy("read_index").collect()
    assert [r.pos for r in near] == [2, 1]


def test_captions(spark):
    rows = [("p", 0, "body", 0.0, 0.0, 10.0, 10.0), ("p", 1, "body", 0.0, 100.0, 10.0, 110.0), ("p", 2, "caption", 0.0, 12.0, 10.0, 14.0), ("p", 3, "caption", 0.0, 15.0, 10.0, 17.0)]
    got = ordered.caption_by_distance(spark.createDataFrame(rows, "page string, pos int, role string, x0 double, y0 double, x1 double, y1 double"), ["page"]).collect()
    assert {(r.caption, r.body) for r in got} == {(2, 0), (3, 0)}


def test_order_dependent_rules(spark):
    """Ties, growth and order, worked by hand."""
    schema = "page string, pos int, x0 double, y0 double, x1 double, y1 double, score double"
    frame = lambda *rows: spark.createDataFrame([("p", i, *map(float, r)) for i, r in enumerate(rows)], schema)
    boxes = lambda df: sorted((r.pos, r.x0, r.y0, r.x1, r.y1) for r in df.collect())
    equal = frame((0, 0, 10, 10, 0.5), (0, 0, 10, 10, 0.6))
    assert boxes(ordered.absorb_smaller(equal, ["page"])) == [(1, 0, 0, 10, 10)]
    united = ordered.union_to_fixpoint(frame((0, 0, 10, 10, 0.1), (0, 0, 10, 11, 0.9), (0, 0, 10, 12, 0.2)), ["page"]).collect()
    assert [(r.pos, r.y1, r.score) for r in united] == [(2, 12, 0.2)]  # the first pair goes to the end, behind the third
    held = frame((0, 0, 100, 100, 0.9), (90, 0, 110, 50, 0.3), (10, 10, 20, 20, 0.4), (10, 60, 20, 70, 0.5))
    assert boxes(ordered.container_or_children(held, ["page"])) == [(0, 0, 0, 100, 100), (1, 90, 0, 110, 50)]
    over = frame((0, 0, 100, 100, 0.9), (88, 0, 102, 50, 0.3), (10, 10, 20, 20, 0.4))
    assert boxes(ordered.container_or_children(over, ["page"])) == [(0, 0, 0, 102, 100)]
    nest = frame((0, 0, 30, 10, 1), (0, 0, 10, 10, 1), (10, 0, 20, 10, 1), (20, 0, 30, 10, 1))
    assert [r.pos for r in ordered.drop_nesting(nest, ["page"]).orderBy("pos").collect()] == [1, 2, 3]
    assert ordered.drop_nesting(nest.where("pos < 3"), ["page"]).count() == 3
    cells = [("p", 0, 0.0, 0.0, 10.0, 10.0, "a"), ("p", 1, 45.0, 1.0, 60.0, 9.0, "b"), ("p", 2, 0.0, 20.0, 5.0, 30.0, "c"), ("p", 3, 61.0, 0.0, 70.0, 10.0, "d")]
    got = ordered.gathered_rows(spark.createDataFrame(cells, "page string, pos int, x0 double, y0 double, x1 double, y1 double, content string"), ["page"]).orderBy("pos").collect()
    assert [(r.pos, r.text) for r in got] == [(0, "a   bd"), (2, "c")]
    # a body that is three times as far as the nearest one is passed over; a caption that is left goes to the nearest
    rows = [("p", 0, "body", 0.0, 0.0, 10.0, 10.0), ("p", 1, "body", 200.0, 0.0, 210.0, 10.0), ("p", 2, "caption", 0.0, 11.0, 10.0, 13.0), ("p", 3, "caption", 14.0, 0.0, 20.0, 10.0)]
    got = ordered.caption_by_distance(spark.createDataFrame(rows, "page string, pos int, role string, x0 double, y0 double, x1 double, y1 double"), ["page"]).collect()
    assert {(r.caption, r.body) for r in got} == {(2, 0), (3, 0)}
    formula = "for hatchway corners A\n$$\n\\begin{array}{l} x \\\\ & y \\end{array}\n$$\nfor hatchway corners B"
    assert ordered.split_conditions(formula) == "for hatchway corners A\n\n$$\nx\n$$\n\nfor hatchway corners B\n\n$$\ny\n$$\n"


def test_tables(spark):
    html = '<table><tr><th rowspan="2">a</th><td colspan=2>b</td></tr><tr><td>c</td><td>d <b>e</b></td></tr></table>'
    assert ordered.occupancy(html) == [(0, 1, 0, 0, "a", True), (0, 0, 1, 2, "b", False), (1, 1, 1, 1, "c", False), (1, 1, 2, 2, "d e", False)]
    assert ordered.cells_html(ordered.otsl_cells("<ched>a<lcel><nl><fcel>b<ecel><nl><ucel><fcel>c<nl>")) == '<table><tr><th colspan="2">a</th></tr><tr><td rowspan="2">b</td><td></td></tr><tr><td>c</td></tr></table>'
    assert one(spark, tables.html_text(F.lit(html))) == "a | b\nc | d e"
    grid = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    repaired = lambda rows: one(spark, tables.repaired_rows(grid(rows)))
    assert repaired([["x", "one"], ["—", "and  two"], ["y", "three"], ["-", "4.1 new"], ["", ""]]) == [["x", "one and two"], ["y", "three"], ["-", "4.1 new"]]
    assert repaired([["x", "", "c"], ["", "goes", "on"], ["", "Table 3"], ["", "Section 2"]]) == [["x", "goes on", "c"], ["", "Table 3", ""], ["", "Section 2", ""]]
    assert repaired([["", "head"], ["", "no key above"]]) == [["", "head"], ["", "no key above"]] and repaired([["a"], [""], ["b"]]) == [["a"], ["b"]]
    assert one(spark, tables.definition_table(grid([["Term", "Definition"], ["a", "b"], ["c", "d"]]))) is True
    assert one(spark, tables.structure_reason(grid([["a", "b"], ["", "d"]]))) == "too_few_cells"
    assert one(spark, tables.grid_markdown(grid([["a", "b|c"], ["d"]])).alias("m")) == "| a | b\\|c |\n| --- | --- |\n| d |  |"
    plain = [["t", "and more", "First this."]]
    assert one(spark, tables.collapsed_definitions(grid(plain))) == plain
    terms = [["Term", "Definition", "—"], ["t", "and more", "the class"], ["u", "x", ""], ["v", "y", ""], ["w", "z", ""]]
    assert one(spark, tables.collapsed_definitions(grid(terms))) == [["Term", "Definition"], ["t", "the class and more"], ["u", "x"], ["v", "y"], ["w", "z"]]
    assert one(spark, tables.definition_table(grid([["Term", "Definition", "x"], *terms[1:]]))) is False
    fragments = [["a", "b", "c", "d", "one word", "two words", "three words", "four words", "five"]] * 2
    assert one(spark, tables.low_quality(grid(fragments))) is True and one(spark, tables.low_quality(grid([r[1:8] for r in fragments]))) is False
    assert [one(spark, tables.noisy(F.lit(t))) for t in ("Page 3, DNV AS", "page 3", "x 5tr", None)] == [True, False, True, False]


def test_page_tables_merge(spark):
    first = "<table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2</td></tr></table>"
    second = "<table><tr><th>h</th><th>i</th></tr><tr><td>3</td><td>4</td></tr></table>"
    schema = "doc string, page int, is_first boolean, is_last boolean, html string, caption string, n_footnotes int, x0 double, x1 double"
    row = lambda page, html, caption="", notes=0, width=100.0: ("d", page, True, True, html, caption, notes, 0.0, width)
    merged = lambda *rows: [r.html for r in ordered.merge_page_tables(spark.createDataFrame(list(rows), schema), "doc").orderBy("page").collect()]
    whole = "<table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"
    assert merged(row(1, first), row(2, second)) == [whole, ""]
    assert merged(row(1, first, notes=1), row(2, second, "Table 1 (continued)")) == [whole, ""]
    for rows in ([row(1, first, notes=1), row(2, second)], [row(1, first), row(2, second, "Table 2")], [row(1, first), row(2, second, width=110.0)], [row(1, first), row(3, second)]):
        assert merged(*rows) == [first, second]
    assert merged(row(1, first), row(2, second, width=109.0)) == [whole, ""]


def test_paragraphs(spark):
    rows = [("b", i, x0, 10.0 * i, x1, 10.0 * i + 8, t, 0.0, 0.0, 100.0, 40.0, 300.0) for i, (x0, x1, t) in enumerate([(0.0, 30.0, "1. one."), (0.0, 40.0, "2. two."), (0.0, 35.0, "3. three.")])]
    rows += [("t", i, 0.0, 10.0 * i, 100.0 if i < 2 else 50.0, 10.0 * i + 8, "plain words", 0.0, 0.0, 100.0, 40.0, 300.0) for i in range(3)]
    got = layout.classify_paragraphs(spark.createDataFrame(rows, "block string, line int, x0 double, y0 double, x1 double, y1 double, text string, bx0 double, by0 double, bx1 double, by1 double, page_w double"), ["block"]).collect()
    assert {r.block: r.kind for r in got} == {"b": "index", "t": "text"}
    # two paragraphs' worth of indents is a list unless the first line is indented and the last one short and flush
    shape = lambda name, xs: [(name, i, a, 10.0 * i, b, 10.0 * i + 8, "words", 0.0, 0.0, 100.0, 40.0, 300.0) for i, (a, b) in enumerate(xs)]
    lines = shape("para", [(6.0, 100.0), (0.0, 50.0), (0.0, 40.0), (0.0, 30.0)]) + shape("list", [(0.0, 100.0), (0.0, 50.0), (0.0, 40.0), (0.0, 30.0)])
    got = layout.classify_paragraphs(spark.createDataFrame(lines, "block string, line int, x0 double, y0 double, x1 double, y1 double, text string, bx0 double, by0 double, bx1 double, by1 double, page_w double"), ["block"]).collect()
    assert {r.block: r.kind for r in got} == {"para": "text", "list": "list"}
    merged = lambda *ts: [r.text for r in layout.merge_lines(spark.createDataFrame([("d", i, t) for i, t in enumerate(ts)], "doc string, line int, text string"), ["doc"], "line").collect()]
    assert merged("zu-", "über", "", "A-", "B") == ["zuüber A-B"] and merged("漢字", "仮名 x") == ["漢字仮名 x"]


def test_text_functions(spark):
    assert one(spark, X.half_width(F.lit("Ａ１！"))) == "A1！" and one(spark, X.half_width(F.lit("Ａ１！"), False)) == "A1!"
    assert one(spark, X.plain_characters(F.lit("ﬁnd ﬂat"))) == "find flat"
    assert one(spark, X.safe_file_name(F.lit("../a b?.pdf"))) == "a_b_.pdf"
    assert one(spark, X.magic_type(F.lit(b"%PDF-1.7"))) == "pdf"
    assert [one(spark, X.page_range(F.lit(k), F.lit(1), F.lit(-1), F.lit(3))) for k in range(4)] == [False, True, True, False]
    assert one(spark, X.integrity_notice(F.array(*(F.lit("s") for _ in range(5))), F.lit("clean"), F.lit(0.5))) == "clean (weight 0.50): s; s; s"


def test_cached_calls(spark, tmp_path):
    log = str(tmp_path / "calls")

    def model(prompt, name):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt == "bad":
            raise ValueError("down")
        return prompt.upper()

    asked = spark.createDataFrame([("a",), ("b",), ("a",), ("bad",)], "prompt string")
    empty = spark.createDataFrame([], "cache_key string, response string")
    got, fresh = model_calls.call_model(asked, empty, model, "m", waits=())
    fresh = spark.createDataFrame(fresh.collect(), fresh.schema)
    assert sorted(r.response for r in fresh.collect()) == ["A", "B", "[ERROR: down]"]
    answered, again = model_calls.call_model(asked, fresh, model, "m", waits=(0,))
    assert sorted(r.response for r in answered.collect()) == ["A", "A", "B", "[ERROR: down]"]
    assert [r.response for r in again.collect()] == ["[ERROR: down]"]


def test_backoff(spark):
    got = taskqueue.with_backoff(spark.createDataFrame([(0,), (4,), (5,)], "attempt int")).collect()
    assert [r.wait_s for r in got] == [30, 1200, None]
