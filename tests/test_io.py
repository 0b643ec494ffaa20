"""Readers, writers and the streaming fold."""

import random

from pyspark.sql import functions as F

from folioworks.operators import taskqueue
from folioworks.sources import corpus, sinks
from folioworks.streaming import tasks


def test_section_folders(spark, tmp_path):
    for name, files in {"X-Pt5-Chap2-sec10": {"b.md": "second", "a.md": "first", "a_raw.md": "raw"}, "X-Pt5-Chap2-sec9": {"n.md": "nine"}, "other": {"x.md": "no"}}.items():
        (tmp_path / name).mkdir()
        for f, text in files.items():
            (tmp_path / name / f).write_text(text)
    got = corpus.sections(spark, [str(tmp_path)])
    assert {(r.section_id, r.text, r.chars) for r in got.collect()} == {("Pt5.Ch2.Sec10", "first", 5), ("Pt5.Ch2.Sec9", "nine", 4)}
    assert [r.section_id for r in corpus.listed(got, 5, 2).collect()] == ["Pt5.Ch2.Sec9", "Pt5.Ch2.Sec10"]
    assert [r.text for r in corpus.sections(spark, [str(tmp_path)], raw=True).collect()] == ["raw"]
    ids = spark.createDataFrame([("Pt5.Ch2.Sec9",), ("gone",)], "section_id string")
    assert {r.section_id: r.text for r in corpus.lookup(ids, got).collect()} == {"Pt5.Ch2.Sec9": "nine", "gone": ""}


def test_xml(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<R><DIV6 N="E" TYPE="SUBPART"><DIV8 N="217.32" TYPE="SECTION"><HEAD>H</HEAD><P>a <I>b</I> c</P></DIV8></DIV6><DIV9 N="Appendix A to Part 217"><HEAD>App</HEAD><P>x</P></DIV9></R>')
    got = corpus.xml_sections(spark, [str(tmp_path / "r.xml")]).collect()
    assert [(r.section_id, r.sec, r.appendix, r.text) for r in got] == [("Pt217.SubpartE.Sec217.32", "32", None, "H a b c"), ("Pt217.AppA", None, "A", "App x")]


def test_files_and_ranges(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2, "z": 3}\n')
    assert [r.a for r in corpus.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").where("a is not null").collect()] == [1, 2]
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert corpus.json_documents(spark, str(tmp_path / "a.json"), "a int").count() == 2
    (tmp_path / "l.csv").write_text('k,v\n1,"a, ""b""\nc"\n')
    assert corpus.ledger(spark, str(tmp_path / "l.csv"), "k int, v string").first().v == 'a, "b"\nc'
    row = spark.range(1).select(corpus.parse_range(F.lit("s3://b/k/x.pdf?bytes=2,3")).alias("r"), corpus.byte_range(F.lit(b"abcdefg"), F.lit(2), F.lit(3)).alias("c"), corpus.byte_range(F.lit(b"abcdefg"), F.lit(5), F.lit(-1)).alias("d")).first()
    assert tuple(row.r) == ("b", "k/x.pdf", 2, 3) and bytes(row.c) == b"cde" and bytes(row.d) == b"fg"


def test_runs_are_replaced(spark, tmp_path):
    out = str(tmp_path / "out")
    for run, n in (("a", 3), ("b", 2), ("a", 1)):
        sinks.append_run(spark.range(n), out, run)
    assert {r.run: r["count"] for r in spark.read.parquet(out).groupBy("run").count().collect()} == {"a": 1, "b": 2}
    sinks.write_json(spark.createDataFrame([("é", None)], "a string, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":"é","b":null}'
    sinks.discard(spark.range(3))


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"t{r.randrange(9)}", i, i, r.choice(["processing", "completed", "failed", "pending"]), r.choice([None, "w1", "w2"])) for i in range(200)]
    schema = "task_id string, ts long, seq long, status string, worker_id string"
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    events = spark.createDataFrame(rows, schema)
    want = {x.task_id: tuple(x)[1:] for x in taskqueue.fold_transitions(events).collect()}
    (tmp_path / "src").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "src"))
    query = tasks.fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("folded").start()
    import shutil

    for k in range(4):
        for part in (tmp_path / "in" / f"p{k}").glob("*.parquet"):
            shutil.move(str(part), str(tmp_path / "src" / f"{k}.parquet"))
        query.processAllAvailable()
    query.stop()
    got = {}
    for x in spark.table("folded").collect():
        if x.task_id not in got or x.applied + x.refused > got[x.task_id][2] + got[x.task_id][3]:
            got[x.task_id] = tuple(x)[1:]
    assert got == want


def test_poll_loop():
    from folioworks.streaming.tasks import poll

    queue, waits, seen = [[1, 2], [], ["bad"], []], [], []

    def work(task):
        if task == "bad":
            raise ValueError
        seen.append(task)

    lost = []
    done = poll(lambda: queue.pop(0) if queue else [], work, lambda empty: None if empty == 2 else 0.5 * empty, waits.append, lambda task, error: lost.append((task, type(error))))
    assert done == 2 and seen == [1, 2] and waits == [0.5, 0.5] and lost == [("bad", ValueError)]


def test_variants_of_sections_share_a_listing(spark, monkeypatch):
    """Each listing of the files is sent to the driver."""
    from folioworks.plans import files
    from folioworks.sources import corpus

    listings, listed = [], corpus.markdown
    monkeypatch.setattr(corpus, "markdown", lambda *args: listings.append(args) or listed(*args), raising=True)
    found = files.section_files(spark, "/root/testdata/sf0.001")
    assert len(listings) == 1
    assert {r.variant for r in found.where("text <> ''").collect()} == {"polished", "raw"}
