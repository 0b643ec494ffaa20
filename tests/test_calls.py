"""A stream of calls that is stopped wherever it can be: each prompt is paid for once, each row appended once."""

import pytest

from folioworks.streaming.calls import CallLedger


class Meter:
    """A model that writes down every call in a folder, and fails for some prompts."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, prompt, model):
        import os
        import uuid

        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as out:
            out.write(prompt)
        if prompt == "broken":
            raise ConnectionError("down")
        return f"{model}:{prompt}"

    def calls(self):
        import pathlib

        return sorted(p.read_text() for p in pathlib.Path(self.folder).iterdir())


def wanted(rows):
    return sorted((i, p, "[ERROR: down]" if p == "broken" else f"m:{p}") for i, p in rows)


def test_a_batch_killed_between_calls_and_append(spark, tmp_path):
    (tmp_path / "log").mkdir()
    meter = Meter(tmp_path / "log")
    one = [(i, f"p{i % 30}") for i in range(60)]
    two = [(100 + i, f"p{20 + i}") for i in range(20)] + [(200, None)]
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame(one, "i int, prompt string").coalesce(1).write.parquet(str(source / "a"))

    class Killed(CallLedger):
        def append(self, batch, number):
            raise RuntimeError("killed between the calls and the append")

    stream = lambda: spark.readStream.schema("i int, prompt string").option("recursiveFileLookup", "true").parquet(str(source))
    with pytest.raises(Exception, match="killed"):
        Killed(out, meter, "m", waits=()).start(stream(), str(tmp_path / "check")).awaitTermination()
    assert meter.calls() == sorted({p for _, p in one})
    ledger = CallLedger(out, meter, "m", waits=())
    ledger.start(stream(), str(tmp_path / "check")).awaitTermination()
    assert meter.calls() == sorted({p for _, p in one})
    assert sorted((x.i, x.prompt, x.response) for x in ledger.rows(spark).collect()) == wanted(one)
    # what an earlier batch paid for isn't paid again
    spark.createDataFrame(two[:-1], "i int, prompt string").coalesce(1).write.parquet(str(source / "b"))
    ledger.start(stream(), str(tmp_path / "check")).awaitTermination()
    assert meter.calls() == sorted({p for _, p in one + two[:-1]})
    assert sorted((x.i, x.prompt, x.response) for x in ledger.rows(spark).collect()) == wanted(one + two[:-1])


def test_a_batch_killed_amid_its_calls(spark, tmp_path):
    """Parts that were written are kept; a batch that comes again is passed over; an error is asked again by a later batch."""
    (tmp_path / "log").mkdir()
    meter, out = Meter(tmp_path / "log"), str(tmp_path / "out")
    rows = [(i, f"q{i}") for i in range(40)] + [(50, "broken")]
    batch = spark.createDataFrame(rows, "i int, prompt string")
    ledger = CallLedger(out, meter, "m", waits=(), parts=3)
    written, mode = [], ledger.paid

    def paid(session):
        if len(written) == 2:
            raise MemoryError("killed before the third part")
        written.append(1)
        return mode(session)

    ledger.paid = paid
    with pytest.raises(MemoryError):
        ledger.process(batch, 0)
    before = len(meter.calls())
    assert 0 < before < len(rows)
    ledger.paid = mode
    for _ in range(3):
        ledger.process(batch, 0)
    assert meter.calls() == sorted(p for _, p in rows)
    assert sorted((x.i, x.prompt, x.response) for x in ledger.rows(spark).collect()) == wanted(rows)
    ledger.process(batch, 1)
    assert meter.calls() == sorted([p for _, p in rows] + ["broken"])
    assert sorted((x.i, x.prompt, x.response) for x in ledger.rows(spark).collect()) == sorted(wanted(rows) * 2)
