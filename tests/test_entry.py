"""The driver's contract: every query has a stable schema, and its SQL names a query."""

import __spark_entry__


def test_names():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert len(known) > 70


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["tier", "correct", "total", "accuracy"]
