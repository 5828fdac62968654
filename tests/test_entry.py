"""The driver's contract: names agree, the flagship runs, and every SQL text belongs to a query."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 50


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["item_id", "source", "matched", "wanted", "coverage", "rank"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_streams_equal_batches(spark):
    from tracewell.plans import record_queries as q

    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert rows(q.timeline_stream(spark, SMALL)) == rows(q.attempt_timeline(spark, SMALL))
