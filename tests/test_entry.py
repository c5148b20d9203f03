"""Driver contract: entry runs, every query has a callable, oracles are strings."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"query_id", "rank", "chunk_id", "url", "citation", "distance"}


def test_registry_shape():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 60
    assert set(o) <= set(q)
