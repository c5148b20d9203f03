"""A subset of registered queries against their DuckDB oracle on sf0.001,
including the streaming ones (replay must not duplicate anything)."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as E

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
from check_oracle import digest  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = ["T1_stream_pipeline", "T2_stream_versions", "V5_new_versions", "C6_walk_pages", "R2_retrieve_topk",
         "E5_table_facts", "C2_robots_filter"]


@pytest.fixture(scope="module")
def con():
    from pagelake.sources.tables import TABLES

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    res = con.execute(E.oracle_sql()[name])
    orows, ocols = res.fetchall(), [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(rows, cols)[0] == digest(orows, ocols)[0]
