import os

import duckdb
import pytest

from tracebed.llm.queries import ORACLE, QUERIES

DATA = os.environ.get("TRACEBED_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_on_the_smallest_tables(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in ORACLE:
        con = duckdb.connect()
        con.execute(f"create view tokenized_lines as select * from '{DATA}/tokenized_lines.parquet'")
        want = con.execute(ORACLE[name])
        names = [c[0] for c in want.description]
        assert sorted(map(str, (tuple(r[n] for n in names) for r in rows))) == sorted(map(str, want.fetchall()))
