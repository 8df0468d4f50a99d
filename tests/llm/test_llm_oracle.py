"""The queries with SQL against DuckDB on whole tables."""

import os

import duckdb
import pytest

from gridweave.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == names
    rows = sorted((tuple(map(str, r)) for r in got.select(names).collect()))
    assert len(rows) > 0 and rows == sorted(tuple(map(str, r)) for r in con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall())
