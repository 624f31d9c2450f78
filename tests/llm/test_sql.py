"""Queries that SQL can express against that SQL, on the smallest tables."""

import os

import pytest

from meander.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = queries.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    expected = con.sql(queries.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    rows = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in found.select(*columns).collect())
