"""Every query that has SQL against that SQL on the smallest tables, but those of the subpackage for training data."""

import os

import pytest

from meander import queries

DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "supplier", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, db, name):
    found = queries.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    assert sorted(db.sql(queries.ORACLES[name]).columns) == columns
    expected = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in found.select(*columns).collect())


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(queries.ORACLES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
