"""Every query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidewright.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, connection, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    rel = connection.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert found == sorted(tuple(repr(r[i]) for i in at) for r in rel.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
