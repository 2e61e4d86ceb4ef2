"""Every registered analysis against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_point
import oracle_texts
from compare import TABLES, same_rows

FOLDER = "/root/testdata/sf0.001"
ORACLE = oracle_texts.oracle_sql()
OWN = [query.__name__ for query in entry_point._QUERIES]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(OWN) == set(ORACLE)
    assert set(OWN) <= set(entry_point.queries()) and set(ORACLE) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, name):
    got = entry_point.queries()[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    assert same_rows(got, db.execute(ORACLE[name]).df()) == ""


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() == 1
