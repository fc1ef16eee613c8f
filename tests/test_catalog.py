"""Every registered query against its SQL check on the smallest tables."""

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from check import compare
from tideline.tables import DRIVER_TABLES


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in DRIVER_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    verdict, _, _ = compare(spark, con, DATA, name)
    assert verdict in ("ok", "rows-only"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
