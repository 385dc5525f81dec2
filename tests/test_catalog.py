"""Every registered query against its SQL on the small tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entries
import catalog

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
QUERIES = catalog.QUERIES


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    found = QUERIES[name](spark, TABLES)
    names = sorted(found.columns)
    rows = sorted(repr([plain(row[c]) for c in names]) for row in found.collect())
    assert rows
    sql = entries.oracle_sql().get(name)
    if sql is None:
        return
    result = oracle.execute(sql)
    columns = [column[0] for column in result.description]
    assert sorted(columns) == names
    expected = [dict(zip(columns, row, strict=True)) for row in result.fetchall()]
    assert rows == sorted(repr([plain(row[c]) for c in names]) for row in expected)


def test_entry(spark):
    assert entries.entry(spark).count() > 0
