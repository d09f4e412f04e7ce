"""Every registered query against its SQL on the smallest tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import SF, TABLES
from snapgrade.plans.catalogue import QUERIES, SQL

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return str(value) if isinstance(value, decimal.Decimal) else value


def sorted_rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in data)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    wanted = oracle.execute(SQL[name])
    columns = [c[0] for c in wanted.description]
    kinds = {c[0]: str(c[1]) for c in wanted.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    assert sorted_rows(df.columns, got) == sorted_rows(columns, wanted.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
