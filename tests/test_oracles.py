"""Every registered query against its DuckDB SQL on the small given tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
KINDS = {
    "double": "DOUBLE",
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="given tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


#: Queries of the optional subpackage have tests of their own.
MORE = entry_point.llm.queries().keys() | {"pipeline"} if entry_point.llm else set()
NAMES = sorted(set(entry_point.queries()) - MORE)


def in_order(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_query_has_an_oracle():
    assert set(NAMES) == set(entry_point.oracle_sql()) - MORE


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    frame = entry_point.queries()[name](spark, SF_DIR)
    relation = duck.sql(entry_point.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)

    kinds = dict(frame.dtypes)
    oracle_kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: KINDS[kinds[c]] for c in columns} == oracle_kinds

    found = in_order(tuple(row) for row in frame.select(*columns).collect())
    expected = in_order(relation.select(*columns).fetchall())
    assert found == expected


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 5
    assert not any(isinstance(value, datetime.datetime) for row in rows for value in row)
