"""Every registered query against its SQL, on the smallest data."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from conftest import DATA

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as driver  # noqa: E402
from sparkward.plans.registry import REGISTERED  # noqa: E402

duckdb = pytest.importorskip("duckdb")

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def comparable(rows):
    return sorted(repr([str(v) if not isinstance(v, float) else repr(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query_equals_its_sql(spark, duck, name):
    result = driver.queries()[name](spark, DATA)
    columns = sorted(result.columns)
    rows = [tuple(r[c] for c in columns) for r in result.collect()]
    expected = duck.execute(driver.oracle_sql()[name])
    order = [d[0] for d in expected.description]
    assert sorted(order) == columns
    places = [order.index(c) for c in columns]
    assert comparable(rows) == comparable(
        tuple(r[i] for i in places) for r in expected.fetchall()
    )


def test_entry_is_the_flagship(spark):
    result = driver.entry(spark)
    assert result.columns[:4] == ["check_id", "check_type", "table", "column"]
    assert result.count() == 13


def test_every_sql_belongs_to_a_query():
    assert set(REGISTERED) <= set(driver.queries())
    assert set(REGISTERED) == set(driver.oracle_sql()) & set(REGISTERED)
