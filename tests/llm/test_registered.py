"""Every registered query against its SQL, on the smallest data."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as driver  # noqa: E402
from sparkward.llm.queries import QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", [name for name, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = driver.queries()[name](spark, DATA)
    columns = sorted(result.columns)
    expected = duck.execute(driver.oracle_sql()[name])
    order = [d[0] for d in expected.description]
    assert sorted(order) == columns
    rows = sorted(repr([r[c] for c in columns]) for r in result.collect())
    assert rows == sorted(repr([r[order.index(c)] for c in columns]) for r in expected.fetchall())


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
