"""Candidate keys against counting every set of columns."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from conftest import DATA

from sparkward.operators import keys
from sparkward.operators.keys import candidate_keys, repeats


def brute(rows, names, most):
    found = []
    for size in range(1, most + 1):
        for s in combinations(range(len(names)), size):
            if not any(set(k) <= set(s) for k in found):
                if len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                    found.append(s)
    return sorted([names[i] for i in s] for s in found)


def found(df, **options):
    return sorted(r["columns"] for r in candidate_keys(df, **options).collect())


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_brute_force(spark, seed):
    draw, names = random.Random(seed), list("abcde")
    spans = [2, 3, 8, 12, 40]
    rows = list({tuple(draw.choice([None, *range(n)]) for n in spans) for _ in range(60)})
    df = spark.createDataFrame(rows, "a INT, b INT, c INT, d INT, e INT")
    for most in (2, 4):
        assert found(df, most_columns=most) == brute(rows, names, most)


def test_large_tables_count_few_rows(spark, monkeypatch):
    # 45 of 3,000 rows repeat in b: only rows that repeat in a part of (a, b, d) are counted for it.
    df = spark.range(3000).selectExpr(
        "id % 1500 AS a", "CASE WHEN id < 30 THEN id % 15 WHEN id BETWEEN 1500 AND 1514 THEN id - 1500 ELSE id END AS b",
        "IF(id >= 1500, 1, 0) AS c", "id % 15 AS d", "NULL AS n",
    )
    counted = []
    monkeypatch.setattr(keys, "_repeated", lambda rows, s, f=keys._repeated: counted.append((tuple(s), rows.count())) or f(rows, s))
    got = found(df, large_rows=0)
    assert got == brute([tuple(r) for r in df.collect()], df.columns, 3) and ["a", "c"] in got
    assert 0 < max(n for s, n in counted if s == ("a", "b", "d")) <= 45
    assert got == found(df, large_rows=10**9)


def test_nulls_change_places(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, 1)], "a INT, b INT")
    assert found(df) == [["a", "b"]]


def test_repeated_rows_leave_no_key_and_small_tables_any(spark):
    df = spark.createDataFrame([(1, 2), (1, 2)], "a INT, b INT")
    assert found(df) == [] and repeats(df, ["a", "b"])
    assert found(df.limit(1)) == found(df.limit(0)) == [["a"], ["b"]]


def test_other_types_and_odd_names(spark):
    df = spark.sql("SELECT id % 2 AS `a.b`, array(id) AS list, map(id, 1) AS m, struct(id % 3 AS x) AS s FROM range(6)")
    assert found(df) == [["a.b", "s"], ["list"]]
    with pytest.raises(ValueError):
        candidate_keys(df, ["m"])
    with pytest.raises(ValueError):
        candidate_keys(df, most_columns=0)


def test_real_tables(spark):
    supplier = spark.read.parquet(f"{DATA}/orders.parquet")
    assert ["o_orderkey"] in found(supplier, most_columns=1)
