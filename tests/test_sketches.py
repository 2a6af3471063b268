"""Heavy keys, merged bitmaps and merged sketches, against exact counts."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date

import pytest
from conftest import DATA, plan
from pyspark.sql import functions as F

from sparkward.operators import bitmaps, loads, sketches

# --- heavy keys -------------------------------------------------------------


@pytest.mark.parametrize(("cells", "rounds"), [(65_536, 3), (8, 1), (2, 2)])
def test_no_heavy_key_is_lost(spark, cells, rounds):
    draw = random.Random(4)
    rows = [(draw.choice(["a"] * 9 + [None, "b", ""] * 2 + [str(i) for i in range(40)]), draw.choice([1, None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k STRING, part INT")
    counts = Counter(rows)
    for share in (0.2, 0.02, 0.0001, 1.0):
        got = loads.heavy_keys(df, ["k", "part"], share, cells=cells, rounds=rounds).collect()
        assert {(r["k"], r["part"]): r["rows"] for r in got} == {k: n for k, n in counts.items() if n >= share * 3000}
        assert all(r["share"] == r["rows"] / 3000 for r in got)


def test_cold_keys_are_not_shuffled(spark):
    df = spark.range(100_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "id AS _n")
    heavy = loads.heavy_keys(df, ["k"], 0.01)
    assert [(r["k"], r["rows"]) for r in heavy.collect()] == [(-1, 33_334)]
    text = plan(heavy)
    assert text.count("LeftSemi") >= 3 and "SortMergeJoin" not in text


def test_heavy_keys_of_nothing(spark):
    df = spark.range(0).toDF("k")
    assert loads.heavy_keys(df, ["k"], 0.5).count() == 0
    for share in (0, 1.1, -1):
        with pytest.raises(ValueError, match="share"):
            loads.heavy_keys(df, ["k"], share)


# --- bitmaps ----------------------------------------------------------------


def counted(state):
    return {r["column"]: (r["rows"], r["distinct_values"], r["duplicates"]) for r in bitmaps.uniqueness(state).collect()}


def exact(rows, at):
    values = [r[at] for r in rows]
    distinct = len({v for v in values if v is not None})
    return len(values), distinct, len(values) - distinct


def test_merged_bitmaps_are_exact(spark):
    draw = random.Random(8)
    edges = [0, 1, -1, 32_767, 32_768, 32_769, -32_768, -32_769, 65_536, 2**62, -(2**62), None]
    rows = [(draw.choice(edges), draw.choice([None, *range(-50, 50)])) for _ in range(400)]
    loads_of = [rows[:100], rows[100:130], rows[130:]]
    state = None
    for number, load in enumerate(loads_of, 1):
        new = bitmaps.distinct_state(spark.createDataFrame(load, "a LONG, b INT"), ["a", "b"])
        state = new if state is None else bitmaps.merge_states(state, new)
        seen = [r for part in loads_of[:number] for r in part]
        assert counted(state) == {"a": exact(seen, 0), "b": exact(seen, 1)}


def test_bitmaps_of_odd_tables(spark):
    empty = spark.createDataFrame([], "a LONG")
    assert counted(bitmaps.distinct_state(empty, ["a"])) == {}
    nulls = spark.createDataFrame([(None,)] * 3, "a LONG")
    assert counted(bitmaps.distinct_state(nulls, ["a"])) == {"a": (3, 0, 3)}
    with pytest.raises(ValueError, match="whole numbers"):
        bitmaps.distinct_state(spark.createDataFrame([("x",)], "a STRING"), ["a"])


def test_dense_numbers(spark):
    df = spark.range(1000).selectExpr("id", "id * 1000 AS spread", "CAST(NULL AS LONG) AS nothing")
    assert bitmaps.is_dense(df, "id") and bitmaps.is_dense(df, "nothing")
    assert not bitmaps.is_dense(df, "spread")
    assert spark.range(0).toDF("id").transform(lambda d: bitmaps.distinct_state(d, ["id"])).isEmpty()


def test_a_load_reads_one_column(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    assert "ReadSchema: struct<o_custkey:bigint>" in plan(bitmaps.distinct_state(orders, ["o_custkey"]))


# --- sketches ---------------------------------------------------------------


def days_of(spark, values, null_time=0):
    """``{day of January: values}`` as a table of ``t`` and ``v``."""
    rows = [(f"2024-01-{d:02d} 10:00:00", v) for d, vs in values.items() for v in vs] + [(None, 1.0)] * null_time
    return spark.createDataFrame(rows, "t STRING, v DOUBLE").select(F.col("t").cast("timestamp").alias("t"), "v")


def test_days_merge_to_the_whole(spark):
    df = spark.range(60_000).selectExpr(
        "timestamp_seconds(1704067200 + id) AS t", "CAST(pmod(xxhash64(id), 10007) AS DOUBLE) AS v"
    )
    daily = sketches.daily_sketches(df.repartition(7), "t", "v")
    whole = sketches.merge_sketches(daily).select(
        "rows", "nulls", *[sketches.quantile(F.col("quantiles"), q).alias(str(q)) for q in (0.1, 0.5, 0.99)],
        sketches.distinct_values(F.col("values")).alias("distinct"),
    ).first()
    assert (whole["rows"], whole["nulls"]) == (60_000, 0)
    for q in (0.1, 0.5, 0.99):
        below = df.where(F.col("v") <= whole[str(q)]).count() / 60_000
        assert abs(below - q) < 0.005
    assert abs(whole["distinct"] - df.select("v").distinct().count()) < 0.06 * 10_007


def test_drift_of_days(spark):
    draw = random.Random(2)
    values = {d: [draw.gauss(100, 10) for _ in range(500)] for d in range(1, 13)}
    values[9] = [v + 15 for v in values[9]]
    values[11] = [None] * 5
    daily = sketches.daily_sketches(days_of(spark, values, null_time=2), "t", "v")
    found = {r["day"]: r for r in sketches.sketch_drift(daily, max_distance=0.3).collect()}
    assert [d.day for d, r in found.items() if r["drifted"]] == [9]
    assert found[date(2024, 1, 1)]["points"] == 0 and found[date(2024, 1, 1)]["distance"] is None
    assert found[date(2024, 1, 4)]["points"] == 3 and found[date(2024, 1, 12)]["points"] == 7
    assert found[date(2024, 1, 11)]["distance"] is None and not found[None]["drifted"]
    # The normal distribution moved by 1.5 deviations: ranks change by 0.547 at most.
    assert abs(found[date(2024, 1, 9)]["distance"] - 0.547) < 0.07
    assert all(found[date(2024, 1, d)]["distance"] < 0.15 for d in (3, 4, 5, 6, 7, 8, 10, 12))


def test_a_gap_is_no_day(spark):
    daily = sketches.daily_sketches(days_of(spark, {1: [1.0, 2.0], 5: [1.0], 20: [3.0]}), "t", "v")
    spans = {(r["day"].day, r["points"], r["rows"]) for r in sketches.rolling(daily, 5).collect()}
    assert (5, 2, 3) in spans and (9, 1, 1) in spans and (22, 1, 1) in spans and all(d != 10 for d, _, _ in spans)
    found = {r["day"].day: r for r in sketches.sketch_drift(daily).collect()}
    assert found[20]["points"] == 0 and found[5]["points"] == 1


def test_sketches_of_no_rows(spark):
    daily = sketches.daily_sketches(days_of(spark, {1: [1.0]}).limit(0), "t", "v")
    assert daily.isEmpty() and sketches.sketch_drift(daily).isEmpty()
