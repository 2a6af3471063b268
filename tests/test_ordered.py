"""Slices along an order, version histories and overlapping runs, against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import plan
from pyspark.sql import functions as F

from sparkward.operators import history
from sparkward.operators.ordered import in_order, neighbour, running_total
from sparkward.sources import runs


def test_slices_cut_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 10 < 9 THEN 'hot' ELSE concat('k', id) END AS k", "id AS at", "id % 7 AS w")
    order = ["k", "at"]
    ordered = in_order(rows, order, rows_per_slice=500)
    sizes = [r["count"] for r in ordered.groupBy("_slice").count().collect()]
    assert sum(sizes) == 5000 and len(sizes) == 10 and max(sizes) < 1000
    got = running_total(ordered, ["k"], order, "w", "total")
    got = neighbour(got, ["k"], order, ["at"], "next")
    got = neighbour(got, ["k"], order, ["at", "w"], "before", step=-1)
    expected, last, total = {}, {}, {}
    for i in range(5000):
        k = "hot" if i % 10 < 9 else f"k{i}"
        total[k] = total.get(k, 0) + i % 7
        expected[i] = [total[k], None, last.get(k)]
        if k in last:
            expected[last[k]][1] = i
        last[k] = i
    for r in got.collect():
        assert [r["total"], r["next"] and r["next"]["at"], r["before"] and r["before"]["at"]] == expected[r["at"]]
    with pytest.raises(ValueError, match="step"):
        neighbour(ordered, ["k"], order, ["at"], "x", step=2)


def test_an_empty_table_has_no_slices(spark):
    ordered = in_order(spark.range(0).selectExpr("id AS k", "id AS at"), ["k", "at"])
    assert running_total(ordered, ["k"], ["k", "at"], F.lit(1), "n").count() == 0
    assert neighbour(ordered, ["k"], ["k", "at"], ["at"], "next").isEmpty()


SCHEMA = "k STRING, at INT, a INT, b STRING"


def plain_history(changes):
    """Per key and time the largest values, None smallest, valid until the next time."""
    def rank(row):
        return [(v is not None, v if v is not None else 0) for v in row[2:]]

    best = {}
    for row in changes:
        known = best.get(row[:2])
        if known is None or rank(row) > rank(known):
            best[row[:2]] = row
    found = []
    for key in {k for k, _ in best}:
        times = sorted((at for k, at in best if k == key), key=lambda t: (t is not None, t or 0))
        for at, until in zip(times, [*times[1:], None], strict=True):
            found.append((key, *best[key, at][2:], at, until))
    return sorted(found, key=repr)


def random_changes(seed, number):
    draw = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None, ""]
    return [
        (draw.choice(keys), draw.choice([None, *range(60)]), draw.choice([None, 1, 2]), draw.choice([None, "", "x"]))
        for _ in range(number)
    ]


@pytest.mark.parametrize("few_keys", [0, 100])
def test_history_whatever_the_order_of_loads(spark, few_keys):
    changes = random_changes(3, 400)
    expected = plain_history(changes)
    batches = [changes[300:], changes[:120], changes[100:310], changes]
    known = None
    for batch in batches:
        frame = spark.createDataFrame(batch, SCHEMA)
        known = history.load_history(known, frame, ["k"], "at", few_keys=few_keys, rows_per_slice=25)
    assert known.columns == ["k", "a", "b", "valid_from", "valid_to"]
    assert sorted((tuple(r) for r in known.collect()), key=repr) == expected


def test_a_late_change_cuts_its_interval(spark):
    def load(known, *rows):
        return history.load_history(known, spark.createDataFrame(rows, SCHEMA), ["k"], "at")

    known = load(None, ("x", 1, 1, "p"), ("x", 9, 2, "q"), ("y", 5, 7, "z"))
    known = load(known, ("x", 4, 3, "r"))
    rows = {(r["k"], r["valid_from"], r["valid_to"], r["a"]) for r in known.collect()}
    assert rows == {("x", 1, 4, 1), ("x", 4, 9, 3), ("x", 9, None, 2), ("y", 5, None, 7)}
    at_five = {(r["k"], r["a"]) for r in history.as_of(known, 5).collect()}
    assert at_five == {("x", 3), ("y", 7)}
    assert history.as_of(known, 0).isEmpty()


def test_keys_without_changes_are_not_shuffled(spark, folder):
    spark.range(1000).selectExpr("id AS k", "id AS v", "1 AS valid_from", "CAST(NULL AS INT) AS valid_to").write.parquet(folder)
    known = spark.read.parquet(folder)
    changes = spark.createDataFrame([(5, 2, 50)], "k LONG, at INT, v LONG")
    text = plan(history.load_history(known, changes, ["k"], "at"))
    assert "BroadcastHashJoin LeftAnti" in text and "SortMergeJoin" not in text


def test_misuse_of_a_history(spark):
    changes = spark.createDataFrame([("x", 1, 1)], "k STRING, at INT, valid_to INT")
    with pytest.raises(ValueError, match="valid_to"):
        history.load_history(None, changes, ["k"], "at")
    with pytest.raises(ValueError, match="must have the columns"):
        history.load_history(changes, changes.drop("valid_to"), ["k"], "at")


def test_repeats_are_merged(spark):
    rows = [("x", t, 1 if t < 40 else 2 if t < 80 else 1, None) for t in range(100)] + [("y", 3, 1, None)]
    known = history.load_history(None, spark.createDataFrame(rows, SCHEMA), ["k"], "at", rows_per_slice=7)
    merged = history.without_repeats(known, ["k"], rows_per_slice=7)
    assert {(r["k"], r["a"], r["valid_from"], r["valid_to"]) for r in merged.collect()} == {
        ("x", 1, 0, 40), ("x", 2, 40, 80), ("x", 1, 80, None), ("y", 1, 3, None),
    }


def test_runs_at_once(spark):
    draw, day = random.Random(5), datetime(2024, 1, 1)
    rows = [("d", f"r{i}", s := draw.randrange(300), s + draw.randrange(-3, 40)) for i in range(400)]
    rows += [("e", "open", 5, None), ("e", "done", 2, 6), ("f", "no start", None, 9), (None, "nameless", 1, 2)]
    at = lambda m: None if m is None else day + timedelta(minutes=m)
    frame = spark.createDataFrame([(d, r, at(s), at(e)) for d, r, s, e in rows], "dag_id STRING, run_id STRING, start_date TIMESTAMP, end_date TIMESTAMP")
    spans = runs.concurrency(frame, rows_per_slice=20).collect()
    for minute in range(345):
        for dag in ("d", "e", "f", None):
            active = sum(d == dag and s is not None and s <= minute and (e is None or minute < e) for d, _, s, e in rows)
            here = [r["running"] for r in spans if r["dag_id"] == dag and r["since"] <= at(minute) and (r["until"] is None or at(minute) < r["until"])]
            assert here == ([active] if active else [])
