"""Trends, drift, anomalies, profiles, contracts, duplicates, reports, masking, loads."""

from __future__ import annotations

import random

import pytest
from conftest import DATA, plan
from pyspark.sql import functions as F

from __spark_entry__ import queries
from sparkward.operators import loads, masking, quality
from sparkward.operators.checks import run_suite
from sparkward.operators.selection import met
from sparkward.session import stored
from sparkward.sources.specs import parse_check, parse_checks


@pytest.fixture(scope="module")
def days(spark):
    """Thirty days with ten rows each; day 20 loses half of its values."""
    rows = [
        (f"2024-01-{d:02} {h:02}:30:00", d * 100 + h, None if d == 20 and h % 2 else 1.0)
        for d in range(1, 31)
        for h in range(10)
    ]
    return spark.createDataFrame(rows, "ts STRING, id INT, value DOUBLE").select(
        F.col("ts").cast("timestamp_ntz"), "id", "value"
    )


SPECS = parse_checks(
    {
        "t": [
            {"type": "row_count", "min_rows": 1},
            {"type": "null_rate", "column": "value", "max_null_rate": 0.1},
            {"type": "uniqueness", "column": "id"},
            {"type": "freshness", "column": "ts", "max_age_hours": 24},
        ]
    }
)


def test_trend_is_each_days_metric(days):
    rows = quality.trend(days, "ts", SPECS).collect()
    assert len(rows) == 30 * 4
    by_kind = {}
    for r in rows:
        by_kind.setdefault(r["check_type"], {})[r["day"].day] = r["metric_value"]
    assert set(by_kind["row_count"].values()) == {10.0}
    assert set(by_kind["freshness"].values()) == {14.0}
    assert set(by_kind["uniqueness"].values()) == {0.0}
    assert by_kind["null_rate"][20] == 0.5 and by_kind["null_rate"][19] == 0.0


def test_trend_of_one_day_equals_the_suite(days):
    one = days.where("to_date(ts) = DATE '2024-01-20'")
    suite = run_suite({"t": one}, SPECS, as_of="2024-01-21 00:00:00").collect()
    trend = quality.trend(days, "ts", SPECS).where("day = DATE '2024-01-20'").collect()
    assert {(r["check_type"], r["metric_value"]) for r in suite} == {
        (r["check_type"], r["metric_value"]) for r in trend
    }


def test_drift_and_anomalies_find_the_day(days):
    trend = quality.trend(days, "ts", SPECS)
    drifted = quality.null_drift(trend, 0.4).where("drifted").collect()
    assert sorted((r["day"].day, r["change"]) for r in drifted) == [(20, 0.5), (21, -0.5)]
    odd = quality.anomalies(trend).where("anomalous").collect()
    assert [(r["check_type"], r["day"].day) for r in odd] == [("null_rate", 20)]


def test_scores_need_enough_days(spark):
    values = [1.0, 2.0, 3.0, 2.0, 50.0, 2.0]
    rows = [("t", "row_count", None, f"2024-01-{i + 1:02}", v) for i, v in enumerate(values)]
    trend = spark.createDataFrame(
        rows, "`table` STRING, check_type STRING, `column` STRING, day STRING, metric_value DOUBLE"
    )
    scored = quality.anomalies(trend, window=3, min_points=3, max_score=3).orderBy("day").collect()
    assert [r["points"] for r in scored] == [0, 1, 2, 3, 3, 3]
    assert [r["anomalous"] for r in scored] == [False] * 4 + [True, False]
    assert scored[3]["score"] == 0.0 and scored[2]["score"] is None


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, "b", 1.5, [1]), (2, "a", None, [2]), (2, None, 2.5, None)],
        "id INT, name STRING, amount DOUBLE, list ARRAY<INT>",
    )
    for distinct in ("approximate", "exact"):
        rows = {r["column"]: r for r in quality.profile(df, distinct=distinct).collect()}
        assert tuple(rows["id"]) == ("id", "int", 3, 0, "1", "2", pytest.approx(5 / 3), 2)
        assert tuple(rows["name"]) == ("name", "string", 3, 1, "a", "b", None, 2)
        assert tuple(rows["amount"]) == ("amount", "double", 3, 1, "1.5", "2.5", 2.0, 2)
        assert tuple(rows["list"])[:7] == ("list", "array<int>", 3, 1, None, None, None)
    halves = quality.profile(df, ["id", "name"], distinct="none", percentiles=[0.5]).collect()
    assert [(r["percentiles"], r["distinct_values"]) for r in halves] == [([2.0], None), (None, None)]
    with pytest.raises(ValueError, match="Unknown distinct"):
        quality.profile(df, distinct="some")


def test_approximate_profile_is_near_and_reads_once(spark):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet")
    approximate = quality.profile(df, ["l_orderkey", "l_quantity"], percentiles=[0.5])
    row = approximate.where("column = 'l_orderkey'").first()
    exact = df.select("l_orderkey").distinct().count()
    assert abs(row["distinct_values"] - exact) < 0.15 * exact
    assert plan(approximate).count("Scan parquet") == 2


def test_suggested_checks_hold(spark):
    df = spark.read.parquet(f"{DATA}/events.parquet")
    profile = quality.profile(df, distinct="exact")
    rows = quality.suggest_checks(profile, "events").collect()
    kinds = {(r["check_type"], r["column"]) for r in rows}
    assert {("row_count", None), ("uniqueness", "event_id"), ("freshness", "ts")} <= kinds
    assert ("uniqueness", "user_id") not in kinds
    names = {"null_rate": "max_null_rate", "uniqueness": "max_duplicates",
             "freshness": "max_age_hours", "row_count": "min_rows"}
    specs = [
        parse_check(i, "events", {"type": r["check_type"], "column": r["column"],
                                  names[r["check_type"]]: r["threshold"]})
        for i, r in enumerate(rows)
    ]
    results = run_suite({"events": df}, specs, as_of="2024-01-31 12:00:00")
    assert results.where("NOT passed").count() == 0


CONTRACT = quality.Contract(
    types={"id": "int", "name": "string", "gone": "date"},
    rules={"id_positive": "id > 0", "named": "name IS NOT NULL"},
)


def test_contract(spark):
    df = spark.createDataFrame([(1, "a", 1), (-1, None, 1), (None, "b", 1)],
                               "id INT, name STRING, extra INT")
    assert {tuple(r) for r in quality.schema_violations(df, CONTRACT).collect()} == {
        ("gone", "date", None, "missing"), ("extra", None, "int", "unexpected"),
    }
    wide = df.withColumn("id", F.col("id").cast("bigint")).withColumn("gone", F.current_date())
    assert ("id", "int", "bigint", "type") in {
        tuple(r) for r in quality.schema_violations(wide, CONTRACT).collect()
    }
    broken = quality.row_violations(df, CONTRACT).orderBy("name").collect()
    assert [r["broken_rules"] for r in broken] == [["id_positive", "named"], ["id_positive"]]
    assert {tuple(r) for r in quality.rule_report(df, CONTRACT).collect()} == {
        ("id_positive", 3, 2), ("named", 3, 1),
    }
    assert quality.schema_violations(df.select("id", "name"), quality.Contract(
        {"id": "int", "name": "string"}, {})).collect() == []


def test_duplicates_and_removal(spark):
    df = spark.createDataFrame(
        [(3, "a", "x"), (1, "a", "y"), (2, "b", "z"), (None, "a", "w"), (5, None, "p"), (4, None, "q")],
        "id INT, key STRING, other STRING",
    )
    groups = quality.duplicate_groups(df, ["key"])
    assert {tuple(r) for r in groups.collect()} == {("a", 3, 2), (None, 2, 1)}
    kept = quality.keep_first(df, ["key"], "id")
    assert kept.columns == df.columns
    assert {tuple(r) for r in kept.collect()} == {(1, "a", "y"), (2, "b", "z"), (4, None, "q")}
    assert kept.count() + groups.agg(F.sum("surplus")).first()[0] == df.count()
    assert "Window" not in plan(kept)


def test_surplus_copies_are_what_is_left_out(spark):
    df = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise((F.col("id") % 1500).cast("string")).alias("key"),
        (F.col("id") % 2).alias("part"),
    )
    kept = quality.keep_first(df, ["key", "part"], "id")
    for rows_per_slice in (100_000, 40):
        left_out = quality.surplus_copies(df, ["key", "part"], "id", rows_per_slice)
        assert left_out.count() + kept.count() == 3000
        assert left_out.select("id").intersect(kept.select("id")).count() == 0
        assert {r["kept"] for r in left_out.where("key = 'hot'").collect()} == {0, 3}
        text = plan(left_out)
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_reports(spark):
    df = spark.range(5).toDF("id")
    specs = parse_checks(
        {
            "t": [{"type": "row_count", "min_rows": 9}, {"type": "uniqueness", "column": "id"}],
            "u": [{"type": "row_count", "min_rows": 1}],
        }
    )
    results = run_suite({"t": df, "u": df}, specs)
    assert {tuple(r) for r in quality.exception_summary(results).collect()} == {
        (3, None, None, 3, 1), (1, "t", None, 2, 1), (1, "u", None, 1, 0),
        (0, "t", "row_count", 1, 1), (0, "t", "uniqueness", 1, 0), (0, "u", "row_count", 1, 0),
    }
    advised = quality.with_playbook(results, {"row_count": ("look", "me")}).collect()
    assert [(r["check_type"], r["action"], r["owner"]) for r in advised] == [
        ("row_count", "look", "me")
    ]
    with pytest.raises(ValueError, match="Unknown check type"):
        quality.with_playbook(results, {"nope": ("a", "b")})


def test_masks(spark):
    df = spark.createDataFrame([("Ab-12", 12345, 1.5), (None, 7, None)], "s STRING, n INT, d DOUBLE")
    masked = masking.mask_columns(df, {"s": "mask", "n": "last4", "d": "null"})
    assert [tuple(r) for r in masked.collect()] == [("Xx-nn", "*2345", None), (None, "7", None)]
    assert masked.schema["d"].dataType.simpleString() == "double"
    hashed = masking.mask_columns(df, {"s": "hash"}, hash_key="k").collect()
    other = masking.mask_columns(df, {"s": "hash"}, hash_key="l").collect()
    assert hashed[0]["s"] != other[0]["s"]
    with pytest.raises(ValueError, match="hash_key"):
        masking.mask_columns(df, {"s": "hash"})
    assert len(hashed[0]["s"]) == 64 and hashed[1]["s"] is None
    with pytest.raises(ValueError, match="Unknown masks"):
        masking.mask_columns(df, {"s": "rot13"})
    with pytest.raises(ValueError, match="No columns"):
        masking.mask_columns(df, {"x": "null"})


def test_row_policy(spark):
    df = spark.createDataFrame([(1, "eu"), (2, "us"), (3, None)], "id INT, region STRING")
    granted = spark.createDataFrame([("a", "eu"), ("a", "eu"), ("b", "us")], "actor STRING, r STRING")
    for actor, ids in (("a", [1]), ("b", [2]), ("c", [])):
        rows = masking.visible_rows(df, granted, actor, {"region": "r"}).collect()
        assert [r["id"] for r in rows] == ids


@pytest.mark.parametrize("few", [0, 1000])
def test_grants_reach_down(spark, few):
    draw = random.Random(6)
    edges = [(f"n{i}", f"n{draw.randrange(i)}") for i in range(1, 60)] + [(f"leaf{i}", "n3") for i in range(300)]
    edges += [("n0", "n50"), ("n7", "n12"), ("leaf5", "n1"), ("n1", "n0"), (None, "n1"), ("x", None)]
    grants = [("a", "n3"), ("a", "n3"), ("b", "n40"), ("b", "leaf1"), ("c", "nowhere"), (None, "n1"), ("d", None)]
    got = masking.inherited_grants(
        spark.createDataFrame(grants, "actor STRING, node STRING"),
        spark.createDataFrame(edges, "child STRING, parent STRING"), few=few,
    )
    expected = set()
    for actor, node in grants:
        left = [node] if actor and node else []
        while left:
            node = left.pop()
            if (actor, node) not in expected:
                expected.add((actor, node))
                left += [c for c, p in edges if p == node and c]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert masking.visible_rows(got.selectExpr("node"), got, "c", {"node": "node"}).count() == 1


def test_long_tables_are_not_broadcast(spark):
    # Spark would, by the size of their few kB of files.
    rows = stored(spark.range(100).selectExpr("id % 7 AS k", "id AS v"), "rows")
    table = stored(spark.range(7).selectExpr("id AS k"), "table")
    joined = met(rows, table, ["k"], "inner", few=6)
    assert "BroadcastHashJoin" not in plan(joined) and joined.count() == 100
    assert "BroadcastHashJoin" in plan(met(rows, table, ["k"], "inner", few=7))
    assert "BroadcastHashJoin" not in plan(queries()["row_policy_tree"](spark, DATA))


def test_grants_of_nobody(spark):
    none = spark.createDataFrame([], "actor STRING, node STRING")
    assert masking.inherited_grants(none, spark.createDataFrame([("b", "a")], "child STRING, parent STRING")).isEmpty()


MAPPING = [
    loads.Mapping("k", "key", "bigint"), loads.Mapping("v", "value", "decimal(8,2)"),
    loads.Mapping("at", "changed_on", "date"),
]


def test_incremental_load(spark):
    source = spark.createDataFrame(
        [(1, "1.005", "2024-01-01"), (1, "2.5", "2024-01-02"), (2, "3", "2024-01-01"),
         (3, "4", "2024-01-01"), (3, "5", None)],
        "k INT, v STRING, at STRING",
    )
    target = spark.createDataFrame([(2,), (2,)], "key BIGINT")
    loaded = loads.incremental_load(source, target, MAPPING, ["key"], ["changed_on"])
    assert loaded.dtypes == [("key", "bigint"), ("value", "decimal(8,2)"), ("changed_on", "date")]
    assert sorted((r["key"], str(r["value"])) for r in loaded.collect()) == [(1, "2.50"), (3, "4.00")]
    again = loads.incremental_load(
        source, target.union(loaded.select("key")), MAPPING, ["key"], ["changed_on"]
    )
    assert again.count() == 0
    assert "Window" not in plan(loaded)


def test_key_skew_reads_once(spark):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet").select(
        F.when(F.col("l_orderkey") % 3 == 0, -1).otherwise(F.col("l_orderkey")).alias("k")
    )
    top = loads.key_skew(df, ["k"], top=3)
    rows = top.collect()
    assert rows[0]["k"] == -1 and rows[0]["share"] == rows[0]["rows"] / 6000
    assert len(rows) == 3 and rows[0]["rows"] > 1500
    assert "Cartesian" not in plan(top) and "NestedLoop" not in plan(top)


def test_files_behind_the_mark_are_skipped(spark, folder):
    rows = spark.range(100).selectExpr("id", "id DIV 10 AS day", "DATE_ADD(DATE '2024-01-01', CAST(id DIV 10 AS INT)) AS at")
    rows = rows.union(spark.sql("SELECT 100L, 10L, CAST(NULL AS DATE)"))
    rows.write.partitionBy("day").parquet(folder)
    source = spark.read.parquet(folder)
    mark = loads.high_water_mark(source.where("day < 7"), "at")
    behind = loads.changed_since(source, "at", mark)
    assert sorted(r["id"] for r in behind.collect()) == [*range(60, 101)]
    assert "PushedFilters: [Or(GreaterThanOrEqual(at,2024-01-07),IsNull(at))]" in plan(behind)
    assert loads.high_water_mark(source.where("false"), "at") is None
    assert loads.changed_since(source, "at", None) is source
    later = loads.changed_since(source, "id", 98)
    assert sorted(r["id"] for r in later.collect()) == [98, 99, 100]


def test_rows_that_come_later_with_the_mark_are_loaded(spark):
    mapping = [loads.Mapping("k", "key", "bigint"), loads.Mapping("at", "at", "bigint")]
    target = spark.createDataFrame([(1, 10), (2, 20)], "key LONG, at LONG")
    source = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 21), (5, 19)], "k LONG, at LONG")
    behind = loads.changed_since(source, "at", loads.high_water_mark(target, "at"))
    loaded = loads.incremental_load(behind, target, mapping, ["key"], ["at"])
    assert sorted(map(tuple, loaded.collect())) == [(3, 20), (4, 21)]


def test_violations_of_a_schema(spark):
    df = spark.createDataFrame([(1, "x")], "a INT, b STRING")
    contract = quality.Contract(types={"a": "bigint", "c": "string"}, rules={})
    found = {tuple(r) for r in quality.schema_violations(df, contract).collect()}
    assert found == {
        ("a", "bigint", "int", "type"), ("c", "string", None, "missing"), ("b", None, "string", "unexpected"),
    }
    assert quality.schema_violations(df, quality.Contract({"a": "int", "b": "string"}, {})).isEmpty()
