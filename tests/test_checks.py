"""Checks: metrics, verdicts, specs, fusion."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

import pytest
from conftest import DATA, plan
from pyspark.sql import functions as F

from sparkward.functions import metrics
from sparkward.functions.text import fixed
from sparkward.operators.checks import measure, overall_verdict, run_suite, split_specs
from sparkward.session import FOOTER_COUNT_CONF
from sparkward.sources.specs import parse_checks, read_checks, specs_frame

AS_OF = "2024-03-02 12:00:00"


def one(df, as_of=AS_OF, **entry):
    """Result of a single check."""
    return run_suite({"t": df}, parse_checks({"t": [entry]}), as_of=as_of).first()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0), (2, "a", None), (3, None, float("nan")), (4, None, float("nan"))],
        "id INT, name STRING, amount DOUBLE",
    )


@pytest.mark.parametrize(
    ("limit", "passed"), [(0.5, True), (0.51, True), (0.49, False), (0, False), (1, True)]
)
def test_null_rate_against_limits(rows, limit, passed):
    result = one(rows, type="null_rate", column="name", max_null_rate=limit)
    assert (result["metric_value"], result["passed"]) == (0.5, passed)
    assert result["threshold"] == float(limit)
    assert result["detail"] == f"null_rate=0.5000 threshold={limit:.4f}"


def test_nan_is_a_value_and_null_is_none(rows):
    assert one(rows, type="null_rate", column="amount", max_null_rate=0)["metric_value"] == 0.25
    # 1.0 and NaN are the two values of four rows.
    assert one(rows, type="uniqueness", column="amount")["metric_value"] == 2.0


def test_every_null_counts_as_surplus(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id INT")
    result = one(df, type="uniqueness", column="id")
    assert (result["metric_value"], result["passed"], result["threshold"]) == (1.0, False, 0.0)


def test_uniqueness_counts_surplus_rows_not_values(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (2,)], "id INT")
    result = one(df, type="uniqueness", column="id", max_duplicates=3)
    assert (result["metric_value"], result["passed"]) == (3.0, True)
    assert result["detail"] == "duplicate_count=3 threshold=3"


@pytest.mark.parametrize(
    ("newest", "hours", "passed"),
    [
        ("2024-03-02 12:00:00", 0.0, True),
        ("2024-03-02 11:00:01", 0.0, True),
        ("2024-03-01 11:00:01", 24.0, True),
        ("2024-03-01 11:00:00", 25.0, False),
        ("2024-02-29 12:00:00", 48.0, False),
        ("2024-03-02 17:58:00", -5.0, True),
        ("2024-03-02 12:30:00", 0.0, True),
    ],
)
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_freshness_in_whole_hours(spark, kind, newest, hours, passed):
    df = spark.createDataFrame([(newest,), ("2020-01-01 00:00:00",), (None,)], "ts STRING").select(
        F.col("ts").cast(kind)
    )
    result = one(df, type="freshness", column="ts", max_age_hours=24)
    assert (result["metric_value"], result["passed"]) == (hours, passed)
    assert result["detail"] == f"age_hours={hours:.2f} threshold=24.00"


def test_freshness_of_dates_and_of_nothing(spark):
    df = spark.createDataFrame([("2024-03-01",)], "d STRING").select(F.col("d").cast("date"))
    assert one(df, type="freshness", column="d", max_age_hours=36)["metric_value"] == 36.0
    empty = one(df.where("false"), type="freshness", column="d", max_age_hours=1e9)
    assert empty["metric_value"] == float("inf") and not empty["passed"]
    assert empty["detail"].startswith("age_hours=inf ")


def test_age_of_instants_ignores_clock_changes(spark, conf):
    """Clocks went forward in New York on 2024-03-10 at 07:00 UTC."""
    df = spark.createDataFrame([(datetime(2024, 3, 10, 5, tzinfo=timezone.utc),)], "ts TIMESTAMP")
    wall = spark.createDataFrame([("2024-03-10 02:30:00",)], "ts STRING").select(
        F.col("ts").cast("timestamp_ntz")
    )
    conf("spark.sql.session.timeZone", "America/New_York")
    late = "2024-03-10T09:00:00Z"
    assert one(df, late, type="freshness", column="ts", max_age_hours=9)["metric_value"] == 4.0
    # 02:30 does not exist in that zone; as wall-clock time it is just a value.
    result = one(wall, "2024-03-10 04:30:00", type="freshness", column="ts", max_age_hours=9)
    assert result["metric_value"] == 2.0


@pytest.mark.parametrize(("minimum", "passed"), [(1, True), (4, True), (5, False), (0, True)])
def test_row_count(rows, minimum, passed):
    result = one(rows, type="row_count", min_rows=minimum)
    assert (result["metric_value"], result["passed"], result["column"]) == (4.0, passed, None)
    assert result["detail"] == f"row_count=4 min_rows={minimum}"


def test_empty_table(rows):
    empty = rows.where("false")
    assert one(empty, type="null_rate", column="name", max_null_rate=0)["passed"]
    assert one(empty, type="uniqueness", column="id")["passed"]
    assert not one(empty, type="row_count", min_rows=1)["passed"]
    assert one(empty, type="row_count", min_rows=0)["passed"]


def test_verdict_of_a_failing_suite(spark, rows):
    specs = parse_checks(
        {
            "t": [
                {"type": "null_rate", "column": "id", "max_null_rate": 0.1},
                {"type": "row_count", "min_rows": 1_000_000},
            ],
            "u": [{"type": "row_count", "min_rows": 1}],
        }
    )
    results = run_suite({"t": rows, "u": rows}, specs)
    assert [r["passed"] for r in results.orderBy("check_id").collect()] == [True, False, True]
    tables = spark.createDataFrame([("t",), ("u",), ("none",)], '"table" STRING'.replace('"', "`"))
    verdicts = {r["table"]: tuple(r)[1:] for r in overall_verdict(results, tables).collect()}
    assert verdicts == {"t": (False, 2, 1), "u": (True, 1, 0), "none": (True, 0, 0)}


@pytest.mark.parametrize(
    ("entry", "message"),
    [
        ({"type": "null_rate", "max_null_rate": 0.1}, "needs a 'column'"),
        ({"type": "null_rate", "column": "a"}, "needs 'max_null_rate'"),
        ({"type": "freshness", "column": "a"}, "needs 'max_age_hours'"),
        ({"type": "row_count"}, "needs 'min_rows'"),
        ({"type": "row_count", "min_rows": float("nan")}, "not a number"),
        ({"column": "a"}, "has no 'type'"),
        (
            {"type": "regex", "column": "a"},
            r"Unknown check type 'regex'; expected one of \['freshness', 'null_rate', "
            r"'row_count', 'uniqueness'",
        ),
    ],
)
def test_specs_are_validated_before_any_scan(entry, message):
    with pytest.raises(ValueError, match=message):
        parse_checks({"t": [entry]})


def test_other_mistakes_are_errors(spark, rows):
    with pytest.raises(ValueError, match="No checks given"):
        parse_checks({"t": []})
    with pytest.raises(ValueError, match="No column 'nope'"):
        one(rows, type="uniqueness", column="nope")
    with pytest.raises(ValueError, match="holds no times"):
        one(rows, type="freshness", column="name", max_age_hours=1)
    with pytest.raises(ValueError, match="needs 'as_of'"):
        one(rows.withColumn("d", F.lit("2024-01-01").cast("date")), None,
            type="freshness", column="d", max_age_hours=1)
    with pytest.raises(ValueError, match="No table 'x'"):
        run_suite({"t": rows}, parse_checks({"x": [{"type": "row_count", "min_rows": 1}]}))


def test_nested_and_dotted_columns(spark):
    df = spark.sql("SELECT named_struct('b', CAST(NULL AS INT)) AS a, 1 AS `x.y`")
    assert one(df, type="null_rate", column="a.b", max_null_rate=0)["metric_value"] == 1.0
    assert one(df, type="null_rate", column="x.y", max_null_rate=0)["metric_value"] == 0.0


def test_specs_from_a_file(spark, folder):
    os.makedirs(folder)
    entries = [
        {"table": "t", "type": "null_rate", "column": "a", "max_null_rate": 0.1},
        {"table": "t", "type": "uniqueness", "column": "b"},
        {"table": "u", "type": "row_count", "min_rows": 5},
    ]
    with open(f"{folder}/specs.json", "w") as out:
        out.writelines(json.dumps(entry) + "\n" for entry in entries)
    specs = read_checks(spark, f"{folder}/specs.json")
    assert [(s.check_id, s.table, s.check_type, s.column, s.threshold) for s in specs] == [
        (0, "t", "null_rate", "a", 0.1), (1, "t", "uniqueness", "b", 0.0),
        (2, "u", "row_count", None, 5.0),
    ]
    assert [tuple(r) for r in specs_frame(spark, specs).collect()] == [
        (0, "t", "null_rate", "a", 0.1), (1, "t", "uniqueness", "b", 0.0),
        (2, "u", "row_count", None, 5.0),
    ]


def test_a_check_of_ones_own(rows):
    metrics.register_check(
        metrics.Check(
            name="mean_value",
            parameter="min_mean",
            metric=lambda t: F.avg(t.column),
            verdict=metrics.at_least,
            detail=lambda m, t: F.concat(F.lit("mean="), fixed(m, 1)),
        )
    )
    try:
        with pytest.raises(ValueError, match="already registered"):
            metrics.register_check(metrics.get_check("mean_value"))
        result = one(rows, type="mean_value", column="id", min_mean=2)
        assert (result["metric_value"], result["passed"], result["detail"]) == (
            2.5, True, "mean=2.5",
        )
    finally:
        del metrics._REGISTRY["mean_value"]


LINEITEM = {
    "lineitem": [
        {"type": "row_count", "min_rows": 1},
        {"type": "null_rate", "column": "l_tax", "max_null_rate": 0},
        {"type": "freshness", "column": "l_shipdate", "max_age_hours": 1},
        {"type": "uniqueness", "column": "l_orderkey"},
        {"type": "uniqueness", "column": "l_suppkey"},
    ]
}


def test_fused_suite_equals_single_checks(spark):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet")
    specs = parse_checks(LINEITEM)
    fused = {tuple(r) for r in run_suite({"lineitem": df}, specs, as_of=AS_OF).collect()}
    alone = {
        tuple(run_suite({"lineitem": df.repartition(7)}, [spec], as_of=AS_OF).first())
        for spec in specs
    }
    assert fused == alone and len(fused) == 5


def test_one_scan_for_all_metrics_without_a_distinct_count(spark):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet")
    specs = parse_checks({"lineitem": LINEITEM["lineitem"][:3]})
    text = plan(run_suite({"lineitem": df}, specs, as_of=AS_OF))
    assert text.count("Scan parquet") == 2  # once in the tree, once in the details
    assert "ReadSchema: struct<l_tax:double,l_shipdate:timestamp_ntz>" in text
    assert "Python" not in text and "hashpartitioning" not in text


def test_distinct_columns_are_aggregated_apart(spark):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet")
    text = plan(run_suite({"lineitem": df}, parse_checks(LINEITEM), as_of=AS_OF))
    assert "Expand" not in text
    assert "ReadSchema: struct<l_orderkey:bigint>" in text
    assert "ReadSchema: struct<l_suppkey:bigint>" in text


def test_wide_suites_are_cut_into_several_scans(spark, rows):
    entries = [{"type": "null_rate", "column": "name", "max_null_rate": i / 200} for i in range(150)]
    specs = parse_checks({"t": entries})
    assert [len(group) for group in split_specs(specs)] == [60, 60, 30]
    results = run_suite({"t": rows}, specs).collect()
    assert sorted(r["check_id"] for r in results) == list(range(150))
    assert sum(r["passed"] for r in results) == 50


def test_counts_come_from_footers_if_the_session_allows(spark, conf):
    for name, value in FOOTER_COUNT_CONF.items():
        conf(name, value)
    df = spark.read.parquet(f"{DATA}/lineitem.parquet")
    specs = parse_checks(LINEITEM)
    text = plan(measure({"lineitem": df}, specs, as_of=AS_OF))
    assert "PushedAggregation: [COUNT(*), COUNT(l_tax)]" in text
    pushed = {tuple(r) for r in measure({"lineitem": df}, specs, as_of=AS_OF).collect()}
    scanned = measure({"lineitem": df}, specs, as_of=AS_OF, footer_counts=False)
    assert pushed == {tuple(r) for r in scanned.collect()}


def test_number_texts(spark):
    values = [0.125, 2.5, float("inf"), float("-inf"), float("nan"), -3.0]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    assert [r[0] for r in df.select(fixed(F.col("v"), 2)).collect()] == [
        "0.12", "2.50", "inf", "-inf", "nan", "-3.00",
    ]
    assert df.select(fixed(F.col("v"), 0)).collect()[1][0] == "2"
