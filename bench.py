"""Time the headline queries and print one line of JSON.

Reads ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) on
``local[BENCH_CPUS]``. Each query is run once to warm up and then three times;
the median counts. Besides the queries the line holds what fusing saves: the
same checks in one suite and one by one.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from sparkward.operators.checks import run_suite
from sparkward.plans.registry import REGISTERED
from sparkward.sources.specs import parse_checks

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "dq_suite", "dq_fused", "dq_many_distinct", "dq_verdict",
    "policy_decision", "policy_read_only", "policy_allow_list",
    "audit_events", "audit_recent", "audit_retention", "audit_retention_per_actor",
    "audit_table", "audit_table_recent", "audit_stream_windows",
    "governed_query", "governed_join", "governed_rollup", "governed_window",
    "objects_list", "runs_status", "runs_service_levels",
    "quality_trend", "quality_anomaly", "quality_profile", "quality_contract_rows",
    "quality_duplicates", "quality_keep_first", "quality_surplus_copies",
    "mask_columns", "incremental_load", "key_skew",
]

_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
_EIGHT = [
    {"type": "row_count", "min_rows": 1},
    {"type": "freshness", "column": "l_shipdate", "max_age_hours": 1},
    *({"type": "null_rate", "column": c, "max_null_rate": 0} for c in _COLUMNS[:6]),
]


def make_session() -> SparkSession:
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    session = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        # Debugging aid that records the Python call site of every expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def seconds(action) -> float:
    times = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 4)


def run_all(df: DataFrame) -> None:
    """Compute every row and column, keeping none."""
    df.write.format("noop").mode("overwrite").save()


def fusion(spark: SparkSession) -> dict[str, float]:
    """Suites over ``lineitem`` in one go, and the same checks one by one."""
    tables = {"lineitem": spark.read.parquet(f"{SF_DIR}/lineitem.parquet")}

    def suite(entries):
        run_all(
            run_suite(tables, parse_checks({"lineitem": entries}), as_of="2002-01-01 00:00:00")
        )

    def one_by_one(entries):
        for entry in entries:
            suite([entry])

    def unique(count):
        return [{"type": "uniqueness", "column": c} for c in _COLUMNS[:count]]

    return {
        "suite_of_8": seconds(lambda: suite(_EIGHT)),
        "8_checks_one_by_one": seconds(lambda: one_by_one(_EIGHT)),
        "uniqueness_of_1": seconds(lambda: suite(unique(1))),
        "uniqueness_of_4": seconds(lambda: suite(unique(4))),
        "uniqueness_of_11": seconds(lambda: suite(unique(11))),
        "uniqueness_of_11_one_by_one": seconds(lambda: one_by_one(unique(11))),
    }


def main() -> None:
    spark = make_session()
    queries = {}
    for name in HEADLINE:
        run, _ = REGISTERED[name]
        queries[name] = seconds(lambda: run_all(run(spark, SF_DIR)))
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
        "fusion": fusion(spark),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
