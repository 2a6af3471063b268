"""Registered queries: checks, suites and quality over time."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.functions.metrics import Check, at_most, register_check, registered_checks
from sparkward.operators import bitmaps, history, keys, loads, masking, quality, sketches
from sparkward.operators.checks import overall_verdict, run_suite, suite_reports
from sparkward.plans.derived import (
    EVENTS_AS_OF,
    LABELLED_SQL,
    ORDERS_AS_OF,
    labelled_documents,
    table,
)
from sparkward.session import shared_dir, stored
from sparkward.sources.specs import CheckSpec, parse_checks
from sparkward.streaming import monitor

# How each metric and each detail text is computed in plain SQL.
_METRIC_SQL = {
    "null_rate": "coalesce((count(*) FILTER (WHERE {c} IS NULL))::DOUBLE "
    "/ NULLIF(count(*), 0), 0.0)",
    "uniqueness": "(count(*) - count(DISTINCT {c}))::DOUBLE",
    "freshness": "coalesce(date_sub('hour', max({c}), TIMESTAMP '{as_of}')::DOUBLE, "
    "'infinity'::DOUBLE)",
    "row_count": "count(*)::DOUBLE",
}
_DETAIL_SQL = {
    "null_rate": "printf('null_rate=%.4f threshold=%.4f', {m}, {t})",
    "uniqueness": "printf('duplicate_count=%.0f threshold=%.0f', {m}, {t})",
    "freshness": "printf('age_hours=%.2f threshold=%.2f', {m}, {t})",
    "row_count": "printf('row_count=%.0f min_rows=%.0f', {m}, {t})",
}


def _check_sql(spec: CheckSpec, source: str, as_of: str) -> str:
    metric = _METRIC_SQL[spec.check_type].format(c=spec.column, as_of=as_of)
    compare = ">=" if spec.check_type == "row_count" else "<="
    column = f"'{spec.column}'" if spec.column else "NULL::VARCHAR"
    threshold = f"{spec.threshold!r}::DOUBLE"
    detail = _DETAIL_SQL[spec.check_type].format(m="metric_value", t=threshold)
    return (
        f"SELECT {spec.check_id}::BIGINT AS check_id, '{spec.check_type}' AS check_type, "
        f"'{spec.table}' AS \"table\", {column} AS \"column\", "
        f"metric_value {compare} {threshold} AS passed, metric_value, "
        f"{threshold} AS threshold, {detail} AS detail "
        f"FROM (SELECT {metric} AS metric_value FROM ({source}) AS s) AS m"
    )


def suite_sql(checks: dict, sources: dict[str, str], as_of: dict[str, str]) -> str:
    return " UNION ALL ".join(
        _check_sql(spec, sources[spec.table], as_of.get(spec.table, ""))
        for spec in parse_checks(checks)
    )


_SOURCES = {
    "orders": "SELECT * FROM orders",
    "events": "SELECT * FROM events",
    "lineitem": "SELECT * FROM lineitem",
    "labelled": LABELLED_SQL,
}
_AS_OF = {"orders": ORDERS_AS_OF, "events": EVENTS_AS_OF}


def _tables(spark: SparkSession, sf_dir: str, names) -> dict[str, DataFrame]:
    return {
        name: labelled_documents(spark, sf_dir)
        if name == "labelled"
        else table(spark, sf_dir, name)
        for name in names
    }


def _suite(checks: dict):
    """A suite and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_suite(_tables(spark, sf_dir, checks), parse_checks(checks), as_of=_AS_OF)

    return run, suite_sql(checks, _SOURCES, _AS_OF)


FLAGSHIP_CHECKS = {
    "orders": [
        {"type": "row_count", "min_rows": 1000},
        {"type": "uniqueness", "column": "o_orderkey"},
        {"type": "null_rate", "column": "o_orderpriority", "max_null_rate": 0.0},
        {"type": "freshness", "column": "o_orderdate", "max_age_hours": 744},
        {"type": "uniqueness", "column": "o_custkey", "max_duplicates": 100},
    ],
    "events": [
        {"type": "row_count", "min_rows": 1_000_000},
        {"type": "uniqueness", "column": "event_id"},
        {"type": "null_rate", "column": "value", "max_null_rate": 0.01},
        {"type": "freshness", "column": "ts", "max_age_hours": 24},
    ],
    "labelled": [
        {"type": "null_rate", "column": "quality", "max_null_rate": 0.5},
        {"type": "null_rate", "column": "lang", "max_null_rate": 0.1},
        {"type": "uniqueness", "column": "doc_id"},
        {"type": "row_count", "min_rows": 100},
    ],
}

_flagship, _flagship_sql = _suite(FLAGSHIP_CHECKS)

_WIDE_CHECKS = {
    "lineitem": [
        {"type": "row_count", "min_rows": 1},
        *(
            {"type": "null_rate", "column": c, "max_null_rate": 0.0}
            for c in (
                "l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                "l_extendedprice", "l_discount", "l_shipdate",
            )
        ),
    ]
}
_DISTINCT_CHECKS = {
    "lineitem": [
        {"type": "uniqueness", "column": c, "max_duplicates": 10}
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    ]
}


def _empty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = table(spark, sf_dir, "events").where("event_id IS NULL")
    return run_suite({"empty": empty}, parse_checks(_EMPTY_CHECKS), as_of=EVENTS_AS_OF)


_EMPTY_CHECKS = {
    "empty": [
        {"type": "null_rate", "column": "value", "max_null_rate": 0.0},
        {"type": "uniqueness", "column": "event_id"},
        {"type": "freshness", "column": "ts", "max_age_hours": 1_000_000},
        {"type": "row_count", "min_rows": 0},
    ]
}
_EMPTY_SQL = suite_sql(
    _EMPTY_CHECKS,
    {"empty": "SELECT * FROM events WHERE event_id IS NULL"},
    {"empty": EVENTS_AS_OF},
)

_VERDICT_COLUMNS = (
    'bool_and(passed) AS overall_passed, count(*)::BIGINT AS checks, '
    '(count(*) FILTER (WHERE NOT passed))::BIGINT AS failed'
)


def _verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overall_verdict(_flagship(spark, sf_dir))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite_reports(_flagship(spark, sf_dir))


# Numbers are written out as one engine writes them: whole ones with ".0".
_JSON_NUMBER = (
    "CASE WHEN {v} = round({v}) THEN concat({v}::BIGINT::VARCHAR, '.0') ELSE {v}::VARCHAR END"
)
_REPORT_SQL = f"""
SELECT "table", concat('{{"table":"', "table", '","overall_passed":', bool_and(passed)::VARCHAR,
  ',"checks":[', string_agg(concat('{{"check_type":"', check_type, '","table":"', "table",
    '","column":', coalesce('"' || "column" || '"', 'null'), ',"passed":', passed::VARCHAR,
    ',"metric_value":', {_JSON_NUMBER.format(v="metric_value")},
    ',"threshold":', {_JSON_NUMBER.format(v="threshold")},
    ',"detail":"', detail, '"}}'), ',' ORDER BY check_id), ']}}') AS report
FROM ({_flagship_sql}) AS r
GROUP BY "table" """

# --- trends -----------------------------------------------------------------

_TREND_CHECKS = {
    "events": [
        {"type": "row_count", "min_rows": 0},
        {"type": "null_rate", "column": "value", "max_null_rate": 1},
        {"type": "freshness", "column": "ts", "max_age_hours": 24},
        {"type": "uniqueness", "column": "user_id"},
        {"type": "uniqueness", "column": "event_id"},
    ]
}
# Errors carry no value here, so that the null rate changes from day to day.
_SPARSE = "CASE WHEN event_type = 'error' THEN NULL ELSE value END"
_SPARSE_SQL = f"SELECT event_id, ts, user_id, {_SPARSE} AS value FROM events"


def _sparse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id", f"{_SPARSE} AS value"
    )


def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _sparse_events(spark, sf_dir)
    return quality.trend(events, "ts", parse_checks(_TREND_CHECKS))


def _day_as_text(trends: DataFrame) -> DataFrame:
    return trends.withColumn("day", F.col("day").cast("string"))


def _trend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_as_text(_trend(spark, sf_dir))


def _trend_sql(specs: list[CheckSpec]) -> str:
    parts = []
    for spec in specs:
        metric = _METRIC_SQL[spec.check_type]
        if spec.check_type == "freshness":
            metric = "date_sub('hour', max({c}), (CAST(ts AS DATE) + 1)::TIMESTAMP)::DOUBLE"
        column = f"'{spec.column}'" if spec.column else "NULL::VARCHAR"
        parts.append(
            f"SELECT '{spec.table}' AS \"table\", '{spec.check_type}' AS check_type, "
            f'{column} AS "column", CAST(CAST(ts AS DATE) AS VARCHAR) AS day, '
            f"{metric.format(c=spec.column)} AS metric_value "
            f"FROM ({_SPARSE_SQL}) AS s GROUP BY CAST(ts AS DATE)"
        )
    return " UNION ALL ".join(parts)


_TREND_SQL = _trend_sql(parse_checks(_TREND_CHECKS))
_SERIES_SQL = 'PARTITION BY "table", check_type, "column" ORDER BY day'


def _null_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_as_text(quality.null_drift(_trend(spark, sf_dir), 0.02)).withColumns(
        {name: F.round(name, 9) for name in ("metric_value", "previous", "change")}
    )


_NULL_DRIFT_SQL = f"""
WITH t AS ({_TREND_SQL}),
d AS (SELECT *, lag(metric_value) OVER ({_SERIES_SQL}) AS previous
      FROM t WHERE check_type = 'null_rate')
SELECT "table", check_type, "column", day, round(metric_value, 9) AS metric_value,
       round(previous, 9) AS previous, round(metric_value - previous, 9) AS change,
       coalesce(abs(metric_value - previous) > 0.02, false) AS drifted
FROM d"""


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.anomalies(_trend(spark, sf_dir), window=7, min_points=3, max_score=2.0)
    return _day_as_text(scored).select(
        "table", "check_type", "column", "day", "points", "anomalous",
        F.round("score", 6).alias("score"),
    )


_ANOMALY_SQL = f"""
WITH t AS ({_TREND_SQL}),
b AS (SELECT *, count(metric_value) OVER w AS points, avg(metric_value) OVER w AS baseline,
             stddev_samp(metric_value) OVER w AS spread
      FROM t WINDOW w AS ({_SERIES_SQL} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, points >= 3 AS enough, spread <= abs(baseline) * 1e-12 AS steady,
             (metric_value - baseline) / spread AS raw FROM b)
SELECT "table", check_type, "column", day, points::BIGINT AS points,
       coalesce(enough AND CASE WHEN steady
                THEN abs(metric_value - baseline) > abs(baseline) * 1e-12
                ELSE abs(raw) > 2.0 END, false) AS anomalous,
       CASE WHEN enough AND NOT steady THEN round(raw, 6) END AS score
FROM s"""


def _stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts and null rates per six hours of the events as a stream."""
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    events = reader.parquet(sf_dir).selectExpr(
        "CAST(ts AS TIMESTAMP) AS ts", f"{_SPARSE} AS value", "user_id"
    )
    windows = monitor.metric_windows(events, "ts", ["value", "user_id"], window="6 hours")
    out = shared_dir(spark, "metric-windows")
    monitor.run_to_files(windows, out, shared_dir(spark, "metric-state")).awaitTermination()
    return (
        spark.read.schema(windows.schema)
        .parquet(out)
        .withColumns(
            {
                "window_start": F.col("window_start").cast("timestamp_ntz"),
                "window_end": F.col("window_end").cast("timestamp_ntz"),
                "null_rate_value": F.round("null_rate_value", 9),
            }
        )
    )


_STREAM_WINDOWS_SQL = f"""
WITH s AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, {_SPARSE} AS value, user_id
           FROM events),
seen AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 MINUTE AS watermark FROM events)
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*)::BIGINT AS rows,
       round((count(*) - count(value))::DOUBLE / count(*), 9) AS null_rate_value,
       (count(*) - count(user_id))::DOUBLE / count(*) AS null_rate_user_id
FROM s WHERE window_start + INTERVAL 6 HOUR <= (SELECT watermark FROM seen)
GROUP BY window_start"""

# --- profiles, contracts, duplicates, reports --------------------------------

_PROFILED = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
    "value": "double", "props": "string",
}


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = quality.profile(
        _sparse_events_typed(spark, sf_dir), list(_PROFILED), distinct="exact"
    )
    return profiled.withColumn("mean_value", F.round("mean_value", 6))


def _sparse_events_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id", "event_type", f"{_SPARSE} AS value", "props"
    )


def _profile_sql() -> str:
    parts = []
    for name, data_type in _PROFILED.items():
        mean = f"round(avg({name}), 6)" if data_type in ("bigint", "double") else "NULL::DOUBLE"
        parts.append(
            f"SELECT '{name}' AS \"column\", '{data_type}' AS data_type, "
            f"count(*)::BIGINT AS rows, (count(*) - count({name}))::BIGINT AS nulls, "
            f"min({name})::VARCHAR AS min_value, max({name})::VARCHAR AS max_value, "
            f"{mean}::DOUBLE AS mean_value, count(DISTINCT {name})::BIGINT AS distinct_values "
            f"FROM (SELECT event_id, ts, user_id, event_type, {_SPARSE} AS value, props "
            "FROM events) AS s"
        )
    return " UNION ALL ".join(parts)


def _profile_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches over all columns, held against exact values: are they near?"""
    lines = table(spark, sf_dir, "lineitem")
    sketched = quality.profile(lines, distinct="approximate", percentiles=[0.25, 0.5, 0.75])
    exact = quality.profile(lines, distinct="exact").select(
        "column", F.col("distinct_values").alias("exact_values")
    )
    return sketched.join(exact, "column").select(
        "column",
        "data_type",
        "rows",
        "nulls",
        "exact_values",
        (F.abs(F.col("distinct_values") - F.col("exact_values")) <= 0.2 * F.col("exact_values")).alias("near"),
        (F.array_sort("percentiles") == F.col("percentiles")).alias("percentiles_rise"),
    )


def _profile_approx_sql() -> str:
    numbers = {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
        "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    }
    others = {"l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", '{kind}' AS data_type, count(*)::BIGINT AS rows, "
        f"(count(*) - count({name}))::BIGINT AS nulls, count(DISTINCT {name})::BIGINT AS exact_values, "
        f"true AS near, {'true' if name in numbers else 'NULL::BOOLEAN'} AS percentiles_rise FROM lineitem"
        for name, kind in (numbers | others).items()
    )


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = quality.profile(
        _sparse_events_typed(spark, sf_dir), list(_PROFILED), distinct="exact"
    )
    suggested = quality.suggest_checks(profiled, "events", null_slack=0.05)
    return suggested.withColumn("threshold", F.round("threshold", 9))


_RULES_SQL = f"""
WITH p AS ({_profile_sql()})
SELECT 'events' AS "table", 'null_rate' AS check_type, "column",
       round(least(nulls::DOUBLE / rows + 0.05, 1.0), 9) AS threshold FROM p
UNION ALL SELECT 'events', 'uniqueness', "column", 0.0::DOUBLE FROM p
          WHERE nulls = 0 AND distinct_values = rows
UNION ALL SELECT 'events', 'freshness', "column", 24.0::DOUBLE FROM p WHERE data_type = 'timestamp_ntz'
UNION ALL SELECT 'events', 'row_count', NULL::VARCHAR, max(rows)::DOUBLE FROM p"""


def _contract() -> quality.Contract:
    return quality.Contract(
        types={},
        rules={
            "price_positive": F.col("o_totalprice") > 1000,
            "status_closed": F.col("o_orderstatus").isin("F", "O"),
            "priority_known": ~F.col("o_orderpriority").like("%NOT SPECIFIED%"),
        },
    )


_BROKEN_SQL = {
    "price_positive": "NOT coalesce(o_totalprice > 1000, false)",
    "status_closed": "NOT coalesce(o_orderstatus IN ('F', 'O'), false)",
    "priority_known": "NOT coalesce(NOT (o_orderpriority LIKE '%NOT SPECIFIED%'), false)",
}


def _contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rule_report(table(spark, sf_dir, "orders"), _contract())


_CONTRACT_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*)::BIGINT AS checked, "
    f"(count(*) FILTER (WHERE {broken}))::BIGINT AS broken FROM orders"
    for name, broken in _BROKEN_SQL.items()
)


_ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "string", "o_orderstatus": "string", "o_clerk": "string",
    "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


def _schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that break the contract, with the rows that hold a value there."""
    orders = table(spark, sf_dir, "orders")
    found = quality.schema_violations(orders, quality.Contract(types=_ORDER_TYPES, rules={}))
    filled = quality.profile(orders, distinct="none").selectExpr("column", "rows - nulls AS filled")
    return found.join(filled, "column", "left")


def _contract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.row_violations(table(spark, sf_dir, "orders"), _contract()).select(
        "o_orderkey", F.array_join("broken_rules", ",").alias("broken_rules")
    )


_CONTRACT_ROWS_SQL = (
    "SELECT o_orderkey, concat_ws(',', "
    + ", ".join(f"CASE WHEN {broken} THEN '{name}' END" for name, broken in _BROKEN_SQL.items())
    + ") AS broken_rules FROM orders WHERE "
    + " OR ".join(_BROKEN_SQL.values())
)


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_groups(table(spark, sf_dir, "documents"), ["lang", "text"])


_DUPLICATES_SQL = (
    "SELECT lang, text, count(*)::BIGINT AS copies, (count(*) - 1)::BIGINT AS surplus "
    "FROM documents GROUP BY lang, text HAVING count(*) > 1"
)


def _keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.keep_first(documents, ["text"], "doc_id").select("doc_id", "lang", "source")


_KEEP_FIRST_SQL = """
SELECT doc_id, lang, source FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""


def _surplus_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.surplus_copies(documents, ["text"], "doc_id").select("doc_id", "lang", "kept")


_SURPLUS_COPIES_SQL = """
SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY text) AS kept FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1"""


def _exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.exception_summary(_flagship(spark, sf_dir))


_EXCEPTIONS_SQL = f"""
SELECT grouping("table", check_type)::BIGINT AS level, "table", check_type,
       count(*)::BIGINT AS checks, (count(*) FILTER (WHERE NOT passed))::BIGINT AS failed
FROM ({_flagship_sql}) AS r GROUP BY ROLLUP ("table", check_type)"""

_PLAYBOOK = {
    "null_rate": ("backfill the column from its source", "ingestion"),
    "uniqueness": ("remove surplus copies", "modelling"),
    "freshness": ("rerun the load", "operations"),
    "row_count": ("compare with the source system", "ingestion"),
}


def _playbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_playbook(_flagship(spark, sf_dir), _PLAYBOOK).select(
        "check_id", "table", "check_type", "action", "owner"
    )


_PLAYBOOK_SQL = (
    'SELECT r.check_id, r."table", r.check_type, p.action, p.owner '
    f"FROM ({_flagship_sql}) AS r LEFT JOIN (VALUES "
    + ", ".join(f"('{k}', '{a}', '{o}')" for k, (a, o) in _PLAYBOOK.items())
    + ") AS p(check_type, action, owner) ON r.check_type = p.check_type WHERE NOT r.passed"
)

# --- masking, loads ---------------------------------------------------------


def _incremental_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only lines shipped after what the target holds already are read and mapped."""
    source = table(spark, sf_dir, "lineitem")
    target = loads.apply_mapping(source.where("l_shipdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'"), _LOAD_MAPPING)
    mark = loads.high_water_mark(target, "shipped_on")
    rows = loads.incremental_load(
        loads.changed_since(source, "l_shipdate", mark), target, _LOAD_MAPPING, ["order_id"], _LOAD_ORDER
    )
    return rows.withColumns(
        {"shipped_on": F.col("shipped_on").cast("string"), "amount": F.col("amount").cast("double")}
    )


_INCREMENTAL_SINCE_SQL = """
WITH m AS (SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line,
                  l_shipdate::DATE AS shipped_on, l_extendedprice::DECIMAL(12,2) AS amount,
                  l_partkey AS part_id, l_suppkey AS supplier_id FROM lineitem),
latest AS (SELECT * FROM m WHERE shipped_on >= DATE '1997-01-01'
           QUALIFY row_number() OVER (PARTITION BY order_id
           ORDER BY shipped_on DESC, line DESC, part_id DESC, supplier_id DESC, amount DESC) = 1)
SELECT order_id, line, shipped_on::VARCHAR AS shipped_on, amount::DOUBLE AS amount, part_id,
       supplier_id
FROM latest WHERE order_id NOT IN (SELECT order_id FROM m WHERE shipped_on < DATE '1997-01-01')"""


# Of the last day that the target holds, a fifth of the orders come later, with that same day.
_LATE = "l_orderkey % 5 = 0 AND CAST(l_shipdate AS DATE) = DATE '1996-12-31'"


def _incremental_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that arrive after a load with the load's own high-water mark are loaded by the next."""
    source = table(spark, sf_dir, "lineitem")
    loaded = source.where(f"l_shipdate < TIMESTAMP_NTZ '1997-01-01 00:00:00' AND NOT ({_LATE})")
    target = loads.apply_mapping(loaded, _LOAD_MAPPING)
    mark = loads.high_water_mark(target, "shipped_on")
    rows = loads.incremental_load(
        loads.changed_since(source, "l_shipdate", mark), target, _LOAD_MAPPING, ["order_id", "line"], _LOAD_ORDER
    )
    return rows.withColumns(
        {"shipped_on": F.col("shipped_on").cast("string"), "amount": F.col("amount").cast("double")}
    )


_INCREMENTAL_TIES_SQL = f"""
WITH m AS (SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line,
                  l_shipdate::DATE AS shipped_on, l_extendedprice::DECIMAL(12,2) AS amount,
                  l_partkey AS part_id, l_suppkey AS supplier_id, {_LATE} AS late FROM lineitem),
loaded AS (SELECT * FROM m WHERE shipped_on < DATE '1997-01-01' AND NOT late),
latest AS (SELECT * FROM m WHERE shipped_on >= (SELECT max(shipped_on) FROM loaded)
           QUALIFY row_number() OVER (PARTITION BY order_id, line
           ORDER BY shipped_on DESC, line DESC, part_id DESC, supplier_id DESC, amount DESC) = 1)
SELECT order_id, line, shipped_on::VARCHAR AS shipped_on, amount::DOUBLE AS amount, part_id, supplier_id
FROM latest WHERE (order_id, line) NOT IN (SELECT (order_id, line) FROM loaded)"""


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.mask_columns(
        table(spark, sf_dir, "customer"),
        {"c_name": "mask", "c_mktsegment": "hash", "c_acctbal": "null"},
        hash_key="of the test",
    ).withColumn("c_phone", masking.MASKS["last4"](F.col("c_custkey") + 1_000_000))


_MASK_SQL = """
SELECT c_custkey,
  regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'),
    '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_name,
  c_nationkey, NULL::DOUBLE AS c_acctbal, sha256(concat('of the test', '|', c_mktsegment)) AS c_mktsegment,
  concat(repeat('*', length((c_custkey + 1000000)::VARCHAR) - 4),
         right((c_custkey + 1000000)::VARCHAR, 4)) AS c_phone
FROM customer"""


def _row_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    entitlements = table(spark, sf_dir, "nation").selectExpr(
        "concat('agent-', CAST(n_nationkey % 7 AS STRING)) AS actor", "n_nationkey AS granted"
    )
    customers = table(spark, sf_dir, "customer")
    return masking.visible_rows(
        customers, entitlements, "agent-3", {"c_nationkey": "granted"}
    )


_ROW_POLICY_SQL = (
    "SELECT * FROM customer WHERE c_nationkey IN "
    "(SELECT n_nationkey FROM nation WHERE n_nationkey % 7 = 3)"
)


# Grants on regions, nations and customers, and what lies below what.
_GRANTS = """
SELECT concat('agent-', r_regionkey % 3) AS actor, concat('r', r_regionkey) AS node FROM {region}
UNION ALL SELECT concat('agent-', n_nationkey % 4), concat('n', n_nationkey) FROM {nation}
UNION ALL SELECT 'agent-9', concat('c', c_custkey) FROM {customer} WHERE c_acctbal > 9000"""
_BELOW = """
SELECT concat('n', n_nationkey) AS child, concat('r', n_regionkey) AS parent FROM {nation}
UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey) FROM {customer}"""


def _row_policy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers that each actor sees by a grant on them, their nation or its region."""
    region, nation, customer = (table(spark, sf_dir, name) for name in ("region", "nation", "customer"))
    grants = spark.sql(_GRANTS, region=region, nation=nation, customer=customer)
    below = spark.sql(_BELOW, nation=nation, customer=customer)
    seen = masking.inherited_grants(grants, below)
    named = customer.withColumn("node", F.concat(F.lit("c"), "c_custkey"))
    # Its files tell too little of its size to let Spark choose the join.
    return named.join(seen.hint("merge"), "node").select("actor", "c_custkey", "c_nationkey")


_ROW_POLICY_TREE_SQL = f"""
WITH g AS ({_GRANTS.format(region="region", nation="nation", customer="customer")}),
tree AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT actor, c_custkey, c_nationkey FROM tree JOIN g ON node = concat('c', c_custkey)
UNION SELECT actor, c_custkey, c_nationkey FROM tree JOIN g ON node = concat('n', c_nationkey)
UNION SELECT actor, c_custkey, c_nationkey FROM tree JOIN g ON node = concat('r', n_regionkey)"""


_LOAD_MAPPING = [
    loads.Mapping("l_orderkey", "order_id", "bigint"),
    loads.Mapping("l_linenumber", "line", "bigint"),
    loads.Mapping("l_shipdate", "shipped_on", "date"),
    loads.Mapping("l_extendedprice", "amount", "decimal(12,2)"),
    loads.Mapping("l_partkey", "part_id", "bigint"),
    loads.Mapping("l_suppkey", "supplier_id", "bigint"),
]
_LOAD_ORDER = ["shipped_on", "line", "part_id", "supplier_id", "amount"]


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = (
        table(spark, sf_dir, "orders")
        .where("o_orderstatus = 'F'")
        .select(F.col("o_orderkey").alias("order_id"))
    )
    source = table(spark, sf_dir, "lineitem")
    rows = loads.incremental_load(source, loaded, _LOAD_MAPPING, ["order_id"], _LOAD_ORDER)
    return rows.withColumns(
        {"shipped_on": F.col("shipped_on").cast("string"), "amount": F.col("amount").cast("double")}
    )


_INCREMENTAL_SQL = """
WITH m AS (SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line,
                  l_shipdate::DATE AS shipped_on, l_extendedprice::DECIMAL(12,2) AS amount,
                  l_partkey AS part_id, l_suppkey AS supplier_id FROM lineitem),
latest AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY order_id
           ORDER BY shipped_on DESC, line DESC, part_id DESC, supplier_id DESC, amount DESC) = 1)
SELECT order_id, line, shipped_on::VARCHAR AS shipped_on, amount::DOUBLE AS amount, part_id,
       supplier_id
FROM latest WHERE order_id NOT IN
  (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""


def _key_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.key_skew(table(spark, sf_dir, "lineitem"), ["l_suppkey"], top=20).withColumn(
        "share", F.round("share", 9)
    )


_KEY_SKEW_SQL = """
SELECT l_suppkey, count(*)::BIGINT AS rows,
       round(count(*)::DOUBLE / (SELECT count(*) FROM lineitem), 9) AS share
FROM lineitem GROUP BY l_suppkey ORDER BY rows DESC, l_suppkey LIMIT 20"""


def _own_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check of one's own, registered next to the given ones and run in the same scan."""
    if "mean" not in registered_checks():
        register_check(
            Check(
                name="mean",
                parameter="max_mean",
                metric=lambda target: F.avg(target.column),
                verdict=at_most,
                detail=lambda metric, threshold: F.concat(F.lit("mean "), F.round(metric, 4).cast("string")),
            )
        )
    specs = parse_checks(
        {
            "lineitem": [
                {"type": "mean", "column": "l_quantity", "max_mean": 10},
                {"type": "mean", "column": "l_discount", "max_mean": 0.5},
                {"type": "row_count", "min_rows": 1},
            ]
        }
    )
    results = run_suite({"lineitem": table(spark, sf_dir, "lineitem")}, specs)
    return results.select(
        "check_type", "column", "passed", F.round("metric_value", 6).alias("metric_value"), "threshold"
    )


_OWN_CHECK_SQL = """
SELECT 'mean' AS check_type, 'l_quantity' AS "column", avg(l_quantity) <= 10 AS passed,
       round(avg(l_quantity), 6)::DOUBLE AS metric_value, 10.0::DOUBLE AS threshold FROM lineitem
UNION ALL SELECT 'mean', 'l_discount', avg(l_discount) <= 0.5, round(avg(l_discount), 6), 0.5 FROM lineitem
UNION ALL SELECT 'row_count', NULL, count(*) >= 1, count(*)::DOUBLE, 1.0 FROM lineitem"""

_SCHEMA_SQL = """
SELECT 'o_custkey' AS "column", 'string' AS expected_type, 'bigint' AS actual_type,
       'type' AS problem, count(o_custkey)::BIGINT AS filled FROM orders
UNION ALL SELECT 'o_clerk', 'string', NULL, 'missing', NULL"""


def _load_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as versions: closed ones first, then all again with those that fall between them."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", "o_totalprice", "o_orderkey", F.to_date("o_orderdate").alias("ordered_on")
    )
    keys = ["o_custkey"]
    first = stored(history.load_history(None, orders.where("o_orderstatus = 'F'"), keys, "ordered_on"), "history")
    both = history.load_history(first, orders, keys, "ordered_on")
    return both.withColumns({c: F.col(c).cast("string") for c in (history.VALID_FROM, history.VALID_TO)})


_LOAD_HISTORY_SQL = """
WITH versions AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE
  ORDER BY o_orderstatus DESC, o_totalprice DESC, o_orderkey DESC) = 1)
SELECT o_custkey, o_orderstatus, o_totalprice, o_orderkey, o_orderdate::DATE::VARCHAR AS valid_from,
  (lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate))::VARCHAR AS valid_to
FROM versions"""


def _heavy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with 1.4 times the lines of an average part."""
    share = 1.4 / table(spark, sf_dir, "part").count()
    heavy = loads.heavy_keys(table(spark, sf_dir, "lineitem"), ["l_partkey"], share)
    return heavy.withColumn("share", F.round("share", 9))


_HEAVY_KEYS_SQL = """
SELECT l_partkey, count(*)::BIGINT AS rows, round(count(*)::DOUBLE / (SELECT count(*) FROM lineitem), 9) AS share
FROM lineitem GROUP BY l_partkey
HAVING count(*) >= 1.4::DOUBLE / (SELECT count(*) FROM part) * (SELECT count(*)::DOUBLE FROM lineitem)"""


def _incremental_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of the orders after each of three loads, each of which reads its own rows only."""
    orders, state, after = table(spark, sf_dir, "orders"), None, []
    for number, status in enumerate(("F", "O", "P"), 1):
        load = bitmaps.distinct_state(orders.where(F.col("o_orderstatus") == status), ["o_orderkey", "o_custkey"])
        state = stored(load if state is None else bitmaps.merge_states(state, load), "bitmaps")
        after.append(bitmaps.uniqueness(state).withColumn("loads", F.lit(number)))
    return after[0].unionByName(after[1]).unionByName(after[2])


_INCREMENTAL_UNIQUENESS_SQL = " UNION ALL ".join(
    f"""SELECT '{column}' AS "column", count(*)::BIGINT AS rows, count(DISTINCT {column})::BIGINT AS distinct_values,
  (count(*) - count(DISTINCT {column}))::BIGINT AS duplicates, {number} AS loads
FROM orders WHERE o_orderstatus IN ({statuses}) HAVING count(*) > 0"""
    for number, statuses in enumerate(("'F'", "'F', 'O'", "'F', 'O', 'P'"), 1)
    for column in ("o_orderkey", "o_custkey")
)


# Values ten times as large on two days.
_SPIKED = "CASE WHEN day(ts) IN (20, 27) THEN value * 10 ELSE value END"


def _sketch_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift by sketches of days, and whether the sketches of three days are near the exact values."""
    events = table(spark, sf_dir, "events").select("ts", F.expr(_SPIKED).alias("value"))
    daily = stored(sketches.daily_sketches(events, "ts", "value"), "sketches")
    spans = sketches.rolling(daily, 3)
    estimates = spans.select(
        F.col("day").alias("_day"),
        *[sketches.quantile(F.col("quantiles"), q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.9))],
        sketches.distinct_values(F.col("values")).alias("estimate"),
    )
    # What the sketches stand for, counted exactly: each event counts for three days.
    days = F.explode(F.sequence(F.to_date("ts"), F.date_add(F.to_date("ts"), 2)))
    exact = events.select(days.alias("_day"), "value").join(F.broadcast(estimates), "_day").groupBy("_day")
    near_rank = [
        F.abs(F.avg((F.col("value") <= F.col(f"q{i}")).cast("int")) - q) <= 0.01 + 2 / F.count("value")
        for i, q in enumerate((0.1, 0.5, 0.9))
    ]
    distinct = F.count_distinct("value")
    near_count = F.abs(F.max("estimate") - distinct) <= 0.08 * distinct + 1
    near = exact.agg((near_rank[0] & near_rank[1] & near_rank[2] & near_count).alias("near"))
    drift = sketches.sketch_drift(daily, max_distance=0.45)
    found = drift.join(near, F.col("day") == F.col("_day"))
    return found.select(F.col("day").cast("string"), "rows", "points", "drifted", "near")


_QUANTILES_SQL = ", ".join(str(i / 100) for i in range(1, 100))
_SKETCH_DRIFT_SQL = f"""
WITH e AS (SELECT ts::DATE AS day, {_SPIKED} AS value FROM events),
days AS (SELECT day, count(*)::BIGINT AS rows FROM e GROUP BY day),
base AS (SELECT d.day, count(DISTINCT e.day)::BIGINT AS points, quantile_disc(e.value, [{_QUANTILES_SQL}]) AS marks
  FROM days d JOIN e ON e.day BETWEEN d.day - 7 AND d.day - 1 GROUP BY d.day),
places AS (SELECT day, unnest(marks) AS mark, unnest([{_QUANTILES_SQL}]) AS q FROM base),
ranks AS (SELECT p.day, p.q, avg((e.value <= p.mark)::INT) AS below FROM places p JOIN e ON e.day = p.day GROUP BY ALL),
apart AS (SELECT day, max(abs(below - q)) AS distance FROM ranks GROUP BY day)
SELECT d.day::VARCHAR AS day, d.rows, coalesce(b.points, 0) AS points, coalesce(a.distance > 0.45, false) AS drifted,
  true AS near FROM days d LEFT JOIN base b ON b.day = d.day LEFT JOIN apart a ON a.day = d.day"""


_KEY_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate",
]


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest sets of up to three columns that identify a line."""
    found = keys.candidate_keys(table(spark, sf_dir, "lineitem"), _KEY_COLUMNS)
    return found.select(F.array_join("columns", ",").alias("columns"), "size", "rows")


def _keys_sql() -> str:
    """Every set counted, and of those that are keys the ones without a smaller key inside."""
    sets = [s for size in (1, 2, 3) for s in combinations(_KEY_COLUMNS, size)]
    counted = " UNION ALL ".join(
        f"SELECT {[*s]!r} AS names, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM lineitem)) AS n"
        for s in sets
    )
    return (
        f"WITH counted AS ({counted}), total AS (SELECT count(*) AS r FROM lineitem), "
        "k AS (SELECT names, r FROM counted, total WHERE n = r) "
        "SELECT array_to_string(names, ',') AS columns, len(names)::BIGINT AS size, r::BIGINT AS rows FROM k "
        "WHERE NOT EXISTS (SELECT 1 FROM k AS s WHERE len(s.names) < len(k.names) AND list_has_all(k.names, s.names))"
    )


QUERIES = {
    "dq_suite": (_flagship, _flagship_sql),
    "dq_null_rate": _suite(
        {
            "labelled": [
                {"type": "null_rate", "column": "quality", "max_null_rate": 0.1},
                {"type": "null_rate", "column": "toxic", "max_null_rate": 1},
                {"type": "null_rate", "column": "lang", "max_null_rate": 0},
            ]
        }
    ),
    "dq_uniqueness": _suite(
        {
            "labelled": [
                {"type": "uniqueness", "column": "text"},
                {"type": "uniqueness", "column": "doc_id"},
            ],
            "orders": [{"type": "uniqueness", "column": "o_orderkey"}],
        }
    ),
    "dq_freshness": _suite(
        {"events": [{"type": "freshness", "column": "ts", "max_age_hours": 48}]}
    ),
    "dq_freshness_dates": _suite(
        {
            "orders": [
                {"type": "freshness", "column": "o_orderdate", "max_age_hours": 743},
                {"type": "freshness", "column": "o_orderdate", "max_age_hours": 744},
            ]
        }
    ),
    "dq_row_count": _suite({"lineitem": [{"type": "row_count", "min_rows": 60_000}]}),
    "dq_empty_table": (_empty_table, _EMPTY_SQL),
    "dq_null_counts_as_dup": _suite(
        {"labelled": [{"type": "uniqueness", "column": "quality", "max_duplicates": 10}]}
    ),
    "dq_fused": _suite(_WIDE_CHECKS),
    "dq_many_distinct": _suite(_DISTINCT_CHECKS),
    "dq_verdict": (
        _verdict,
        f'SELECT "table", {_VERDICT_COLUMNS} FROM ({_flagship_sql}) AS r GROUP BY "table"',
    ),
    "dq_report": (_report, _REPORT_SQL),
    "quality_trend": (_trend_rows, _TREND_SQL),
    "quality_stream_windows": (_stream_windows, _STREAM_WINDOWS_SQL),
    "quality_null_drift": (_null_drift, _NULL_DRIFT_SQL),
    "quality_anomaly": (_anomalies, _ANOMALY_SQL),
    "quality_profile": (_profile, _profile_sql()),
    "quality_profile_approx": (_profile_approx, _profile_approx_sql()),
    "quality_rules": (_rules, _RULES_SQL),
    "quality_keys": (_keys, _keys_sql()),
    "quality_contract": (_contract_report, _CONTRACT_SQL),
    "quality_contract_rows": (_contract_rows, _CONTRACT_ROWS_SQL),
    "quality_duplicates": (_duplicates, _DUPLICATES_SQL),
    "quality_keep_first": (_keep_first, _KEEP_FIRST_SQL),
    "quality_surplus_copies": (_surplus_copies, _SURPLUS_COPIES_SQL),
    "quality_exceptions": (_exceptions, _EXCEPTIONS_SQL),
    "quality_playbook": (_playbook, _PLAYBOOK_SQL),
    "mask_columns": (_mask, _MASK_SQL),
    "row_policy": (_row_policy, _ROW_POLICY_SQL),
    "row_policy_tree": (_row_policy_tree, _ROW_POLICY_TREE_SQL),
    "incremental_since": (_incremental_since, _INCREMENTAL_SINCE_SQL),
    "incremental_ties": (_incremental_ties, _INCREMENTAL_TIES_SQL),
    "load_history": (_load_history, _LOAD_HISTORY_SQL),
    "key_skew_sketch": (_heavy_keys, _HEAVY_KEYS_SQL),
    "dq_uniqueness_incremental": (_incremental_uniqueness, _INCREMENTAL_UNIQUENESS_SQL),
    "quality_sketch_drift": (_sketch_drift, _SKETCH_DRIFT_SQL),
    "quality_schema": (_schema_report, _SCHEMA_SQL),
    "dq_own_check": (_own_check, _OWN_CHECK_SQL),
    "incremental_load": (_incremental, _INCREMENTAL_SQL),
    "key_skew": (_key_skew, _KEY_SKEW_SQL),
}
