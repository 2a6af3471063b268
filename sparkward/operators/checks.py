"""Suites of checks over many tables in as few scans as possible."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkward.functions.metrics import Target, get_check, registered_checks
from sparkward.session import footer_counts_enabled
from sparkward.sources.specs import CheckSpec, specs_frame

Moment = Column | str | None

# Default of ``per_scan``: wider aggregations fall out of generated code.
METRICS_PER_AGGREGATE = 60

RESULT_COLUMNS = [
    "check_id", "check_type", "table", "column", "passed", "metric_value", "threshold", "detail",
]


def _field_type(schema: T.StructType, path: str) -> T.DataType:
    """Type of a column, or of a struct member named ``a.b``."""
    data_type: T.DataType = schema
    for part in [path] if path in schema.fieldNames() else path.split("."):
        if not isinstance(data_type, T.StructType) or part not in data_type.fieldNames():
            raise ValueError(f"No column {path!r}; the table has {schema.fieldNames()}")
        data_type = data_type[part].dataType
    return data_type


def _reference(schema: T.StructType, path: str) -> Column:
    return F.col(f"`{path}`" if path in schema.fieldNames() else path)


def metric_column(df: DataFrame, spec: CheckSpec, as_of: Moment) -> Column:
    """The aggregate Column of a spec, checked against the table's schema."""
    check = get_check(spec.check_type)
    column = data_type = None
    if check.needs_column:
        data_type = _field_type(df.schema, spec.column)
        column = _reference(df.schema, spec.column)
    if check.needs_as_of:
        if as_of is None:
            raise ValueError(f"Check {check.name!r} on {spec.table!r} needs 'as_of'")
        if not isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            raise ValueError(
                f"Check {check.name!r} on {spec.table!r}: {spec.column!r} holds no times"
            )
    moment = F.lit(as_of) if isinstance(as_of, str) else as_of
    if moment is not None:
        is_instant = isinstance(data_type, T.TimestampType)
        moment = moment.cast("timestamp" if is_instant else "timestamp_ntz")
    return check.metric(Target(column, data_type, moment))


def split_specs(
    specs: Sequence[CheckSpec],
    *,
    footer_counts: bool = False,
    per_scan: int = METRICS_PER_AGGREGATE,
) -> list[list[CheckSpec]]:
    """Group the specs of one table so that each group is one aggregation.

    Metrics without a distinct count share one scan, which needs no shuffle of
    rows. Every distinct column is aggregated on its own: it reads just that
    column and shuffles just its values, while several in one aggregation would
    make Spark copy each row once per column, and one beside other metrics
    would carry their buffers through the shuffle. With ``footer_counts`` the
    metrics that Parquet footers can answer stay apart too, so that no data
    page is read for them. More than ``per_scan`` metrics take another scan; the
    results are the same.
    """
    plain: list[CheckSpec] = []
    counts: list[CheckSpec] = []
    by_distinct: dict[tuple[str, str | None], list[CheckSpec]] = {}
    for spec in specs:
        check = get_check(spec.check_type)
        if check.distinct:
            by_distinct.setdefault((spec.check_type, spec.column), []).append(spec)
        elif check.counts_only and footer_counts:
            counts.append(spec)
        else:
            plain.append(spec)
    shared = [
        some[i : i + per_scan]
        for some in (counts, plain)
        for i in range(0, len(some), per_scan)
    ]
    return shared + list(by_distinct.values())


def scan_counts(
    spark: SparkSession, specs: Sequence[CheckSpec], *, per_scan: int = METRICS_PER_AGGREGATE
) -> dict[str, int]:
    """How often each table is read by :func:`run_suite`, in the order of the specs."""
    footers = footer_counts_enabled(spark)
    names = dict.fromkeys(spec.table for spec in specs)
    return {
        name: len(
            split_specs(
                [spec for spec in specs if spec.table == name],
                footer_counts=footers,
                per_scan=per_scan,
            )
        )
        for name in names
    }


def _measure(df: DataFrame, group: Sequence[CheckSpec], as_of: Moment) -> DataFrame:
    pairs = [
        F.struct(
            F.lit(spec.check_id).cast("long").alias("check_id"),
            metric_column(df, spec, as_of).cast("double").alias("metric_value"),
        )
        for spec in group
    ]
    return df.agg(F.inline(F.array(*pairs)))


def measure(
    tables: Mapping[str, DataFrame],
    specs: Sequence[CheckSpec],
    *,
    as_of: Moment | Mapping[str, Moment] = None,
    footer_counts: bool | None = None,
    per_scan: int = METRICS_PER_AGGREGATE,
) -> DataFrame:
    """Metrics of all specs as rows ``(check_id, metric_value)``.

    ``as_of`` is the moment freshness is measured at, one for all tables or one
    per table; it is a parameter, so that a suite gives the same answer whenever
    it is run. ``footer_counts``
    follows the session's settings unless given.
    """
    if not specs:
        raise ValueError("No checks given")
    by_table: dict[str, list[CheckSpec]] = {}
    for spec in specs:
        if spec.table not in tables:
            raise ValueError(f"No table {spec.table!r}; given are {sorted(tables)}")
        by_table.setdefault(spec.table, []).append(spec)
    parts = []
    for table, of_table in by_table.items():
        df = tables[table]
        use_footers = footer_counts
        if use_footers is None:
            use_footers = footer_counts_enabled(df.sparkSession)
        moment = as_of.get(table) if isinstance(as_of, Mapping) else as_of
        parts += [
            _measure(df, group, moment)
            for group in split_specs(of_table, footer_counts=use_footers, per_scan=per_scan)
        ]
    return reduce(DataFrame.union, parts)


def judge(
    metrics: DataFrame, specs: DataFrame, kinds: Iterable[str] | None = None
) -> DataFrame:
    """Compare metrics with their specs (joined on ``check_id``).

    The specs are what the metrics were built from, so both sides are small;
    Spark broadcasts the specs by their known size. ``kinds`` are the types of
    check that occur, all registered ones unless given.
    """
    metric, threshold = F.col("metric_value"), F.col("threshold")
    names = list(dict.fromkeys(registered_checks() if kinds is None else kinds))
    checks = {name: get_check(name) for name in names}
    return metrics.join(specs, "check_id").select(
        "check_id",
        "check_type",
        "table",
        "column",
        _by_kind({n: c.verdict(metric, threshold) for n, c in checks.items()}).alias("passed"),
        "metric_value",
        "threshold",
        _by_kind({n: c.detail(metric, threshold) for n, c in checks.items()}).alias("detail"),
    )


def _by_kind(values: Mapping[str, Column]) -> Column:
    """The value that belongs to the row's type of check."""
    first, *others = values.items()
    chosen = F.when(F.col("check_type") == first[0], first[1])
    for name, value in others:
        chosen = chosen.when(F.col("check_type") == name, value)
    return chosen


def run_suite(
    tables: Mapping[str, DataFrame],
    specs: Sequence[CheckSpec],
    *,
    as_of: Moment | Mapping[str, Moment] = None,
    footer_counts: bool | None = None,
    per_scan: int = METRICS_PER_AGGREGATE,
) -> DataFrame:
    """One result row per check; order by ``check_id`` for the given order."""
    metrics = measure(
        tables, specs, as_of=as_of, footer_counts=footer_counts, per_scan=per_scan
    )
    kinds = [spec.check_type for spec in specs]
    return judge(metrics, specs_frame(metrics.sparkSession, list(specs)), kinds)


def overall_verdict(results: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Per table: did every check pass? A table without checks passes.

    ``tables`` (a column ``table``) adds the tables that had no check at all.
    """
    verdicts = results.groupBy("table").agg(
        F.every("passed").alias("overall_passed"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("passed")).alias("failed"),
    )
    if tables is not None:
        verdicts = tables.select("table").distinct().join(verdicts, "table", "left")
    return verdicts.select(
        "table",
        F.coalesce("overall_passed", F.lit(True)).alias("overall_passed"),
        F.coalesce("checks", F.lit(0)).cast("long").alias("checks"),
        F.coalesce("failed", F.lit(0)).cast("long").alias("failed"),
    )


def suite_reports(results: DataFrame) -> DataFrame:
    """Per table one JSON text: the verdict and every result, in the given order.

    The results of a table are as many as its checks, not its rows.
    """
    fields = [name for name in RESULT_COLUMNS if name != "check_id"]
    ordered = F.array_sort(F.collect_list(F.struct("check_id", F.struct(*fields).alias("result"))))
    reports = results.groupBy("table").agg(
        F.every("passed").alias("overall_passed"), ordered.alias("ordered")
    )
    report = F.struct(
        "table",
        "overall_passed",
        F.transform("ordered", lambda entry: entry["result"]).alias("checks"),
    )
    return reports.select("table", F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))
