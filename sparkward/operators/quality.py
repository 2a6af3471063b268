"""Quality over time: trends, drift, anomalies, profiles, contracts, reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkward.functions.metrics import get_check
from sparkward.operators.checks import metric_column, split_specs
from sparkward.operators.selection import met, same
from sparkward.session import local_frame, stored
from sparkward.sources.specs import CheckSpec

# --- trends -----------------------------------------------------------------


def trend(df: DataFrame, time: str, specs: Sequence[CheckSpec]) -> DataFrame:
    """Every check's metric per day: ``(table, check_type, column, day, metric_value)``.

    Grouped like a suite: metrics without a distinct count share one scan, each
    distinct column has its own. Days are few and may be large, so everything
    is aggregated before the shuffle. Ages are measured at the end of each day.
    """
    dated = df.withColumn("_day", F.to_date(F.col(time)))
    parts = [_measure_days(dated, group) for group in split_specs(specs)]
    return reduce(DataFrame.unionByName, parts)


def _measure_days(dated: DataFrame, group: Sequence[CheckSpec]) -> DataFrame:
    # Inside an aggregate of the day, any value of the day's end is the same.
    end_of_day = F.max(F.date_add("_day", 1))
    rows = [
        F.struct(
            F.lit(spec.table).alias("table"),
            F.lit(spec.check_type).alias("check_type"),
            F.lit(spec.column).cast("string").alias("column"),
            metric_column(dated, spec, end_of_day).cast("double").alias("metric_value"),
        )
        for spec in group
    ]
    daily = dated.groupBy(F.col("_day").alias("day")).agg(F.inline(F.array(*rows)))
    return daily.select("table", "check_type", "column", "day", "metric_value")


def _series() -> WindowSpec:
    return Window.partitionBy("table", "check_type", "column").orderBy("day")


def null_drift(trends: DataFrame, max_change: float) -> DataFrame:
    """Change of each daily null rate against the day before, flagged if too large."""
    change = F.col("metric_value") - F.col("previous")
    return (
        trends.where(F.col("check_type") == "null_rate")
        .withColumn("previous", F.lag("metric_value").over(_series()))
        .withColumn("change", change)
        .withColumn(
            "drifted", F.coalesce(F.abs(F.col("change")) > F.lit(max_change), F.lit(False))
        )
    )


def anomalies(
    trends: DataFrame, *, window: int = 7, min_points: int = 3, max_score: float = 3.0
) -> DataFrame:
    """Distance of each day from the ``window`` days before it, in deviations.

    Days with fewer than ``min_points`` before them are never flagged. After a
    constant baseline any change is one.
    """
    before = _series().rowsBetween(-window, -1)
    value, mean, spread = F.col("metric_value"), F.col("baseline"), F.col("spread")
    enough = F.col("points") >= min_points
    # Beyond rounding: equal values may leave a tiny deviation.
    steady = spread <= F.abs(mean) * F.lit(1e-12)
    moved = F.abs(value - mean) > F.abs(mean) * F.lit(1e-12)
    return (
        trends.withColumn("points", F.count("metric_value").over(before))
        .withColumn("baseline", F.avg("metric_value").over(before))
        .withColumn("spread", F.stddev_samp("metric_value").over(before))
        .withColumn("score", F.when(enough & ~steady, (value - mean) / spread))
        .withColumn(
            "anomalous",
            F.coalesce(
                enough & F.when(steady, moved).otherwise(F.abs("score") > F.lit(max_score)),
                F.lit(False),
            ),
        )
    )


# --- profiles ---------------------------------------------------------------

_ORDERED_TYPES = (
    T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType,
)


def _column_profile(
    name: str, data_type: T.DataType, sketch: bool, percentiles: Sequence[float]
) -> Column:
    """One profile row; values a type does not have are null."""
    column = F.col(f"`{name}`")
    ordered = isinstance(data_type, _ORDERED_TYPES)
    numeric = isinstance(data_type, T.NumericType)

    def value(has: bool, aggregate: Callable[[Column], Column], kind: str, alias: str) -> Column:
        return (aggregate(column) if has else F.lit(None)).cast(kind).alias(alias)

    fields = [
        F.lit(name).alias("column"),
        F.lit(data_type.simpleString()).alias("data_type"),
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.count(column)).alias("nulls"),
        value(ordered, F.min, "string", "min_value"),
        value(ordered, F.max, "string", "max_value"),
        value(numeric, F.avg, "double", "mean_value"),
        value(ordered and sketch, F.approx_count_distinct, "long", "distinct_values"),
    ]
    if percentiles:
        fields.append(
            value(
                numeric,
                lambda c: F.percentile_approx(c, list(percentiles)),
                "array<double>",
                "percentiles",
            )
        )
    return F.struct(*fields)


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    distinct: str = "approximate",
    percentiles: Sequence[float] = (),
) -> DataFrame:
    """One row per column: rows, nulls, minimum, maximum, mean, distinct values.

    ``distinct`` is ``approximate`` (a sketch, in the same scan), ``exact`` (one
    more aggregation per column) or ``none``. Percentiles of numeric columns are
    approximate. Minimum and maximum are given as text.
    """
    if distinct not in ("approximate", "exact", "none"):
        raise ValueError(f"Unknown distinct {distinct!r}")
    types = {name: df.schema[name].dataType for name in columns or df.columns}
    rows = [
        _column_profile(name, data_type, distinct == "approximate", percentiles)
        for name, data_type in types.items()
    ]
    profiled = df.agg(F.inline(F.array(*rows)))
    if distinct != "exact":
        return profiled
    counts = reduce(
        DataFrame.union,
        [
            df.agg(F.count_distinct(F.col(f"`{name}`")).alias("exact_values")).select(
                F.lit(name).alias("column"), "exact_values"
            )
            for name, data_type in types.items()
            if isinstance(data_type, _ORDERED_TYPES)
        ],
    )
    return (
        profiled.join(counts, "column", "left")
        .withColumn("distinct_values", F.col("exact_values"))
        .select(*profiled.columns)
    )


def suggest_checks(
    profiles: DataFrame, table: str, *, max_age_hours: float = 24.0, null_slack: float = 0.0
) -> DataFrame:
    """Check specs a profile supports, with the observed values as thresholds.

    A row count and, per column: its null rate; uniqueness where every row has
    its own value (needs exact distinct counts to be certain); freshness for times.
    """
    null_rate = F.coalesce(F.try_divide(F.col("nulls"), F.col("rows")), F.lit(0.0))
    is_time = F.col("data_type").isin("date", "timestamp", "timestamp_ntz")
    unique = (F.col("nulls") == 0) & (F.col("distinct_values") == F.col("rows"))

    def suggestion(kind: str, column: Column, threshold: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("check_type"),
            column.cast("string").alias("column"),
            threshold.cast("double").alias("threshold"),
        )

    per_column = F.array(
        suggestion("null_rate", F.col("column"), F.least(null_rate + null_slack, F.lit(1.0))),
        F.when(unique, suggestion("uniqueness", F.col("column"), F.lit(0.0))),
        F.when(is_time, suggestion("freshness", F.col("column"), F.lit(max_age_hours))),
    )
    columns = profiles.select(F.inline(F.filter(per_column, lambda s: s.isNotNull())))
    rows = profiles.groupBy().agg(F.max("rows").alias("rows"))
    count = rows.select(F.inline(F.array(suggestion("row_count", F.lit(None), F.col("rows")))))
    return columns.unionByName(count).select(F.lit(table).alias("table"), "*")


# --- contracts --------------------------------------------------------------


@dataclass(frozen=True)
class Contract:
    """Expected column types, and named conditions (Columns or SQL) every row must meet."""

    types: Mapping[str, str]
    rules: Mapping[str, Column | str]

    def broken(self) -> dict[str, Column]:
        """Per rule: is it broken? A rule that is unknown (null) for a row is."""
        return {
            name: ~F.coalesce(F.expr(rule) if isinstance(rule, str) else rule, F.lit(False))
            for name, rule in self.rules.items()
        }


def schema_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Columns that are missing, of another type, or not in the contract."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    found = []
    for name, expected in contract.types.items():
        if name not in actual:
            found.append((name, expected, None, "missing"))
        elif actual[name] != expected:
            found.append((name, expected, actual[name], "type"))
    found += [(n, None, t, "unexpected") for n, t in actual.items() if n not in contract.types]
    schema = T.StructType(
        [
            T.StructField(n, T.StringType())
            for n in ("column", "expected_type", "actual_type", "problem")
        ]
    )
    return local_frame(df.sparkSession, schema, found)


def row_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break.

    Row-local: no shuffle.
    """
    broken = F.array_compact(
        F.array(*[F.when(fails, F.lit(name)) for name, fails in contract.broken().items()])
    )
    return df.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)


def rule_report(df: DataFrame, contract: Contract) -> DataFrame:
    """Per rule: rows checked and rows breaking it, all rules in one scan."""
    broken = contract.broken()
    wide = df.agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(fails).alias(f"broken_{i}") for i, fails in enumerate(broken.values())],
    )
    rows = [
        F.struct(F.lit(n).alias("rule"), F.col("checked"), F.col(f"broken_{i}").alias("broken"))
        for i, n in enumerate(broken)
    ]
    return wide.select(F.inline(F.array(*rows)))


# --- duplicates -------------------------------------------------------------


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows and of surplus rows.

    Counted before the shuffle, so a key of any size is one row per task.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
        .withColumn("surplus", F.col("copies") - 1)
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one with the smallest ``order`` (null last).

    ``order`` must be unique within a key for the choice to be fixed. An
    aggregation rather than a ranking: no key's rows are ever brought together.
    """
    others = [c for c in df.columns if c not in keys]
    position = F.struct(F.col(order).isNull(), F.col(order))
    kept = F.min_by(F.struct(*others), position).alias("kept")
    return df.groupBy(*keys).agg(kept).select(*keys, "kept.*").select(*df.columns)


def surplus_copies(
    df: DataFrame, keys: Sequence[str], order: str, rows_per_slice: int = 100_000
) -> DataFrame:
    """The rows ``keep_first`` leaves out, with the ``order`` of the one it keeps.

    Rows are matched with their key's first row. A key with more than
    ``rows_per_slice`` rows is matched in as many slices as its number asks for,
    so that one with a third of all rows is spread over many tasks; no other is
    copied. ``order`` must be unique and not null.
    """
    names = [f"_key_{i}" for i in range(len(keys))]
    firsts = (
        df.groupBy(*[F.col(k).alias(name) for k, name in zip(keys, names, strict=True)])
        .agg(F.min(order).alias("kept"), F.count(F.lit(1)).alias("_copies"))
        .where(F.col("_copies") > 1)
        .withColumn("_slices", F.ceil(F.col("_copies") / rows_per_slice).cast("int"))
    )
    # Numbers in place of keys, so that long texts are not sent around. Keys of one number share its
    # slices on both sides.
    hot = firsts.where("_slices > 1").groupBy(F.xxhash64(*names).alias("_hash"))
    hot = stored(hot.agg(F.max("_slices").alias("_parts")), "hot")
    parts = F.coalesce("_parts", F.lit(1))
    rows = met(df.withColumn("_hash", F.xxhash64(*keys)), hot, ["_hash"], "left")
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64(order), parts).cast("int"))
    sliced = met(firsts.withColumn("_hash", F.xxhash64(*names)), hot, ["_hash"], "left")
    sliced = sliced.withColumn("_of", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hash", "_parts")
    at = same([*keys, "_slice"], [*names, "_of"])
    return rows.join(sliced, at).where(F.col(order) != F.col("kept")).select(*df.columns, "kept")


def exception_summary(results: DataFrame) -> DataFrame:
    """Checks and failures per table and kind, per table, and in all.

    ``level`` is 0 for a table and kind, 1 for a table, 3 for the whole.
    """
    return (
        results.rollup("table", "check_type")
        .agg(
            F.grouping_id().cast("long").alias("level"),
            F.count(F.lit(1)).alias("checks"),
            F.count_if(~F.col("passed")).alias("failed"),
        )
        .select("level", "table", "check_type", "checks", "failed")
    )


def with_playbook(results: DataFrame, playbook: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Failed checks with an action and an owner from ``{check_type: (action, owner)}``."""
    for check_type in playbook:
        get_check(check_type)
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("check_type", "action", "owner")]
    )
    entries = local_frame(results.sparkSession, schema, [(k, *v) for k, v in playbook.items()])
    # One entry per registered kind of check: small by construction.
    return results.where(~F.col("passed")).join(F.broadcast(entries), "check_type", "left")
