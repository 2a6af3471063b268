"""Distributions kept per day as sketches, merged over any span and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size of a quantile sketch: ranks are off by about 1.65 / K at most, in 99 of 100 cases.
QUANTILE_K = 800

# Two to this power registers of a distinct count: off by 1.04 / sqrt(2^power) as a rule.
DISTINCT_POWER = 12

_SKETCHES = ["rows", "nulls", "quantiles", "values"]


def daily_sketches(df: DataFrame, time: str, column: str, *, k: int = QUANTILE_K, power: int = DISTINCT_POWER) -> DataFrame:
    """Per day of ``time`` (null: a day of its own): ``(day, rows, nulls, quantiles, values)``, the last two sketches.

    A row of bounded size per day, made in the map tasks; days can be added as they come, and a day
    that is loaded in parts is the merge of its parts. NaN counts as a value, but has no rank.
    """
    value = F.col(column).cast("double")
    return df.groupBy(F.to_date(time).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(value.isNull()).alias("nulls"),
        F.kll_sketch_agg_double(value, k).alias("quantiles"),
        F.hll_sketch_agg(F.col(column).cast("string"), power).alias("values"),
    )


def merge_sketches(sketches: DataFrame, *by: str | Column) -> DataFrame:
    """Sketches of several days as one per ``by``, without the data."""
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("values").alias("values"),
    )


def rolling(sketches: DataFrame, days: int, *, lag: int = 0) -> DataFrame:
    """Per day, the merge of ``days`` days up to ``lag`` days before it, with their number (``points``).

    Each day's row is copied to the days that it counts for: ``days`` short rows a day, no pairs.
    """
    first, last = F.date_add("day", lag), F.date_add("day", lag + days - 1)
    spread = sketches.where(F.col("day").isNotNull()).select(F.explode(F.sequence(first, last)).alias("day"), *_SKETCHES)
    points = spread.groupBy(F.col("day").alias("_day")).agg(F.count(F.lit(1)).alias("points"))
    return merge_sketches(spread, "day").join(points, F.col("day") == F.col("_day")).drop("_day")


def _has_values(sketch: Column) -> Column:
    return F.kll_sketch_get_n_double(sketch) > 0


def quantile(sketch: Column, share: float) -> Column:
    """The value at a share of the values; null where there are none."""
    return F.when(_has_values(sketch), F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def distinct_values(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def distance(now: Column, before: Column, steps: int = 100) -> Column:
    """How far two distributions are apart: the largest change of a rank at the quantiles of ``before``.

    0 is alike, 1 disjoint; null where one of them has no values. Ranks are read off ``steps``
    quantiles of each sketch, so beside the sketches' own error they are rounded down to 1 / ``steps``.
    """
    shares = [i / steps for i in range(1, steps)]
    grid = F.array(*[F.lit(share) for share in shares])
    values, places = F.kll_sketch_get_quantile_double(now, grid), F.kll_sketch_get_quantile_double(before, grid)

    def moved(at: Column, i: Column) -> Column:
        return F.abs(F.size(F.filter(values, lambda v: v <= at)) - (i + 1)) / F.lit(float(steps))

    return F.when(_has_values(now) & _has_values(before), F.array_max(F.transform(places, moved)))


def sketch_drift(sketches: DataFrame, *, window: int = 7, max_distance: float = 0.2) -> DataFrame:
    """Each day against the ``window`` days before it: ``(day, rows, points, distance, drifted)``.

    Days without a day before them, or without values, are never flagged.
    """
    before = rolling(sketches, window, lag=1).select(
        F.col("day").alias("_day"), "points", F.col("quantiles").alias("_before")
    )
    apart = distance(F.col("quantiles"), F.col("_before"))
    return (
        sketches.join(before, F.col("day") == F.col("_day"), "left")
        .withColumn("distance", apart)
        .select(
            "day", "rows", F.coalesce("points", F.lit(0)).cast("long").alias("points"), "distance",
            F.coalesce(F.col("distance") > F.lit(max_distance), F.lit(False)).alias("drifted"),
        )
    )
