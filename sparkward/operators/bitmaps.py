"""Exact distinct counts of whole numbers that are kept per load and merged, not counted again."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numbers that one of Spark's bitmaps covers, and its bytes.
BUCKET_VALUES = 32_768
BUCKET_BYTES = 4_096


def _refuse_other_types(df: DataFrame, columns: Sequence[str]) -> None:
    other = [c for c in columns if not isinstance(df.schema[c].dataType, T.IntegralType)]
    if other:
        raise ValueError(f"Bitmaps hold whole numbers; not so {other}")


def is_dense(df: DataFrame, column: str) -> bool:
    """Is a bitmap no larger than the numbers themselves? Counts are cheap only then.

    Identifiers that were counted up are; hashes spread over all 64 bits would take
    a bitmap of four kilobytes each. Reads one minimum, maximum and count.
    """
    _refuse_other_types(df, [column])
    low, high, number = df.agg(F.min(column), F.max(column), F.count(column)).first()
    return low is None or ((high - low) // BUCKET_VALUES + 1) * BUCKET_BYTES <= number * 8


def distinct_state(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What distinct counts of ``columns`` need: ``(column, bucket, rows, bitmap)``.

    One bitmap per column and 32,768 numbers, reduced in the map tasks; the nulls of a column
    are the row without a bucket. An empty table gives no row. Columns should be :func:`is_dense`.
    """
    _refuse_other_types(df, columns)
    states = []
    for column in columns:
        value = F.col(column).cast("long")
        grouped = df.groupBy(F.bitmap_bucket_number(value).alias("bucket"))
        states.append(
            grouped.agg(
                F.count(F.lit(1)).alias("rows"), F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bitmap")
            ).select(F.lit(column).alias("column"), "bucket", "rows", "bitmap")
        )
    return reduce(DataFrame.unionByName, states)


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of several: the rows of all loads, each number once. Each load's rows must be in one state only."""
    merged = reduce(DataFrame.unionByName, states).groupBy("column", "bucket")
    return merged.agg(F.sum("rows").alias("rows"), F.bitmap_or_agg("bitmap").alias("bitmap"))


def uniqueness(state: DataFrame) -> DataFrame:
    """Per column: rows, distinct values and surplus rows (every null is one, as in the check)."""
    counted = state.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum(F.bitmap_count("bitmap")).alias("distinct_values")
    )
    return counted.withColumn("duplicates", F.col("rows") - F.col("distinct_values"))
