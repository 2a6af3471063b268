"""Neighbours and running totals along an order, whatever the size of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkward.operators.selection import same, small
from sparkward.session import discard, stored

# A slice is sorted by one task.
ROWS_PER_SLICE = 1_000_000


def in_order(rows: DataFrame, order: Sequence[str], *, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``rows`` as a stored table in slices (``_slice``) that follow one another along ``order``.

    Slices are cut by ``order`` alone, through the middle of a group if need be, so they are
    of about equal size where few rows have one place; aggregate those beforehand. The table is stored
    because slices that were made again could be cut elsewhere.
    """
    held = stored(rows, "unordered")
    slices = max(1, -(-held.count() // rows_per_slice))
    ranged = held.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id())
    ordered = stored(ranged, "ordered")
    discard(held)
    return ordered


def neighbour(
    ordered: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str, *, step: int = 1
) -> DataFrame:
    """Add ``name``, a struct of ``columns`` of the next row (``step`` 1) or the row before (-1) with the same keys.

    ``ordered`` comes from :func:`in_order`; rows may have been left out of it since. Each slice looks up its own rows;
    what lies beyond its edge comes from a table of one row per slice.
    """
    if step not in (1, -1):
        raise ValueError("step must be 1 or -1")
    row = F.struct(F.struct(*keys).alias("of"), F.struct(*columns).alias("row"))
    place = F.struct(*order)
    edge = F.min_by(row, place) if step == 1 else F.max_by(row, place)
    # One row per slice.
    slices = Window.orderBy("_slice")
    edges = ordered.groupBy("_slice").agg(edge.alias("_edge"))
    beyond = edges.select(F.col("_slice").alias("_slice_of"), F.lag("_edge", -step).over(slices).alias("_beyond"))
    within = Window.partitionBy("_slice").orderBy(*order)
    found = (
        ordered.withColumn("_near", F.lag(row, -step).over(within))
        .join(F.broadcast(beyond), F.col("_slice") == F.col("_slice_of"), "left")
        .withColumn("_near", F.coalesce("_near", "_beyond"))
    )
    of_same = F.col("_near.of").eqNullSafe(F.struct(*keys))
    return found.withColumn(name, F.when(of_same, F.col("_near.row"))).drop("_near", "_beyond", "_slice_of")


def running_total(
    ordered: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str | Column, name: str
) -> DataFrame:
    """Add ``name``, the sum of ``weight`` over the key's rows up to and with this one, along ``order``.

    ``ordered`` comes from :func:`in_order` and has one row per place. Sums are taken inside slices; the slices
    that a key goes through before are added up from one row per key and slice.
    """
    of = [f"_key_{i}" for i in range(len(keys))]
    weighed = ordered.withColumn("_weight", F.col(weight) if isinstance(weight, str) else weight)
    sums = weighed.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, of, strict=True)], F.col("_slice").alias("_slice_of"))
    sums = sums.agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*of).orderBy("_slice_of").rowsBetween(Window.unboundedPreceding, -1)
    # Only keys that go on from one slice to the next: fewer than there are slices.
    carried = sums.withColumn("_carried", F.sum("_sum").over(before)).where("_carried is not null").drop("_sum")
    carried = stored(carried, "carried")
    within = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_weight").over(within) + F.coalesce("_carried", F.lit(0))
    at = same([*keys, "_slice"], [*of, "_slice_of"])
    return weighed.join(small(carried), at, "left").withColumn(name, total).drop(*of, "_slice_of", "_carried", "_weight")
