"""Buckets of an index compared inside tasks, without writing out their pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_units(members: DataFrame, rows_per_unit: int, rows_per_block: int) -> DataFrame:
    """Rows of ``members (bucket, node)`` that have company, with ``unit, left, right`` to group by.

    Small buckets share a unit of about ``rows_per_unit`` rows; there both sides are
    -1. A bucket above ``rows_per_block`` is cut into blocks by node, and each pair of
    blocks becomes a unit of its own: its work is spread and all its pairs are met.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    rows = members.join(sizes, "bucket")
    units = F.lit(max(1, members.count() // rows_per_unit))
    blocks = F.ceil(F.col("size") / rows_per_block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    small = rows.where(F.col("size") <= rows_per_block).withColumns(
        {"unit": F.pmod(F.xxhash64("bucket"), units), "left": F.lit(-1), "right": F.lit(-1), "own": F.lit(-1)}
    )
    large = (
        rows.where(F.col("size") > rows_per_block)
        .withColumns({"unit": F.col("bucket"), "own": own})
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")})
        .drop("other")
    )
    return small.unionByName(large).drop("size")


def ordered(unit: pd.DataFrame) -> pd.DataFrame:
    """The rows of a unit as :func:`buckets` expects them."""
    return unit.sort_values(["bucket", "node"]).reset_index(drop=True)


def buckets(unit: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray]]:
    """The buckets of an ordered unit, each with a matrix telling which ordered pairs are to be met."""
    bucket, own = unit["bucket"].to_numpy(), unit["own"].to_numpy()
    apart = len(unit) > 0 and unit["left"].iloc[0] != unit["right"].iloc[0]
    ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(unit)).tolist()
    uppers: dict[int, np.ndarray] = {}
    start = 0
    for end in ends:
        size = end - start
        if size not in uppers:
            uppers[size] = np.triu(np.ones((size, size), dtype=bool), 1)
        met = uppers[size]
        if apart:  # pairs inside a block are met in the block's own unit
            met = met & (own[start:end, None] != own[None, start:end])
        yield slice(start, end), met
        start = end


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (member, root) that join the same members as a symmetric matrix does."""
    found, todo = [], np.ones(len(linked), dtype=bool)
    while todo.any():
        root = int(np.argmax(todo))
        todo[root] = False
        edge = [root]
        while edge:
            reached = linked[edge].any(axis=0) & todo
            todo &= ~reached
            edge = np.flatnonzero(reached).tolist()
            found += [(member, root) for member in edge]
    return found
