"""Order statistics of many groups at once, by rounds of histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkward.session import stored

# A table of up to so many short rows is broadcast. A longer one never is: the size of its files, by which
# Spark would choose the join, says little of that of its rows, least of all of copies.
BROADCAST_ROWS = 200_000


def small(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored table (of ``rows`` rows, counted if not given), to be broadcast if it is short enough."""
    few = (table.count() if rows is None else rows) <= BROADCAST_ROWS
    return F.broadcast(table) if few else table.hint("merge")


# So many parts a table is copied to where it is too long to be broadcast.
COPIES = 16


def met(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str, *, few: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``rows``, any share of which may have one key, with a stored table of few rows per key.

    Of up to ``few`` rows the table is broadcast. A longer one is copied to 16 parts, and
    the rows are dealt over these by all their columns, so no key's rows meet in one task.
    """
    if table.count() <= few:
        return rows.join(F.broadcast(table), list(on), how)
    dealt = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    rows = rows.withColumn("_copy", F.pmod(F.xxhash64(*rows.columns), F.lit(COPIES)).cast("int"))
    return rows.join(dealt.hint("merge"), [*on, "_copy"], how).drop("_copy")


def same(left: Sequence[str | Column], right: Sequence[str | Column]) -> Column:
    """Equal keys; null equals null."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return reduce(Column.__and__, [column(a).eqNullSafe(column(b)) for a, b in zip(left, right, strict=True)])


def borders(
    rows: DataFrame,
    keys: Sequence[str],
    at: str,
    weight: str,
    wanted: DataFrame,
    *,
    ranked_rows: int,
    cells: int = 1024,
) -> DataFrame:
    """Where, along the number ``at``, the weights of each group's rows add up to what is wanted of it.

    ``wanted``, a stored table, holds the key columns and ``wanted``. The result holds the keys, ``wanted``, ``low``,
    ``high``, ``before`` and ``n``: rows below ``low`` weigh ``before``, less than is wanted; with the ``n`` rows
    from ``low`` to ``high`` it is reached, unless the whole group weighs less. There are at most
    ``ranked_rows`` of those, or they all have one value.

    Each round splits every group's interval into ``cells`` and sums weights per group and
    cell, which the map tasks reduce: no group's rows are brought together, whatever
    their number. Only groups that are still too large take part in the next round. Groups
    without a row with a value are left out.
    """
    names = [f"_key_{i}" for i in range(len(keys))]
    rows = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
                       F.col(at).alias("_at"), F.col(weight).alias("_weight")).where("_at is not null")
    groups = wanted.select(*[F.col(k).alias(f"{n}_of") for k, n in zip(keys, names, strict=True)], "wanted")
    of = [f"{n}_of" for n in names]
    inside = rows.join(small(groups), same(names, of)).drop(*names)
    state = stored(
        inside.groupBy(*of, "wanted").agg(
            F.min("_at").alias("low"), F.max("_at").alias("high"), F.count("*").alias("n")
        ).withColumn("before", F.lit(0).cast(rows.schema["_weight"].dataType)),
        "borders",
    )
    done: list[DataFrame] = []
    while True:
        is_open = (F.col("n") > ranked_rows) & (F.col("low") < F.col("high"))
        done.append(state.where(~is_open))
        state = state.where(is_open).drop("n")
        left = state.count()
        if not left:
            break
        low, high = F.col("low").cast("double"), F.col("high").cast("double")
        share = F.try_divide(F.col("_at").cast("double") - low, high - low)
        cell = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * cells), F.lit(cells - 1))
        inside = rows.join(small(state, left), same(names, of)).where("_at between low and high")
        counted = inside.groupBy(*of, "wanted", "before", cell.alias("cell")).agg(
            F.sum("_weight").alias("weight"), F.count("*").alias("n"),
            F.min("_at").alias("low"), F.max("_at").alias("high"),
        )
        # One row per group and cell.
        along = Window.partitionBy(*of).orderBy("cell")
        up_to = F.col("before") + F.sum("weight").over(along)
        last = F.max("cell").over(Window.partitionBy(*of))
        counted = counted.withColumn("up_to", up_to).withColumn("last", last)
        reached = counted.where((F.col("up_to") >= F.col("wanted")) | (F.col("cell") == F.col("last")))
        first = F.min("cell").over(Window.partitionBy(*of))
        reached = reached.withColumn("first", first).where("cell = first")
        kind = rows.schema["_weight"].dataType
        state = stored(
            reached.select(
                *of, "wanted", "low", "high", "n", (F.col("up_to") - F.col("weight")).cast(kind).alias("before")
            ),
            "borders",
        )
    found = reduce(DataFrame.unionByName, done)
    return stored(found.select(*[F.col(o).alias(k) for o, k in zip(of, keys, strict=True)], "wanted", "low", "high", "before", "n"), "borders")
