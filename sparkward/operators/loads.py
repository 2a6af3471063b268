"""Incremental loads by a mapping table, and the skew of keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.session import stored


@dataclass(frozen=True)
class Mapping:
    """One target column: where it comes from and its type."""

    source: str
    target: str
    data_type: str


def apply_mapping(source: DataFrame, mappings: Sequence[Mapping]) -> DataFrame:
    """Select, rename and cast as the mapping says."""
    return source.select(
        *[F.col(m.source).cast(m.data_type).alias(m.target) for m in mappings]
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key by ``order``, which must tell a key's rows apart: any of
    several that are equal in it may come out.

    An aggregation, so each task sends one row per key: a key with a third of
    all rows costs no more than another.
    """
    others = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*others), F.struct(*order)).alias("latest")
    return df.groupBy(*keys).agg(latest).select(*keys, "latest.*").select(*df.columns)


def high_water_mark(target: DataFrame, column: str):
    """The largest value loaded so far; None for an empty target."""
    return target.agg(F.max(column)).first()[0]


def changed_since(source: DataFrame, column: str, mark) -> DataFrame:
    """Rows at or behind a mark: a filter that skips older files. All of them without a mark.

    Rows may come later with the mark's own value, so these are read again and are to be told
    from what was loaded by their keys, as :func:`new_rows` does. Rows without a value are not
    behind any mark: they are kept on every run, to be told apart alike.
    """
    if mark is None:
        return source
    return source.where((F.col(column) >= F.lit(mark)) | F.col(column).isNull())


def new_rows(mapped: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the target does not hold yet (a null key is never held)."""
    # Distinct first: the target's keys are then reduced before they are shuffled.
    return mapped.join(target.select(*keys).distinct(), list(keys), "left_anti")


def incremental_load(
    source: DataFrame,
    target: DataFrame,
    mappings: Sequence[Mapping],
    keys: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Mapped rows to append: the newest of each key that is new to the target.

    Reads all of ``source``; hand in what :func:`changed_since` leaves of it where
    the source only grows.
    """
    mapped = apply_mapping(source, mappings)
    return new_rows(latest_per_key(mapped, keys, order), target, keys)


def key_skew(df: DataFrame, keys: Sequence[str], top: int = 20) -> DataFrame:
    """The most frequent keys with their share of all rows.

    The shares are relative to the sum of the counts, a one-row subquery over
    the same aggregation, so the table is read once.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total")).scalar()
    return (
        counts.withColumn("share", F.col("rows") / total)
        .orderBy(F.desc("rows"), *keys)
        .limit(top)
    )


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float, *, cells: int = 65_536, rounds: int = 3) -> DataFrame:
    """All keys with at least ``share`` of all rows: keys, ``rows``, ``share``. Exact, null a key like others.

    First, rows are counted in ``rounds`` tables of ``cells`` cells by hashes of the key: a table of
    fixed size, reduced in the map tasks. A key cannot have more rows than any of its cells, so only
    rows whose cells all reach the share are counted by key; other keys' rows are not shuffled. At most
    1 / ``share`` cells a round do, which is what is broadcast. ``cells`` should be several times
    1 / ``share``: with fewer more keys are counted, none is lost.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    cell = [F.pmod(F.xxhash64(F.lit(r), *keys), F.lit(cells)) for r in range(rounds)]
    marks = F.array(*[F.struct(F.lit(r).alias("round"), c.alias("cell")) for r, c in enumerate(cell)])
    sketch = df.select(F.inline(marks)).groupBy("round", "cell").agg(F.count(F.lit(1)).alias("n"))
    sketch = stored(sketch, "sketch")
    total = sketch.where("round = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = F.lit(share) * F.lit(float(total))
    heavy = sketch.where(F.col("n") >= least)
    candidates = df.select(*keys)
    for r, c in enumerate(cell):
        reached = heavy.where(F.col("round") == r).select("cell")
        candidates = candidates.join(F.broadcast(reached), c == F.col("cell"), "left_semi")
    counts = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least)
    return counts.withColumn("share", F.col("rows") / F.lit(float(total)))
