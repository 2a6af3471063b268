"""Versions of rows with the time each was valid, kept right under late, repeated and corrected changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.operators.ordered import ROWS_PER_SLICE, in_order, neighbour
from sparkward.operators.selection import BROADCAST_ROWS, same, small
from sparkward.session import discard, stored

VALID_FROM, VALID_TO = "valid_from", "valid_to"


def _intervals(points: DataFrame, keys: Sequence[str], values: Sequence[str], rows_per_slice: int) -> DataFrame:
    """One version per key and time, valid until the key's next one."""
    # The largest values win where a time has several, so the order of arrival doesn't matter.
    known = F.max(F.struct(F.lit(True).alias("_known"), *values)).alias("_version")
    versions = points.groupBy(*keys, VALID_FROM).agg(known)
    order = [*keys, VALID_FROM]
    ordered = in_order(versions, order, rows_per_slice=rows_per_slice)
    following = neighbour(ordered, keys, order, [VALID_FROM], "_next")
    return following.select(
        *keys, *[F.col(f"_version.`{v}`").alias(v) for v in values], VALID_FROM, F.col(f"_next.{VALID_FROM}").alias(VALID_TO)
    )


def load_history(
    history: DataFrame | None,
    changes: DataFrame,
    keys: Sequence[str],
    at: str,
    *,
    few_keys: int = BROADCAST_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``history`` with ``changes`` spliced in: keys, values, ``valid_from``, ``valid_to`` (null: still valid).

    A change takes effect at ``at`` and holds until the key's next one, whichever came first: one that is
    late cuts the interval it falls into. Loading changes again, in any order or in other batches, gives the same
    history. Of several for one key and time the largest values (in the order of the columns, null
    smallest) stay. A null ``at`` stands before every time; a null key is a key. Every change
    is a version of its own; :func:`without_repeats` merges those that change nothing.

    If at most ``few_keys`` keys change, the others' rows pass through unshuffled; else all rows
    are cut anew. Rows are cut by key and time, so no key's versions meet in one task.
    """
    clash = sorted({VALID_FROM, VALID_TO} & set(changes.columns))
    if clash:
        raise ValueError(f"Changes must not have columns {clash}")
    values = [c for c in changes.columns if c not in keys and c != at]
    points = changes.select(*keys, *values, F.col(at).alias(VALID_FROM))
    columns = [*keys, *values, VALID_FROM, VALID_TO]
    if history is None:
        return _intervals(points, keys, values, rows_per_slice)
    if sorted(history.columns) != sorted(columns):
        raise ValueError(f"The history must have the columns {columns}")
    of = [f"_key_{i}" for i in range(len(keys))]
    touched = stored(changes.select(*[F.col(k).alias(o) for k, o in zip(keys, of, strict=True)]).distinct(), "touched")
    known = history.drop(VALID_TO)
    number = touched.count()
    if number > few_keys:
        discard(touched)
        return _intervals(known.unionByName(points), keys, values, rows_per_slice)
    touches = same(keys, of)
    spliced = _intervals(
        known.join(small(touched, number), touches, "left_semi").unionByName(points), keys, values, rows_per_slice
    )
    return history.join(small(touched, number), touches, "left_anti").select(*columns).unionByName(spliced)


def without_repeats(
    history: DataFrame, keys: Sequence[str], *, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Versions that differ from the one before them, valid until the next that does."""
    values = [c for c in history.columns if c not in (*keys, VALID_FROM, VALID_TO)]
    order = [*keys, VALID_FROM]
    ordered = in_order(history.drop(VALID_TO), order, rows_per_slice=rows_per_slice)
    before = neighbour(ordered, keys, order, values, "_before", step=-1)
    # No row before: null, which equals no struct.
    kept = before.where(~F.col("_before").eqNullSafe(F.struct(*values))).drop("_before")
    following = neighbour(kept, keys, order, [VALID_FROM], "_next")
    return following.select(*keys, *values, VALID_FROM, F.col(f"_next.{VALID_FROM}").alias(VALID_TO)).select(*history.columns)


def as_of(history: DataFrame, moment) -> DataFrame:
    """Each key's version at a moment."""
    started = F.col(VALID_FROM).isNull() | (F.col(VALID_FROM) <= F.lit(moment))
    return history.where(started & (F.col(VALID_TO).isNull() | (F.col(VALID_TO) > F.lit(moment))))
