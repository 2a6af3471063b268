"""Which columns identify a row: the smallest sets of columns without repeated values."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkward.operators.selection import BROADCAST_ROWS, same
from sparkward.session import discard, local_frame, stored

# Sketches of 2^14 registers are off by 0.8 % (one deviation).
_LOG_REGISTERS, _ERROR = 14, 0.0081
# Deviations of the sketch that a set may stay behind the number of rows without being ruled out.
_DEVIATIONS = 6
# Sketches that one scan fills: up to 16 kB each in every task.
_SETS_PER_SCAN = 100

# Of a table of at least so many rows a share is searched first: a set that repeats in some of its rows is no key.
_LARGE_ROWS, _SHARES = 1_000_000, 16

_KEYS = T.StructType(
    [
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("size", T.LongType()),
        T.StructField("rows", T.LongType()),
    ]
)


def _number(columns: Sequence[str]) -> Column:
    """A number for the values of some columns. Hashes pass over nulls, so their places go in too."""
    parts = [[F.col(f"`{name}`"), F.col(f"`{name}`").isNull()] for name in columns]
    return F.xxhash64(*[part for pair in parts for part in pair])


def _estimates(df: DataFrame, sets: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """About how many different values each set has; a hundred sets share a scan and shuffle sketches only."""
    found = {}
    for first in range(0, len(sets), _SETS_PER_SCAN):
        some = sets[first : first + _SETS_PER_SCAN]
        sketches = [F.hll_sketch_agg(_number(s), _LOG_REGISTERS) for s in some]
        counts = [F.hll_sketch_estimate(sketch).alias(f"s{i}") for i, sketch in enumerate(sketches)]
        found |= dict(zip(some, df.agg(*counts).first(), strict=True))
    return found


def _repeated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The values that more than one row has in all of ``columns``; nulls agree. Counted before the shuffle."""
    groups = df.groupBy(*[F.col(f"`{name}`") for name in columns])
    return groups.agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")


def repeats(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether two rows agree in all of ``columns``; nulls agree."""
    return not _repeated(df, columns).select(F.lit(1)).isEmpty()


class _Search:
    """Which sets repeat in a large table, with as few rows shuffled as that needs."""

    def __init__(self, df: DataFrame) -> None:
        self._df = df
        # Sets that seem to repeat in few values only, and the rows that do once they were asked for.
        self._few: dict[tuple[str, ...], DataFrame | None] = {}

    def has_part_of(self, columns: tuple[str, ...]) -> bool:
        """Whether a part of the set seems to repeat in few values only."""
        return any(set(p) < set(columns) for p in self._few)

    def repeats(self, columns: tuple[str, ...]) -> bool:
        # Rows that agree in a set agree in every part of it.
        for part in [p for p in self._few if set(p) < set(columns)]:
            rows = self._rows(part)
            if rows is not None:
                return repeats(rows, columns)
        share = self._df.where(F.pmod(_number(columns), F.lit(_SHARES)) == 0)
        found = _repeated(share, columns).count()
        if found * _SHARES <= BROADCAST_ROWS:
            self._few[columns] = None
        return found > 0 or repeats(self._df, columns)

    def _rows(self, part: tuple[str, ...]) -> DataFrame | None:
        """The rows that repeat in a set; none if their values are too many to be broadcast."""
        if self._few[part] is None:
            names = [f"_of_{i}" for i in range(len(part))]
            values = stored(_repeated(self._df, part).toDF(*names), "repeated")
            if values.count() <= BROADCAST_ROWS:
                on = same([F.col(f"`{name}`") for name in part], names)
                self._few[part] = stored(self._df.join(F.broadcast(values), on, "left_semi"), "repeating")
            else:
                del self._few[part]
            discard(values)
        return self._few.get(part)

    def close(self) -> None:
        discard(*[rows for rows in self._few.values() if rows is not None])


def candidate_keys(
    df: DataFrame, columns: Sequence[str] | None = None, *, most_columns: int = 3, large_rows: int = _LARGE_ROWS
) -> DataFrame:
    """All smallest sets of at most ``most_columns`` columns that no two rows agree in.

    ``columns, size, rows``: the set in the table's order, its size, and the rows it identifies. No
    set holds a smaller one. Null is a value like any other, so rows that repeat as a whole leave
    no key; in a table of at most one row each column is one. Maps cannot be compared and are left out.

    Level by level: sets that hold a key are skipped, as are those whose columns have too few
    values together. The others are sketched, many in one scan; a set whose sketch stays behind the
    rows by six deviations is no key. What is left is counted exactly, one aggregation
    each, so every key given is one. Store ``df`` first if it is derived.

    From ``large_rows`` rows on, a set is counted among the rows that repeat in a part of it, where those are known to
    be few: no others can agree in the set. Otherwise a sixteenth of its values is counted first, and all of
    them only if none of these repeats.
    """
    names = [f.name for f in df.schema.fields if not _holds_map(f.dataType)]
    if columns is not None:
        if unknown := [name for name in columns if name not in names]:
            raise ValueError(f"No columns to compare: {', '.join(unknown)}")
        names = [name for name in names if name in set(columns)]
    if most_columns < 1:
        raise ValueError("most_columns must be at least 1")
    df = df.select(*[F.col(f"`{name}`") for name in names])
    rows = df.count()
    slack = _DEVIATIONS * _ERROR
    keys: list[tuple[str, ...]] = []
    single: dict[tuple[str, ...], int] = {}
    search = _Search(df)
    for size in range(1, min(most_columns, len(names)) + 1):
        sets = [s for s in combinations(names, size) if not any(set(k) <= set(s) for k in keys)]
        if size > 1:
            most = {s: prod(single[(name,)] * (1 + slack) + 1 for name in s) for s in sets}
            sets = [s for s in sets if most[s] >= rows]
        # Sets that few rows can agree in are counted among those, without a sketch.
        quick = [s for s in sets if search.has_part_of(s)]
        estimates = dict.fromkeys(quick, rows) | _estimates(df, [s for s in sets if s not in quick])
        if size == 1:
            single = estimates
        likely = [s for s in sets if estimates[s] >= rows * (1 - slack) - 1]
        keys += [s for s in likely if not (search.repeats(s) if rows >= large_rows else repeats(df, s))]
    search.close()
    return local_frame(df.sparkSession, _KEYS, [(list(k), len(k), rows) for k in keys])


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))
