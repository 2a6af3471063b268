"""Text rendering shared by reasons and details."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(value: Column) -> Column:
    """Value in single quotes, or in double quotes if it holds only single ones."""
    escaped = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    single, double = F.contains(value, F.lit("'")), F.contains(value, F.lit('"'))
    return (
        F.when(~single, F.concat(F.lit("'"), escaped, F.lit("'")))
        .when(~double, F.concat(F.lit('"'), escaped, F.lit('"')))
        .otherwise(
            F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        )
    )


def quoted_names(names: Column) -> Column:
    """``['a', 'b']`` for an array of names that hold no quotes themselves."""
    return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))


def fixed(value: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, ties to even, infinity as ``inf``."""
    rounded = F.format_string(f"%.{digits}f", F.bround(value, digits))
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == F.lit(float("inf")), F.lit("inf"))
        .when(value == F.lit(float("-inf")), F.lit("-inf"))
        .otherwise(rounded)
    )
