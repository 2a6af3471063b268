"""The registry of checks: each is a pair of Column builders.

A check supplies an aggregate (``metric``) and a comparison (``verdict``). Both
are plain Columns, so a whole suite stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkward.functions.text import fixed
from sparkward.functions.times import whole_hours


@dataclass(frozen=True)
class Target:
    """What a metric is computed on."""

    column: Column | None
    data_type: T.DataType | None
    as_of: Column | None


@dataclass(frozen=True)
class Check:
    """One kind of check.

    ``parameter`` names the threshold in a spec and ``default`` is used when it
    is absent. ``distinct`` marks metrics that need a distinct aggregation,
    ``counts_only`` those that Parquet footers can answer.
    """

    name: str
    parameter: str
    metric: Callable[[Target], Column]
    verdict: Callable[[Column, Column], Column]
    detail: Callable[[Column, Column], Column]
    default: float | None = None
    needs_column: bool = True
    needs_as_of: bool = False
    distinct: bool = False
    counts_only: bool = False


def at_most(metric: Column, threshold: Column) -> Column:
    return metric <= threshold


def at_least(metric: Column, threshold: Column) -> Column:
    return metric >= threshold


def null_rate(column: Column) -> Column:
    """Share of nulls; an empty table counts as 0, so it passes any limit.

    Written with COUNT(column), which Parquet footers can answer, rather than
    with a conditional count, which they cannot.
    """
    rows = F.count(F.lit(1))
    return F.coalesce(F.try_divide(rows - F.count(column), rows), F.lit(0.0))


def surplus_rows(column: Column) -> Column:
    """Rows minus distinct values. Nulls are no value, so each null is surplus."""
    return (F.count(F.lit(1)) - F.count_distinct(column)).cast("double")


def age_hours(target: Target) -> Column:
    """Whole hours from the newest value to ``as_of``; infinite if there is none.

    An age of 0 hours is 0, not "unknown", and passes.
    """
    newest = F.max(target.column)
    hours = whole_hours(newest, target.as_of, target.data_type)
    return F.coalesce(hours.cast("double"), F.lit(float("inf")))


def _detail(label: str, limit: str, digits: int) -> Callable[[Column, Column], Column]:
    def build(metric: Column, threshold: Column) -> Column:
        return F.concat(
            F.lit(f"{label}="), fixed(metric, digits), F.lit(f" {limit}="), fixed(threshold, digits)
        )

    return build


_REGISTRY: dict[str, Check] = {}


def register_check(check: Check) -> None:
    """Add a check; a second one under the same name is an error."""
    if check.name in _REGISTRY:
        raise ValueError(f"Check type {check.name!r} is already registered")
    _REGISTRY[check.name] = check


def get_check(name: str) -> Check:
    try:
        return _REGISTRY[name]
    except KeyError:
        raise ValueError(
            f"Unknown check type {name!r}; expected one of {sorted(_REGISTRY)}"
        ) from None


def registered_checks() -> dict[str, Check]:
    return dict(_REGISTRY)


register_check(
    Check(
        name="null_rate",
        parameter="max_null_rate",
        metric=lambda t: null_rate(t.column),
        verdict=at_most,
        detail=_detail("null_rate", "threshold", 4),
        counts_only=True,
    )
)
register_check(
    Check(
        name="uniqueness",
        parameter="max_duplicates",
        default=0.0,
        metric=lambda t: surplus_rows(t.column),
        verdict=at_most,
        detail=_detail("duplicate_count", "threshold", 0),
        distinct=True,
    )
)
register_check(
    Check(
        name="freshness",
        parameter="max_age_hours",
        metric=age_hours,
        verdict=at_most,
        detail=_detail("age_hours", "threshold", 2),
        needs_as_of=True,
    )
)
register_check(
    Check(
        name="row_count",
        parameter="min_rows",
        metric=lambda t: F.count(F.lit(1)).cast("double"),
        verdict=at_least,
        detail=_detail("row_count", "min_rows", 0),
        needs_column=False,
        counts_only=True,
    )
)
