"""Check specs as data: reading, validating, and turning them into a DataFrame."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkward.functions.metrics import get_check, registered_checks
from sparkward.session import local_frame

SPEC_SCHEMA = T.StructType(
    [
        T.StructField("check_id", T.LongType(), False),
        T.StructField("table", T.StringType(), False),
        T.StructField("check_type", T.StringType(), False),
        T.StructField("column", T.StringType(), True),
        T.StructField("threshold", T.DoubleType(), False),
    ]
)

@dataclass(frozen=True)
class CheckSpec:
    """One check on one table, with its threshold."""

    check_id: int
    table: str
    check_type: str
    column: str | None
    threshold: float


def parse_check(check_id: int, table: str, entry: Mapping[str, Any]) -> CheckSpec:
    """Validate one entry such as ``{"type": "row_count", "min_rows": 1}``.

    Everything a check needs is asked for here, before any table is read.
    Further keys are ignored.
    """
    if not entry.get("type"):
        raise ValueError(f"Check {check_id} on {table!r} has no 'type'")
    check = get_check(entry["type"])
    column = entry.get("column")
    if check.needs_column and not column:
        raise ValueError(f"Check {check.name!r} on {table!r} needs a 'column'")
    threshold = entry.get(check.parameter)
    if threshold is None:
        threshold = check.default
    if threshold is None:
        raise ValueError(f"Check {check.name!r} on {table!r} needs {check.parameter!r}")
    threshold = float(threshold)
    if math.isnan(threshold):
        raise ValueError(f"{check.parameter!r} of check {check.name!r} on {table!r} is not a number")
    return CheckSpec(
        check_id, table, check.name, column if check.needs_column else None, threshold
    )


def parse_checks(checks: Mapping[str, Iterable[Mapping[str, Any]]]) -> list[CheckSpec]:
    """Validate ``{table: [entry, ...]}``; ``check_id`` follows the given order."""
    specs: list[CheckSpec] = []
    for table, entries in checks.items():
        before = len(specs)
        for entry in entries:
            specs.append(parse_check(len(specs), table, entry))
        if len(specs) == before:
            raise ValueError(f"No checks given for {table!r}")
    return specs


def read_checks(spark: SparkSession, path: str) -> list[CheckSpec]:
    """Read specs from JSON lines: ``{"table": ..., "type": ..., ...}`` each.

    Specs are configuration: each becomes an aggregate in the query, so they
    are needed on the driver whatever their format. Lines are numbered in the
    order of the file.
    """
    fields = ["table", "type", "column"] + sorted(
        {check.parameter for check in registered_checks().values()}
    )
    numbers = set(fields) - {"table", "type", "column"}
    schema = T.StructType(
        [
            T.StructField(name, T.DoubleType() if name in numbers else T.StringType())
            for name in fields
        ]
    )
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path).collect()
    specs = []
    for check_id, row in enumerate(rows):
        if not row["table"]:
            raise ValueError(f"Check {check_id} in {path} names no table")
        specs.append(parse_check(check_id, row["table"], row.asDict()))
    return specs


def specs_frame(spark: SparkSession, specs: list[CheckSpec]) -> DataFrame:
    """The specs as a local relation (its size is known to the optimiser)."""
    rows = [[getattr(spec, name) for name in SPEC_SCHEMA.fieldNames()] for spec in specs]
    return local_frame(spark, SPEC_SCHEMA, rows)
