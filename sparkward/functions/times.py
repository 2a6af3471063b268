"""Times as whole numbers, independent of the session time zone."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR_IN_MICROS = 3_600_000_000
_DAY_IN_MICROS = 24 * HOUR_IN_MICROS


def _micros_of_day(moment: Column) -> Column:
    minutes = (F.hour(moment) * 60 + F.minute(moment)).cast("long")
    seconds = F.extract(F.lit("SECOND"), moment)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("long")


def micros(moment: Column, data_type: T.DataType) -> Column:
    """Microseconds since 1970: of an instant (TIMESTAMP) in elapsed time, of
    wall-clock values and dates by the calendar."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(moment.cast("timestamp"))
    wall = moment.cast("timestamp_ntz")
    days = F.datediff(wall, F.lit("1970-01-01").cast("date")).cast("long")
    return days * _DAY_IN_MICROS + _micros_of_day(wall)


def moment_of(value: int, data_type: T.DataType) -> Column:
    """The literal whose ``micros`` are ``value``."""
    if isinstance(data_type, T.TimestampType):
        return F.timestamp_micros(F.lit(value).cast("long"))
    wall = datetime(1970, 1, 1) + timedelta(microseconds=value)
    return F.lit(wall.isoformat(sep=" ")).cast("timestamp_ntz")


def whole_hours(start: Column, end: Column, data_type: T.DataType) -> Column:
    """Whole hours from start to end, cut towards zero."""
    elapsed = micros(end, data_type) - micros(start, data_type)
    return F.call_function("div", elapsed, F.lit(HOUR_IN_MICROS))
