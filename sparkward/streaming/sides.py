"""Windows of a stream that keep what came too late for them, as rows of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from sparkward.streaming.monitor import STATE_CONF, run_to_files  # noqa: F401

_OUT = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("events", T.LongType()),
        T.StructField("late", T.BooleanType()),
        T.StructField("event_id", T.StringType()),
    ]
)
_SEEN = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("late", T.BooleanType()),
    ]
)


def _micros(interval: str) -> F.Column:
    """A length of time (``10 minutes``) in microseconds; no months, which have no fixed length."""
    zero = F.lit(0).cast("timestamp")
    return F.unix_micros(zero + F.expr(f"INTERVAL {interval}")) - F.unix_micros(zero)


class _Windows(StatefulProcessor):
    """The events of one window and slice: seen, given out at its end, forgotten after a while."""

    def __init__(self, length: int, remember: int) -> None:
        self._length, self._remember = length, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # Read and extended once for a key and micro-batch: every call leaves the Python process.
        self._seen = handle.getListState("seen", _SEEN)

    def handleInputRows(
        self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues
    ) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        end = key[0] + self._length
        late, forgotten = end <= watermark, end + self._remember <= watermark
        before = set() if forgotten else {event for event, *_ in self._seen.get()}
        known = bool(before)
        added: dict[str, tuple] = {}
        for batch in rows:
            for event, tool, decision in zip(batch["event_id"], batch["tool_name"], batch["decision"]):
                if event not in before and event not in added:
                    added[event] = (event, tool, decision, late)
        if late and added:
            behind = [(key[0], tool, decision, 1, True, event) for event, tool, decision, _ in added.values()]
            yield pd.DataFrame(behind, columns=_OUT.names)
        if added and not forgotten:
            self._seen.appendList(list(added.values()))
        if not late and not known:
            self._handle.registerTimer(end // 1000)
        if not forgotten and not known:
            self._handle.registerTimer((end + self._remember) // 1000)

    def handleExpiredTimer(
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        end = key[0] + self._length
        if expiredTimerInfo.getExpiryTimeInMs() == end // 1000:
            counts: dict[tuple, int] = {}
            for _, tool, decision, late in self._seen.get():
                if not late:
                    counts[tool, decision] = counts.get((tool, decision), 0) + 1
            rows = [(key[0], *kind, n, False, None) for kind, n in counts.items()]
            yield pd.DataFrame(rows, columns=_OUT.names)
        if timerValues.getCurrentWatermarkInMs() * 1000 >= end + self._remember:
            self._seen.clear()

    def close(self) -> None:
        pass


def windows_with_late(
    events: DataFrame,
    *,
    window: str = "10 minutes",
    delay: str = "1 minute",
    remember: str = "1 hour",
    slices: int = 32,
) -> DataFrame:
    """A stream of closed windows and, beside them, of every event that came too late for its own.

    ``window_start, window_end, tool_name, decision, events, late, event_id``. Rows with
    ``late`` false are parts of a window's counts, given out once the watermark has passed its
    end; :func:`window_totals` adds the parts up. Rows with ``late`` true are single events whose
    window the watermark had passed when their micro-batch began. Both appear once.

    Each event counts once: a repeated identifier is recognised until ``remember`` after its
    window's end, when the window's state is dropped; what comes even later is late, and is
    recognised within its micro-batch alone. A null identifier is one identifier; events without
    a time have no window and are left out.

    A window is kept in ``slices`` parts by identifier, so that a window or a decision with any share of
    all events is spread over that many tasks. State is bounded by the events of the
    windows that are open or remembered; a micro-batch reads those of the window's slices it adds to,
    so there should be more slices the more events a window has. Needs ``STATE_CONF``; see :func:`late_to_files`.
    """
    length, kept = (
        events.sparkSession.range(1).select(_micros(window), _micros(remember)).first()
    )
    marked = events.withWatermark("timestamp", delay).where(F.col("timestamp").isNotNull())
    event = F.coalesce("event_id", F.lit("")).alias("event_id")
    # Spark would drop late rows from an operator that sees the watermarked column; a number it keeps.
    keyed = marked.select(
        F.unix_micros(F.window("timestamp", window).start).alias("start"),
        F.pmod(F.xxhash64(event), F.lit(slices)).alias("slice"),
        event,
        "tool_name",
        "decision",
    )
    counted = keyed.groupBy("start", "slice").transformWithStateInPandas(
        statefulProcessor=_Windows(length, kept),
        outputStructType=_OUT,
        outputMode="Append",
        timeMode="EventTime",
    )
    return counted.select(
        F.timestamp_micros("start").alias("window_start"),
        F.timestamp_micros(F.col("start") + length).alias("window_end"),
        "tool_name",
        "decision",
        "events",
        "late",
        "event_id",
    )


def window_totals(given: DataFrame) -> DataFrame:
    """What :func:`windows_with_late` gave out, per window, operation and kind: events in time, and late."""
    in_time = F.when(~F.col("late"), F.col("events")).otherwise(0)
    return given.groupBy("window_start", "window_end", "tool_name", "decision").agg(
        F.sum(in_time).alias("events"), F.sum(F.col("late").cast("long")).alias("late")
    )


def late_to_files(given: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """:func:`monitor.run_to_files` for :func:`windows_with_late`, which sets the state it needs."""
    return run_to_files(given, path, checkpoint)
