"""Watching the audit trail as a stream."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkward.operators.audit import AUDIT_SCHEMA, log_lines
from sparkward.sources.trail import append_events, append_table

# How streams started here keep state: on disk, with bounded memory.
_ROCKSDB = "spark.sql.streaming.stateStore.rocksdb"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKSDB}.boundedMemoryUsage": "true",
}

# State is kept in no more than twice as many parts as there are cores, or in so many where these are few.
_STATE_PARTS = 32
_PARTITIONS = "spark.sql.shuffle.partitions"


def read_events_stream(
    spark: SparkSession, path: str, *, max_files: int | None = None
) -> DataFrame:
    """New events of a JSON trail as a stream."""
    reader = spark.readStream.schema(AUDIT_SCHEMA)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def decision_windows(
    events: DataFrame, *, window: str = "10 minutes", delay: str = "1 minute"
) -> DataFrame:
    """Decisions per time window, operation and kind; each event counts once.

    Events are told apart by identifier within the watermark, which is spread
    evenly over all tasks; only the counts are brought together per window. A
    window is given out once the watermark has passed its end.
    """
    return (
        events.withWatermark("timestamp", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("timestamp", window), "tool_name", "decision")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "tool_name",
            "decision",
            "events",
        )
    )


def late_events(
    events: DataFrame, closed: DataFrame, *, window: str = "10 minutes"
) -> DataFrame:
    """The trail's own counts per window beside those that :func:`decision_windows` gave out.

    A stream leaves out what arrives behind its watermark. Here every event of
    the trail is counted once (``recorded``); for windows up to the last one given
    out, ``late`` is what the stream left out, later windows are ``open``.
    """
    recorded = (
        events.dropDuplicates(["event_id"])
        .groupBy(F.window("timestamp", window), "tool_name", "decision")
        .agg(F.count(F.lit(1)).alias("recorded"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "tool_name",
            "decision",
            "recorded",
        )
    )
    last = closed.agg(F.max("window_end").alias("last")).scalar()
    given = closed.select(
        "window_start", "window_end", "tool_name", "decision", F.col("events").alias("given")
    )
    keys = ["window_start", "window_end", "tool_name", "decision"]
    counted = F.coalesce("given", F.lit(0)).cast("long")
    is_open = F.coalesce(F.col("window_end") > last, F.lit(True))
    return recorded.join(given, keys, "left").select(
        *keys,
        "recorded",
        counted.alias("counted"),
        is_open.alias("open"),
        F.when(~is_open, F.col("recorded") - counted).alias("late"),
    )


def metric_windows(
    rows: DataFrame,
    time: str,
    columns: list[str],
    *,
    window: str = "1 hour",
    delay: str = "1 minute",
) -> DataFrame:
    """Row count and null rates per time window of a stream of rows."""
    counts = (
        rows.withWatermark(time, delay)
        .groupBy(F.window(time, window))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(F.col(c)).alias(f"count_{i}") for i, c in enumerate(columns)],
        )
    )
    return counts.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "rows",
        *[
            ((F.col("rows") - F.col(f"count_{i}")) / F.col("rows")).alias(f"null_rate_{c}")
            for i, c in enumerate(columns)
        ],
    )


def run_to_files(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and append closed windows to Parquet, each once.

    Every part of the state writes files in every micro-batch, however little it holds. So a new
    checkpoint has few parts if the session asks for more; one that exists keeps its own number. A query
    keeps the settings it was started with; the session gets its own back.
    """
    spark = results.sparkSession
    parts = min(int(spark.conf.get(_PARTITIONS)), max(_STATE_PARTS, 2 * spark.sparkContext.defaultParallelism))
    wanted = {**STATE_CONF, _PARTITIONS: str(parts)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return (
            results.writeStream.outputMode("append")
            .format("parquet")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(path)
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _in_batches(
    events: DataFrame, write: Callable[[DataFrame, str], None], checkpoint: str, name: str
) -> StreamingQuery:
    """Hand each micro-batch to ``write`` under a name it keeps when it is run again.

    The checkpoint is part of the name: with another one the numbers start anew.
    """
    origin = f"{zlib.crc32(checkpoint.encode()):08x}"

    def run(batch: DataFrame, batch_id: int) -> None:
        write(batch, f"{name}-{origin}-{batch_id}")

    return (
        events.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_to_trail(events: DataFrame, path: str, checkpoint: str, name: str) -> StreamingQuery:
    """Append a stream of events to a JSON trail, each micro-batch once."""
    return _in_batches(events, lambda b, n: append_events(b, path, n), checkpoint, name)


def stream_to_table(events: DataFrame, path: str, checkpoint: str, name: str) -> StreamingQuery:
    """Copy a stream of events into the Parquet audit table, each micro-batch once."""
    return _in_batches(events, lambda b, n: append_table(b, path, n), checkpoint, name)


def stream_log_lines(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of events as lines of JSON text for a log shipper."""
    return (
        log_lines(events)
        .writeStream.format("text")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
