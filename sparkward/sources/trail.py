"""The audit trail on disk: append-only JSON lines, or a Parquet table, both by date.

Every append carries a batch name, unique to that batch, and only adds files. It writes
them to a hidden folder first, then publishes one commit record that names them, and only then
moves them to the folder of their date. So readers and streams never see a file of an
append that failed, an append looks up its own name and opens no file of another batch, and
one that stopped between record and moves is completed by whoever uses its name next. The
records also hold the times each file spans, by which the newest events are found.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkward.functions.times import HOUR_IN_MICROS, micros
from sparkward.operators.audit import AUDIT_COLUMNS, AUDIT_SCHEMA, JSON_TIMES, log_lines
from sparkward.operators.newest import newest, newest_per_key, oldest_needed
from sparkward.session import filesystem, local_frame, remove

_DAY_IN_MICROS = 24 * HOUR_IN_MICROS

_BATCH_NAME = r"[A-Za-z0-9_.-]+"

COMMITS, _STAGING = "_commits", "_staging"

# One row per file of a commit: its events, the hash of their identifiers, and the times they span.
COMMIT_SCHEMA = T.StructType(
    [
        T.StructField("batch", T.StringType()),
        T.StructField("attempt", T.LongType()),
        T.StructField("staged", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("events", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("low", T.LongType()),
        T.StructField("high", T.LongType()),
    ]
)


def _checked(batch: str) -> str:
    if not re.fullmatch(_BATCH_NAME, batch):
        raise ValueError(f"Batch name {batch!r} may hold letters, digits, '_', '.' and '-' only")
    return batch


def _digest() -> Column:
    """A sum over hashes of identifiers: whatever the order, equal for equal sets."""
    return F.sum(F.xxhash64("event_id").cast("decimal(38,0)")).cast("string")


class _Log:
    """The commit records of one trail: small files, each published by a rename."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.files, _ = filesystem(spark, self.path)

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def read(self, batch: str) -> list[dict]:
        """The rows of all records of a batch, attempt by attempt; found by their names."""
        rows: list[dict] = []
        attempt = 0
        while self.files.exists(at := self._at(f"{COMMITS}/{batch}.{attempt}.json")):
            stream = self.files.open(at)
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            rows += [json.loads(line) for line in text.splitlines()]
            attempt += 1
        return rows

    def publish(self, batch: str, attempt: int, rows: list[dict]) -> None:
        """One record, there as a whole or not at all; a record that exists is never replaced."""
        text = "".join(json.dumps(row) + "\n" for row in rows)
        at, hidden = self._at(f"{COMMITS}/{batch}.{attempt}.json"), self._at(f"{COMMITS}/_{uuid.uuid4().hex}")
        stream = self.files.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.files.exists(at) or not self.files.rename(hidden, at):
            self.files.delete(hidden, False)
            raise OSError(f"Batch {batch!r} was committed by another writer")

    def move(self, rows: list[dict]) -> None:
        """Bring the files of a record to their places; those that are there stay."""
        for row in rows:
            staged, at = self._at(row["staged"]), self._at(row["file"])
            if self.files.exists(staged):
                self.files.mkdirs(at.getParent())
                self.files.rename(staged, at)


def _append(
    events: DataFrame, path: str, batch: str, write: Callable[[DataFrame, str], None],
    read: Callable[[SparkSession, list[str]], DataFrame],
) -> None:
    """Write what a batch lacks, publish its record, then show its files.

    A batch that was committed with the same identifiers is left as it is. One that lacks
    some gets another attempt with those; a name that was used for other events is an error, and
    so are events without an identifier. An event that occurs twice is written once.
    """
    spark, log = events.sparkSession, _Log(events.sparkSession, path)
    committed = log.read(_checked(batch))
    log.move(committed)
    once = events.dropDuplicates(["event_id"])
    attempt = 0
    if committed:
        attempt = 1 + max(row["attempt"] for row in committed)
        n, digest = once.agg(F.count(F.lit(1)), _digest()).first()
        if (n, int(digest or 0)) == (
            sum(row["events"] for row in committed), sum(int(row["digest"] or 0) for row in committed)
        ):
            return
        written = read(spark, [f"{log.path}/{row['file']}" for row in committed if row["events"]]).select("event_id")
        if not written.join(once, "event_id", "left_anti").isEmpty():
            raise ValueError(f"Batch name {batch!r} was already used for other events")
        once = once.join(written, "event_id", "left_anti")
    hidden = f"{_STAGING}/{batch}-{uuid.uuid4().hex}"
    try:
        dated = once.select(*AUDIT_COLUMNS, _utc_date(once, "timestamp").alias("event_date"))
        write(dated.hint("rebalance", "event_date"), f"{log.path}/{hidden}")
        rows = _staged(read(spark, [f"{log.path}/{hidden}"]), hidden, batch, attempt)
        log.publish(batch, attempt, rows)
    except BaseException:
        remove(spark, f"{log.path}/{hidden}")
        raise
    log.move(rows)
    remove(spark, f"{log.path}/{hidden}")


def _staged(written: DataFrame, hidden: str, batch: str, attempt: int) -> list[dict]:
    """The rows of the record of staged files; one with no events for a batch without any."""
    at = micros(F.col("timestamp"), written.schema["timestamp"].dataType)
    # Spark's newer file reader has no _metadata.
    files = written.withColumn("at", F.input_file_name()).groupBy("at").agg(
        F.count(F.lit(1)).alias("events"), F.count("event_id").alias("named"), _digest().alias("digest"),
        F.min(at).alias("low"), F.max(at).alias("high"),
    ).collect()
    if any(r["named"] < r["events"] for r in files):
        raise ValueError("An event without an identifier can't be told from others")
    rows = []
    for r in files:
        inside = r["at"][r["at"].index(hidden) + len(hidden) + 1 :]
        rows.append(
            {
                "batch": batch, "attempt": attempt, "staged": f"{hidden}/{inside}", "file": inside,
                "events": r["events"], "digest": r["digest"], "low": r["low"], "high": r["high"],
            }
        )
    nothing = {"batch": batch, "attempt": attempt, "staged": hidden, "file": hidden, "events": 0, "digest": "0"}
    return rows or [nothing | {"low": None, "high": None}]


def _read_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(paths) if paths else local_frame(spark, AUDIT_SCHEMA, [])


def _read_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).parquet(*paths) if paths else local_frame(spark, AUDIT_SCHEMA, [])


def append_events(events: DataFrame, path: str, batch: str) -> None:
    """Append a batch of events as JSON lines, in folders by event date (UTC).

    A name that was used for other events is an error: the trail only grows.
    """

    def write(dated: DataFrame, to: str) -> None:
        dated.write.partitionBy("event_date").options(**JSON_TIMES).json(to)

    _append(events, path, batch, write, _read_json)


def append_log_lines(events: DataFrame, path: str, batch: str) -> None:
    """Append a batch of events as text lines for a log shipper (write-only).

    A name that was used for other events is an error.
    """

    def write(dated: DataFrame, to: str) -> None:
        log_lines(dated, "event_date").write.partitionBy("event_date").text(to)

    _append(events, path, batch, write, _read_json)


def append_table(events: DataFrame, path: str, batch: str) -> None:
    """Append a batch to the Parquet audit table, partitioned by event date (UTC).

    Rows are brought together by date before writing, in as many pieces per
    date as their number asks for, so a batch leaves few files. A name that was used for
    other events is an error.
    """

    def write(dated: DataFrame, to: str) -> None:
        dated.withColumn("batch", F.lit(batch)).write.partitionBy("event_date").parquet(to)

    _append(events, path, batch, write, _read_parquet)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events of a JSON trail; a missing trail is empty."""
    try:
        trail = spark.read.schema(AUDIT_SCHEMA).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return local_frame(spark, AUDIT_SCHEMA, [])
    return trail.select(*AUDIT_COLUMNS)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The commit records of a trail, one row per file (:data:`COMMIT_SCHEMA`); none if there is no trail.

    ``low`` and ``high`` are the times the file's events span, in microseconds since 1970, null if
    none of its events has a time.
    """
    try:
        records = spark.read.schema(COMMIT_SCHEMA).json(f"{path.rstrip('/')}/{COMMITS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return local_frame(spark, COMMIT_SCHEMA, [])
    return records


def files_of_newest(spark: SparkSession, path: str, limit: int) -> list[str] | None:
    """The files that can hold the ``limit`` newest events, by the times they span; None if all can.

    Walking back through the hours, files that begin in an hour hold so many events; once
    the later ones hold ``limit``, no event before that hour is among the newest. Only files
    that end in or behind it are named.
    """
    zones = commits(spark, path).where("events > 0")
    hour = F.col("low") - F.pmod("low", F.lit(HOUR_IN_MICROS))
    first = oldest_needed(zones, hour, limit, F.col("events"))
    if first is None:
        return None
    named = zones.where(F.col("high") >= F.lit(first)).select("file").collect()
    return [f"{path.rstrip('/')}/{r['file']}" for r in named]


def read_recent(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """The newest events of a JSON trail, newest first by time and then identifier.

    Files whose events are all older are not opened.
    """
    files = files_of_newest(spark, path, limit)
    events = read_events(spark, path) if files is None else _read_json(spark, files)
    return newest(events, limit).orderBy(F.desc("timestamp"), F.desc("event_id"))


def retain_newest(events: DataFrame, max_events: int = 1000) -> DataFrame:
    """The events a bounded trail keeps."""
    return newest(events, max_events)


def retain_newest_per_actor(events: DataFrame, max_events: int = 1000) -> DataFrame:
    """The events a bounded trail per actor keeps."""
    return newest_per_key(events, ["actor"], max_events)


def compact(spark: SparkSession, path: str, target: str, max_events: int = 1000) -> None:
    """Write the retained part of a JSON trail to a new place."""
    append_events(retain_newest(read_events(spark, path), max_events), target, "compacted")


def _utc_date(events: DataFrame, time: str) -> Column:
    """Calendar date that grows with the time, whatever the session time zone."""
    at = micros(F.col(time), events.schema[time].dataType)
    day = (at - F.pmod(at, F.lit(_DAY_IN_MICROS))) / F.lit(_DAY_IN_MICROS)
    return F.date_from_unix_date(day.cast("int"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet audit table; filters on ``event_date`` skip whole folders."""
    schema = "event_date DATE, batch STRING"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in AUDIT_SCHEMA)
    return spark.read.schema(f"{fields}, {schema}").parquet(path)


def read_recent_from_table(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """The newest events of the Parquet audit table, newest first.

    Files whose events are all older are not opened.
    """
    files = files_of_newest(spark, path, limit)
    table = read_table(spark, path) if files is None else _read_parquet(spark, files)
    return (
        newest(table, limit)
        .select(*AUDIT_COLUMNS)
        .orderBy(F.desc("timestamp"), F.desc("event_id"))
    )
