"""Audit events, the trail on disk, retention, and the stream over it."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from conftest import plan
from pyspark.sql import functions as F

from sparkward.operators import audit, policy
from sparkward.operators.newest import newest, newest_per_key
from sparkward.operators.policy import Policy
from sparkward.operators.selection import borders
from sparkward.sources import trail
from sparkward.streaming import monitor

START = datetime(2024, 1, 1, 0, 0, 0, 123456, tzinfo=timezone.utc)
LOG = (
    "request_id LONG, ts TIMESTAMP, actor STRING, sql STRING, "
    "referenced_tables ARRAY<STRING>, estimated_bytes LONG"
)


def decisions_of(spark, statements):
    rows = [
        (i, START + timedelta(minutes=i), f"agent-{i % 2}", sql, tables, 5)
        for i, (sql, tables) in enumerate(statements)
    ]
    return policy.decide(spark.createDataFrame(rows, LOG), Policy(tables=["p.*"]))


STATEMENTS = [
    ("SELECT * FROM p.a", ["p.a"]),
    ("DROP TABLE p.a", None),
    ("SELECT * FROM q.b\n", None),
    ("SELECT 1", None),
]


def event(i, minutes=0, **other):
    row = {
        "event_id": f"e{i:04}", "timestamp": START + timedelta(minutes=minutes),
        "tool_name": "sql_query", "actor": "a", "parameters": "{}", "decision": "allowed",
        "reason": "ok", "backend_job_id": None,
    }
    row.update(other)
    return tuple(row[name] for name in audit.AUDIT_COLUMNS)


def events_of(spark, rows):
    return spark.createDataFrame(rows, audit.AUDIT_SCHEMA)


def test_one_event_per_decision(spark):
    events = audit.query_events(decisions_of(spark, STATEMENTS)).orderBy("timestamp").collect()
    assert [e["decision"] for e in events] == ["allowed", "denied", "denied", "denied"]
    assert [json.loads(e["parameters"]) for e in events] == [
        {"sql": "SELECT * FROM p.a", "referenced_tables": ["p.a"], "estimated_bytes": 5},
        {"sql": "DROP TABLE p.a"},
        {"sql": "SELECT * FROM q.b\n", "candidate_tables": ["q.b"]},
        {"sql": "SELECT 1", "referenced_tables": [], "estimated_bytes": 5},
    ]
    assert len({e["event_id"] for e in events}) == 4
    assert {e["tool_name"] for e in events} == {"sql_query"}
    assert all(e["backend_job_id"] is None for e in events)


def test_events_are_the_same_on_a_rerun(spark):
    first = audit.query_events(decisions_of(spark, STATEMENTS)).collect()
    again = audit.query_events(decisions_of(spark, STATEMENTS).repartition(3)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_trail_keeps_every_field(spark, folder):
    events = audit.query_events(decisions_of(spark, STATEMENTS))
    trail.append_events(events, folder, "b1")
    back = trail.read_events(spark, folder)
    assert back.schema == audit.AUDIT_SCHEMA
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, events.collect()))


def test_newest_first_and_missing_trail(spark, folder):
    assert trail.read_recent(spark, folder).collect() == []
    trail.append_events(events_of(spark, [event(1, 1), event(2, 2)]), folder, "one")
    trail.append_events(events_of(spark, [event(3, 0), event(4, 2)]), folder, "two")
    ids = [e["event_id"] for e in trail.read_recent(spark, folder, 3).collect()]
    assert ids == ["e0004", "e0002", "e0001"]
    assert trail.read_recent(spark, folder).count() == 4


def test_a_batch_written_again_leaves_each_event_once(spark, folder):
    for _ in range(2):
        trail.append_events(events_of(spark, [event(1)]), folder, "same")
        trail.append_table(events_of(spark, [event(1)]), folder + "-table", "same")
    trail.append_table(events_of(spark, [event(2)]), folder + "-table", "other")
    assert trail.read_events(spark, folder).count() == 1
    assert trail.read_table(spark, folder + "-table").count() == 2
    with pytest.raises(ValueError, match="may hold letters"):
        trail.append_events(events_of(spark, [event(1)]), folder, "../x")
    with pytest.raises(ValueError, match="already used for other events"):
        trail.append_events(events_of(spark, [event(2)]), folder, "same")


def test_reused_names_and_reruns_lose_nothing(spark, folder):
    two = events_of(spark, [event(1, 1), event(2, 2)])
    trail.append_events(two, folder, "b")
    three = events_of(spark, [event(1, 1), event(2, 2), event(3, 3)])
    fails = F.when(F.col("event_id") == "e0003", F.raise_error(F.lit("disk full"))).otherwise(F.col("reason"))
    with pytest.raises(Exception, match="disk full"):
        trail.append_events(three.withColumn("reason", fails), folder, "b")
    assert trail.read_events(spark, folder).count() == 2
    trail.append_log_lines(two, folder + "-log", "b")
    with pytest.raises(ValueError, match="already used for other events"):
        trail.append_log_lines(events_of(spark, [event(7)]), folder + "-log", "b")
    assert spark.read.text(folder + "-log").count() == 2
    table = folder + "-table"
    trail.append_table(two, table, "b")
    with pytest.raises(ValueError, match="already used for other events"):
        trail.append_table(events_of(spark, [event(9, 1)]), table, "b")
    # A rerun that moves an event to another date leaves it once.
    trail.append_table(events_of(spark, [event(1, 1), event(2, 60 * 24 * 3)]), table, "b")
    # One that failed half way is completed.
    trail.append_table(events_of(spark, [event(1, 1), event(2, 2), event(4, 4)]), table, "b")
    assert sorted(r["event_id"] for r in trail.read_table(spark, table).collect()) == ["e0001", "e0002", "e0004"]


def test_audit_table_is_partitioned_by_date(spark, folder):
    rows = [event(i, 60 * 24 * i) for i in range(3)]
    trail.append_table(events_of(spark, rows), folder, "b")
    day = trail.read_table(spark, folder).where("event_date = DATE '2024-01-02'")
    assert [r["event_id"] for r in day.collect()] == ["e0001"]
    assert "PartitionFilters: [isnotnull(event_date" in plan(day)


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_newest_of_the_table_opens_few_folders(spark, conf, folder, zone):
    conf("spark.sql.session.timeZone", zone)
    rows = [event(i, 60 * i) for i in range(100)] + [event(999, timestamp=None)]
    trail.append_table(events_of(spark, rows), folder, "b")
    for limit in (0, 1, 3, 30, 100, 101, 500):
        recent = trail.read_recent_from_table(spark, folder, limit)
        expected = newest(events_of(spark, rows), limit)
        assert sorted(map(str, recent.collect())) == sorted(map(str, expected.collect()))
    few = trail.read_recent_from_table(spark, folder, 3)
    assert few.first()["event_id"] == "e0099"
    assert [name.split("event_date=")[1][:10] for name in few.inputFiles()] == ["2024-01-05"]


def test_an_append_opens_no_file_of_another_batch(spark, folder):
    for append, sink in ((trail.append_events, "json"), (trail.append_table, "table"), (trail.append_log_lines, "log")):
        path = f"{folder}-{sink}"
        append(events_of(spark, [event(i, i) for i in range(5)]), path, "first")
        for name in (spark.read.format("binaryFile").load(f"{path}/event_date=2024-01-01").inputFiles()):
            with open(name.removeprefix("file:").replace("///", "/"), "wb") as file:
                file.write(b"no longer readable")
        append(events_of(spark, [event(i, i) for i in range(5, 9)]), path, "second")
        assert {(r["batch"], r["events"]) for r in trail.commits(spark, path).collect()} == {("first", 5), ("second", 4)}


def test_an_event_that_occurs_twice_is_written_once(spark, folder):
    rows = [event(1, 1), event(1, 1), event(2, 2)]
    for append, read in ((trail.append_events, trail.read_events), (trail.append_table, trail.read_table)):
        path = f"{folder}-{append.__name__}"
        append(events_of(spark, rows), path, "b")
        append(events_of(spark, rows[:1] + rows[2:]), path, "b")
        assert sorted(r["event_id"] for r in read(spark, path).collect()) == ["e0001", "e0002"]
        with pytest.raises(ValueError, match="without an identifier"):
            append(events_of(spark, [event(3, event_id=None)]), path, "c")
        assert read(spark, path).count() == 2
        append(events_of(spark, []), path, "empty")
        append(events_of(spark, []), path, "empty")
        assert read(spark, path).count() == 2


def test_an_append_that_stopped_before_its_files_were_moved_is_completed(spark, folder, monkeypatch):
    rows = [event(i, 60 * 24 * i) for i in range(3)]
    with monkeypatch.context() as patched:
        def stop(self, rows):
            if rows:
                raise KeyboardInterrupt

        patched.setattr(trail._Log, "move", stop)
        patched.setattr(trail, "remove", lambda *_: None)  # as after a crash
        with pytest.raises(KeyboardInterrupt):
            trail.append_events(events_of(spark, rows), folder, "b")
    assert trail.read_events(spark, folder).count() == 0
    trail.append_events(events_of(spark, rows), folder, "b")
    assert sorted(r["event_id"] for r in trail.read_events(spark, folder).collect()) == ["e0000", "e0001", "e0002"]


@pytest.mark.parametrize("limit", [0, 1, 3, 7, 200])
def test_the_newest_of_a_json_trail_open_few_files(spark, folder, limit):
    rows = [event(i, 300 * i) for i in range(60)]
    for part in range(4):
        trail.append_events(events_of(spark, rows[part::4]).coalesce(1), folder, f"b{part}")
    trail.append_events(events_of(spark, [event(900, timestamp=None)]), folder, "timeless")
    recent = trail.read_recent(spark, folder, limit)
    expected = newest(events_of(spark, [*rows, event(900, timestamp=None)]), limit)
    assert sorted(map(str, recent.collect())) == sorted(map(str, expected.collect()))
    files = trail.files_of_newest(spark, folder, limit)
    assert files is None if limit == 200 else len(files) <= 4 + limit


def test_requests_without_an_identifier_are_events_of_their_own(spark):
    rows = [(None, START, "a", "SELECT 1", None, 5), (None, START, "b", "SELECT 1", None, 5), (7, START, "a", "SELECT 1", None, 5)]
    decisions = policy.decide(spark.createDataFrame(rows, LOG), Policy(tables=["p.*"]))
    assert audit.query_events(decisions).select("event_id").distinct().count() == 3


def test_misuse_is_no_outage(spark, folder):
    decisions = decisions_of(spark, STATEMENTS)
    events = audit.query_events(decisions)
    trail.append_events(events_of(spark, [event(1)]), folder, "used")
    with pytest.raises(ValueError, match="already used"):
        audit.record_then_release(decisions, events, lambda e: trail.append_events(e, folder, "used"))

    def missing(events):
        raise KeyError("sink")

    with pytest.raises(KeyError):
        audit.record_then_release(decisions, events, missing)


def test_log_lines_are_json(spark, folder):
    trail.append_log_lines(events_of(spark, [event(1, reason='"q"\n')]), folder, "b")
    lines = [r["value"] for r in spark.read.text(folder).collect()]
    assert json.loads(lines[0])["reason"] == '"q"\n'
    assert json.loads(lines[0])["timestamp"] == "2024-01-01T00:00:00.123456Z"


def test_outage_closed_and_open(spark):
    def down(events):
        raise OSError("disk full")

    decisions = decisions_of(spark, STATEMENTS)
    events = audit.query_events(decisions)
    released = audit.record_then_release(decisions, events, down).collect()
    assert len(released) == 4
    assert {(r["allowed"], r["decision"], r["reason"]) for r in released} == {
        (False, "denied", "Denied: audit sink unavailable (fail-closed policy)")
    }
    with pytest.raises(OSError, match="disk full"):
        audit.record_then_release(decisions, events, down, fail_closed=False)
    written = []
    kept = audit.record_then_release(decisions, events, lambda e: written.append(e.count()))
    assert written == [4] and kept.where("allowed").count() == 1


def test_decision_counts(spark):
    counts = audit.decision_counts(audit.query_events(decisions_of(spark, STATEMENTS)))
    assert {tuple(r) for r in counts.collect()} == {
        ("allowed", "sql_query", "agent-0", 1),
        ("denied", "sql_query", "agent-0", 1),
        ("denied", "sql_query", "agent-1", 2),
    }


def test_compaction_keeps_the_newest(spark, folder):
    trail.append_events(events_of(spark, [event(i, i) for i in range(20)]), folder, "b")
    trail.compact(spark, folder, folder + "-small", max_events=5)
    ids = sorted(e["event_id"] for e in trail.read_events(spark, folder + "-small").collect())
    assert ids == [f"e{i:04}" for i in range(15, 20)]


# --- the newest N -----------------------------------------------------------


def skewed(spark, kind):
    """A third of all rows at one instant, some without a time or identifier."""
    draw = random.Random(3)
    rows = []
    for i in range(900):
        moment = START if i % 3 == 0 else START + timedelta(seconds=draw.randint(-10**7, 10**7))
        rows.append((f"{draw.getrandbits(64):016x}", moment, "hot" if i % 3 else f"k{i % 7}"))
    rows += [("zz", None, "hot"), ("aa", None, "hot"), (None, START, "hot")]
    df = spark.createDataFrame(rows, "event_id STRING, timestamp TIMESTAMP, actor STRING")
    return df.withColumn("timestamp", F.col("timestamp").cast(kind)).repartition(5)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("limit", [0, 1, 7, 150, 400, 500, 700, 900, 901, 902, 903, 5000])
def test_large_limits_equal_a_sort(spark, kind, limit):
    df = skewed(spark, kind)
    expected = df.orderBy(F.desc_nulls_last("timestamp"), F.desc_nulls_last("event_id")).limit(limit)
    rows = sorted(map(str, expected.collect()))
    assert sorted(map(str, newest(df, limit).collect())) == rows
    for ranked in (1, 20):
        got = newest(df, limit, direct_rows=0, ranked_rows=ranked)
        assert sorted(map(str, got.collect())) == rows


@pytest.mark.parametrize("limit", [150, 199])
def test_many_events_of_one_time(spark, limit):
    moment = F.lit(START).cast("timestamp")
    ids = spark.range(200).select((F.col("id") * 37 % 1000 - 300).alias("n")).repartition(3)
    for key in (F.col("n"), F.format_string("event-000000000000-%04d", F.col("n") + 300), F.col("n").cast("int")):
        df = ids.select(key.alias("event_id"), moment.alias("timestamp"))
        df = df.unionByName(df.limit(1).withColumn("event_id", F.lit(None).cast(df.schema["event_id"].dataType)))
        expected = df.orderBy(F.desc_nulls_last("event_id")).limit(limit)
        got = newest(df, limit, direct_rows=0, ranked_rows=10)
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_a_large_limit_skips_older_files(spark, folder):
    df = skewed(spark, "timestamp")
    df.write.parquet(folder)
    text = plan(newest(spark.read.parquet(folder), 200, ranked_rows=1))
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp," in text


@pytest.mark.parametrize("limit", [1, 5, 300, 2000])
@pytest.mark.parametrize("slices", [1, 3, None])
def test_newest_per_key_equals_a_ranking(spark, limit, slices):
    df = skewed(spark, "timestamp")
    df.createOrReplaceTempView("skewed_events")
    expected = spark.sql(
        "SELECT event_id, timestamp, actor FROM (SELECT *, row_number() OVER (PARTITION BY actor "
        "ORDER BY timestamp DESC NULLS LAST, event_id DESC NULLS LAST) AS r FROM skewed_events) "
        f"WHERE r <= {limit}"
    )
    got = newest_per_key(df, ["actor"], limit, slices=slices)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    for ranked_rows in (5, 40) if slices == 3 else ():
        narrowed = newest_per_key(df, ["actor"], limit, slices=slices, ranked_rows=ranked_rows)
        assert sorted(map(str, narrowed.collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_newest_of_a_key_with_most_events_at_one_time(spark, kind):
    ids = spark.range(500).select((F.col("id") * 37 % 1000 - 300).alias("n")).repartition(3)
    key = F.format_string("x%04d", F.col("n") + 300) if kind == "string" else F.col("n").cast(kind)
    df = ids.select(key.alias("event_id"), F.lit(START).cast("timestamp").alias("timestamp"), F.lit("hot").alias("actor"))
    df = df.unionByName(df.limit(3).withColumn("event_id", F.lit(None).cast(df.schema["event_id"].dataType)))
    expected = df.orderBy(F.desc_nulls_last("event_id")).limit(60)
    got = newest_per_key(df, ["actor"], 60, ranked_rows=10)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_borders_of_weighted_groups(spark):
    draw = random.Random(8)
    rows = [(f"g{draw.randint(0, 3)}", draw.expovariate(1) ** 4, draw.randint(0, 9)) for _ in range(2000)]
    rows += [("g1", 0.5, 3)] * 200 + [(None, None, 5), (None, 1.0, 5)]
    df = spark.createDataFrame(rows, "k STRING, at DOUBLE, w LONG").repartition(4)
    wanted = spark.createDataFrame([("g0", 900), ("g1", 1500), ("g2", 10**6), ("g3", 0), (None, 3), ("none", 1)], "k STRING, wanted LONG")
    found = {r["k"]: r for r in borders(df, ["k"], "at", "w", wanted, ranked_rows=10, cells=8).collect()}
    assert set(found) == {"g0", "g1", "g2", "g3", None}
    for k, r in found.items():
        own = [(at, w) for g, at, w in rows if g == k and at is not None]
        before = sum(w for at, w in own if at < r["low"])
        upto = sum(w for at, w in own if at <= r["high"])
        n = sum(r["low"] <= at <= r["high"] for at, _ in own)
        assert (before, n) == (r["before"], r["n"]) and (n <= 10 or r["low"] == r["high"])
        assert before <= r["wanted"] and (upto >= r["wanted"] or upto == sum(w for _, w in own))


def test_newest_per_key_of_odd_keys(spark):
    df = spark.sql(
        "SELECT id AS event_id, timestamp_micros(id * 1000000) AS timestamp, "
        "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN NULL ELSE '' END AS actor, id % 2 AS kind FROM range(60)"
    )
    got = newest_per_key(df, ["actor", "kind"], 2).groupBy("actor", "kind").agg(F.min("event_id"), F.count("*"))
    assert {tuple(r) for r in got.collect()} == {
        ("a", 0, 48, 2), ("a", 1, 51, 2), (None, 0, 52, 2), (None, 1, 49, 2), ("", 0, 50, 2), ("", 1, 53, 2),
    }
    assert newest_per_key(df, ["actor"], 0).isEmpty()
    assert newest_per_key(df.where("false"), ["actor"], 3).isEmpty()


def test_a_trail_that_was_hit_by_a_failure_keeps_its_events(spark, folder):
    first = events_of(spark, [event(i, i) for i in range(3)])
    broken = first.withColumn("reason", F.raise_error(F.lit("lost")).cast("string"))
    for append, read in ((trail.append_events, trail.read_events), (trail.append_table, trail.read_table)):
        path = f"{folder}-{append.__name__}"
        append(first.limit(2), path, "b1")
        with pytest.raises(Exception, match="lost"):
            append(broken, path, "b1")
        assert read(spark, path).count() == 2
        append(first, path, "b1")
        assert sorted(r["event_id"] for r in read(spark, path).collect()) == sorted(
            r["event_id"] for r in first.collect()
        )


# --- streaming --------------------------------------------------------------


def streamed(spark, source, folder):
    out = folder + "-windows"
    events = monitor.read_events_stream(spark, source, max_files=1)
    query = monitor.run_to_files(
        monitor.decision_windows(events), out, folder + "-windows-state"
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def test_windows_count_each_event_once(spark, folder):
    first = [event(i, i) for i in range(25)]
    repeated = first[20:] + [event(90, 26, decision="denied")]
    trail.append_events(events_of(spark, first).coalesce(1), folder, "b1")
    trail.append_events(events_of(spark, repeated).coalesce(1), folder, "b2")
    closing = [event(99, 120)]
    trail.append_events(events_of(spark, closing).coalesce(1), folder, "b3")
    rows = streamed(spark, folder, folder).orderBy("window_start", "decision").collect()
    assert [(r["window_start"].minute, r["decision"], r["events"]) for r in rows] == [
        (0, "allowed", 10), (10, "allowed", 10), (20, "allowed", 5), (20, "denied", 1),
    ]


def test_streams_keep_state_on_disk_in_few_parts(spark, conf, folder):
    conf("spark.sql.shuffle.partitions", "40")
    made = spark.range(2000).selectExpr(
        "CAST(id % 1900 AS STRING) AS event_id", "timestamp_seconds(1700000000 + id % 1900 * 3) AS timestamp",
        "'op' AS tool_name", "'a' AS actor", "'{}' AS parameters", "'allowed' AS decision", "'' AS reason",
        "CAST(NULL AS STRING) AS backend_job_id",
    )
    trail.append_events(made, folder, "a")
    windows = monitor.decision_windows(monitor.read_events_stream(spark, folder), window="1 minute")
    monitor.run_to_files(windows, folder + "-out", folder + "-state").awaitTermination()
    closed = spark.read.parquet(folder + "-out")
    in_closed = made.dropDuplicates(["event_id"]).where(
        F.date_trunc("minute", "timestamp") + F.expr("INTERVAL 2 MINUTES") <= F.lit(made.agg(F.max("timestamp")).first()[0])
    )
    assert closed.agg(F.sum("events")).first()[0] == in_closed.count()
    state = Path(folder + "-state")
    parts = [[d for d in (state / "state" / operator).iterdir() if d.name.isdigit()] for operator in "01"]
    assert [len(p) for p in parts] == [32, 32]
    assert "RocksDB" in (state / "offsets" / "0").read_text()
    assert spark.conf.get("spark.sql.shuffle.partitions") == "40"


def test_a_stopped_stream_goes_on(spark, folder):
    trail.append_events(events_of(spark, [event(1, 1), event(2, 12)]), folder, "b1")
    assert streamed(spark, folder, folder).count() == 1
    trail.append_events(events_of(spark, [event(3, 45)]), folder, "b2")
    rows = streamed(spark, folder, folder).orderBy("window_start").collect()
    assert [(r["window_start"].minute, r["events"]) for r in rows] == [(0, 1), (10, 1)]


def test_stream_into_the_audit_table(spark, folder):
    trail.append_events(events_of(spark, [event(i, i) for i in range(10)]), folder, "b1")
    for _ in range(2):
        query = monitor.stream_to_table(
            monitor.read_events_stream(spark, folder), folder + "-table", folder + "-state", "s"
        )
        query.awaitTermination()
    assert trail.read_table(spark, folder + "-table").count() == 10


def test_stream_into_a_trail_and_into_lines(spark, folder):
    trail.append_events(events_of(spark, [event(i, i) for i in range(10)]), folder, "b1")
    for _ in range(2):
        stream = monitor.read_events_stream(spark, folder)
        monitor.stream_to_trail(
            stream, folder + "-copy", folder + "-state", "s"
        ).awaitTermination()
        monitor.stream_log_lines(stream, folder + "-lines", folder + "-ls").awaitTermination()
    copied = trail.read_events(spark, folder + "-copy")
    assert sorted(map(tuple, copied.collect())) == sorted(
        map(tuple, trail.read_events(spark, folder).collect())
    )
    lines = [json.loads(r["value"]) for r in spark.read.text(folder + "-lines").collect()]
    assert sorted(line["event_id"] for line in lines) == [f"e{i:04}" for i in range(10)]


def test_metric_windows_equal_the_batch(spark, folder):
    rows = [(START + timedelta(minutes=i), None if i % 4 == 0 else 1.0) for i in range(200)]
    spark.createDataFrame(rows, "ts TIMESTAMP, value DOUBLE").write.parquet(folder)
    stream = spark.readStream.schema("ts TIMESTAMP, value DOUBLE").parquet(folder)
    query = monitor.run_to_files(
        monitor.metric_windows(stream, "ts", ["value"]), folder + "-out", folder + "-state"
    )
    query.awaitTermination()
    got = spark.read.parquet(folder + "-out").orderBy("window_start").collect()
    assert [(r["rows"], r["null_rate_value"]) for r in got] == [(60, 0.25)] * 3
