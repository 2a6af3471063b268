"""Windows of a stream with late events as rows, against a plain recount in Python."""

from __future__ import annotations

from datetime import datetime, timedelta


from sparkward.operators.audit import AUDIT_SCHEMA
from sparkward.streaming import sides

START = datetime(2024, 1, 1)


def event(number, minute, decision="allowed"):
    at = None if minute is None else START + timedelta(minutes=minute)
    name = None if number is None else f"e{number:04}"
    return (name, at, "sql_query", "agent-1", "{}", decision, "", None)


def arrive(spark, folder, batch, rows, **options):
    frame = spark.createDataFrame(rows, AUDIT_SCHEMA).coalesce(1)
    frame.write.mode("append").json(f"{folder}/{batch}", **{"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    events = spark.readStream.schema(AUDIT_SCHEMA).json(f"{folder}/*")
    given = sides.windows_with_late(events, **options)
    sides.late_to_files(given, folder + "-out", folder + "-state").awaitTermination()
    return spark.read.schema(given.schema).parquet(folder + "-out")


def totals(given):
    rows = sides.window_totals(given).orderBy("window_start", "decision").collect()
    return [
        ((r["window_start"] - START) // timedelta(minutes=1), r["decision"], r["events"], r["late"])
        for r in rows
    ]


def test_late_events_are_rows_and_repeated_ones_count_once(spark, folder):
    first = [event(i, i) for i in range(30)] + [event(3, 3), event(90, 26, "denied"), event(None, 4)]
    given = arrive(spark, folder, "a", first + [event(99, 60)], slices=3)
    assert totals(given) == [
        (0, "allowed", 11, 0), (10, "allowed", 10, 0), (20, "allowed", 10, 0), (20, "denied", 1, 0),
    ]
    # Late, late twice, repeated though in time, without time, and one in time.
    second = [event(200, 5), event(200, 5), event(7, 7), event(201, 15, "denied"), event(300, None), event(301, 61)]
    given = arrive(spark, folder, "b", second, slices=3)
    late = given.where("late").orderBy("event_id").collect()
    assert [(r["event_id"], r["decision"], r["events"]) for r in late] == [
        ("e0200", "allowed", 1), ("e0201", "denied", 1),
    ]
    # The same late events again are known.
    given = arrive(spark, folder, "c", [event(200, 5), event(201, 15, "denied"), event(400, 90)], slices=3)
    assert given.where("late").count() == 2
    assert totals(given) == [
        (0, "allowed", 11, 1), (10, "allowed", 10, 0), (10, "denied", 0, 1),
        (20, "allowed", 10, 0), (20, "denied", 1, 0), (60, "allowed", 2, 0),
    ]


def test_forgotten_windows_give_late_events_without_state(spark, folder):
    options = {"remember": "20 minutes", "slices": 2}
    arrive(spark, folder, "a", [event(i, i) for i in range(10)] + [event(99, 300)], **options)
    given = arrive(spark, folder, "b", [event(1, 1), event(1, 1), event(50, 2)], **options)
    # Repeated after it was forgotten: late, as is a new one; twice in one batch: once.
    assert sorted(r["event_id"] for r in given.where("late").collect()) == ["e0001", "e0050"]
    assert totals(given) == [(0, "allowed", 10, 2)]


def test_slices_do_not_change_the_totals(spark, folder):
    rows = [event(i, i % 50, "denied" if i % 3 else "allowed") for i in range(200)] + [event(999, 100)]
    got = [totals(arrive(spark, f"{folder}-{n}", "a", rows, slices=n)) for n in (1, 7)]
    assert got[0] == got[1]
    want = {}
    for i in range(200):
        kind = (i % 50 // 10 * 10, "denied" if i % 3 else "allowed")
        want[kind] = want.get(kind, 0) + 1
    assert got[0] == [(*kind, n, 0) for kind, n in sorted(want.items())]


def test_session_settings_stay(spark, folder):
    name = next(iter(sides.STATE_CONF))
    before = spark.conf.get(name, None)
    arrive(spark, folder, "a", [event(1, 1)], slices=1)
    assert spark.conf.get(name, None) == before
