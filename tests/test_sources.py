"""Objects and pipeline runs."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from conftest import plan
from pyspark.sql import functions as F

from sparkward.session import shared_dir
from sparkward.sources import objects, runs

OBJECTS = [
    ("b1", "raw/b.csv", 200), ("b1", "raw/a.csv", 100), ("b1", "curated/c.csv", 5),
    ("b2", "raw/a.csv", 7),
]


@pytest.fixture(scope="module")
def inventory(spark):
    return spark.createDataFrame(OBJECTS, "bucket STRING, name STRING, size_bytes LONG")


def names(df):
    return [r["name"] for r in df.collect()]


def test_listing(inventory):
    assert names(objects.list_objects(inventory, "b1")) == ["curated/c.csv", "raw/a.csv", "raw/b.csv"]
    assert names(objects.list_objects(inventory, "b1", "raw/")) == ["raw/a.csv", "raw/b.csv"]
    assert names(objects.list_objects(inventory, "b1", "raw/", 1)) == ["raw/a.csv"]
    assert names(objects.list_objects(inventory, "b3")) == []
    assert names(objects.list_objects(inventory, "b1", "raw/%")) == []
    with pytest.raises(ValueError, match="max_results"):
        objects.list_objects(inventory, "b1", max_results=0)


def test_metadata_of_one_object(inventory):
    assert objects.require_object(inventory, "b2", "raw/a.csv")["size_bytes"] == 7
    with pytest.raises(objects.ObjectNotFound, match="No such object: b2/nope"):
        objects.require_object(inventory, "b2", "nope")


def test_filters_reach_an_inventory_table(spark, inventory, folder):
    inventory.write.parquet(folder)
    text = plan(objects.list_objects(spark.read.parquet(folder), "b1", "raw/"))
    assert "EqualTo(bucket,b1), StringStartsWith(name,raw/)" in text
    assert "TakeOrderedAndProject" in text


def test_files_without_their_contents(spark, folder):
    os.makedirs(f"{folder}/deep/er")
    for name, text in (("a.csv", "12345"), ("deep/b.JSON", "{}"), ("deep/er/c", ""),
                       ("deep/er/d e%.txt", "x"), (".hidden", "x"), ("deep/_x.gz", "y")):
        with open(f"{folder}/{name}", "w") as out:
            out.write(text)
    files = objects.list_files(spark, folder, "box")
    assert files.columns == objects.OBJECT_COLUMNS
    assert {(r["bucket"], r["name"], r["size_bytes"], r["content_type"], r["etag"])
            for r in files.collect()} == {
        ("box", "a.csv", 5, "text/csv", None),
        ("box", "deep/b.JSON", 2, "application/json", None),
        ("box", "deep/er/d e%.txt", 1, "text/plain", None),
    }
    # Spark's file sources know neither empty files nor names with these first signs.
    assert "content" not in plan(files).split("ReadSchema")[1].split("\n")[0]
    updated = files.where("name = 'a.csv'").select(F.unix_seconds("updated_at")).first()[0]
    assert abs(updated - os.stat(f"{folder}/a.csv").st_mtime) < 60
    assert {r["name"] for r in objects.list_files(spark, f"file://{folder}").collect()} == {
        r["name"] for r in files.collect()
    }
    with pytest.raises(Exception, match="nowhere"):
        objects.list_files(spark, f"{folder}/nowhere")


PAYLOADS = [
    ("d1", "r1", '{"dag_run_id": "r1", "state": "success", "start_date": "2024-01-01T00:00:00Z", '
                 '"end_date": "2024-01-01T01:00:00.5+00:00"}'),
    ("d1", "r2", '{"state": "running", "start_date": "2024-01-01T02:00:00+02:00", "end_date": null}'),
    ("d2", "r3", '{"state": "up_for_retry", "start_date": ""}'),
    ("d2", "r4", '{"start_date": null}'),
    ("d2", "r5", '{"state": "failed", "start_date": "2024-01-01T00:00:00Z", '
                 '"end_date": "2024-01-01T00:30:00Z"}'),
    ("d2", "r6", '{"state": "queued"}'),
]


def payloads(spark):
    return spark.createDataFrame(PAYLOADS, "dag_id STRING, run_id STRING, body STRING")


def test_run_status(spark):
    rows = {r["run_id"]: tuple(r)[2:] for r in runs.run_status(payloads(spark)).collect()}
    midnight = datetime(2024, 1, 1)
    assert rows == {
        "r1": ("success", midnight, datetime(2024, 1, 1, 1, 0, 0, 500000)),
        "r2": ("running", midnight, None),
        "r3": ("unknown", None, None),
        "r4": ("unknown", None, None),
        "r5": ("failed", midnight, datetime(2024, 1, 1, 0, 30)),
        "r6": ("queued", None, None),
    }


def test_times_that_are_none(spark):
    bad = spark.createDataFrame(
        [("d", "r", '{"state": "success", "start_date": "yesterday"}')],
        "dag_id STRING, run_id STRING, body STRING",
    )
    with pytest.raises(Exception, match="yesterday"):
        runs.run_status(bad).collect()
    assert runs.run_status(bad, strict=False).first()["start_date"] is None


@pytest.mark.parametrize("body", [None, "", "down for repair", '{"state": "succ', "[1]", '"success"'])
def test_broken_payloads(spark, body):
    bad = spark.createDataFrame([("d", "r", body)], "dag_id STRING, run_id STRING, body STRING")
    with pytest.raises(Exception, match="Broken payload of run r"):
        runs.run_status(bad).collect()
    assert tuple(runs.run_status(bad, strict=False).first()) == ("d", "r", None, None, None)


def test_lookup(spark):
    status = runs.run_status(payloads(spark))
    assert runs.require_run(status, "d1", "r2")["state"] == "running"
    with pytest.raises(runs.RunNotFound, match="Unknown run 'r2' of 'd2'"):
        runs.require_run(status, "d2", "r2")


def test_service_levels(spark):
    rows = runs.service_levels(runs.run_status(payloads(spark)), max_minutes=45).collect()
    assert {tuple(r) for r in rows} == {
        ("d1", 2, 1, 0, 1, 3600.5, 3600.5, 1), ("d2", 4, 0, 1, 1, 1800.0, 1800.0, 0),
    }


def test_shared_folder_follows_the_session(spark):
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first.startswith(spark.conf.get("spark.checkpoint.dir") + "/x-") and first != second
