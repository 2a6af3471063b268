"""Pipeline runs: decoding status payloads into records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkward.operators.ordered import ROWS_PER_SLICE, in_order, neighbour, running_total

RUN_COLUMNS = ["dag_id", "run_id", "state", "start_date", "end_date"]

# States that keep their name; every other one is "unknown".
KNOWN_STATES = ["queued", "running", "success", "failed"]
UNKNOWN_STATE = "unknown"

_FIELDS = "map<string,variant>"


class RunNotFound(Exception):
    """No run has that pipeline and run identifier."""


def normalize_state(state: Column) -> Column:
    """One of five states; names this library does not know become ``unknown``."""
    return F.when(state.isin(KNOWN_STATES), state).otherwise(F.lit(UNKNOWN_STATE))


def parse_time(text: Column, *, strict: bool = True) -> Column:
    """ISO-8601 text to an instant; ``Z`` is accepted, empty text is null.

    Other text that is no time is an error, or null with ``strict=False``.
    """
    if strict:
        return F.when(F.length(text) > 0, text.cast("timestamp"))
    return F.try_to_timestamp(text)


def is_broken(body: Column) -> Column:
    """A payload that is null, cut off, or no JSON object."""
    return ~F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))


def run_status(payloads: DataFrame, *, strict: bool = True) -> DataFrame:
    """Run records from ``(dag_id, run_id, body)``, ``body`` being JSON text.

    A broken payload is an error. With ``strict=False`` it gives a row without
    state and times instead, so that it is not taken for a run in an unknown state.
    """
    refused = F.raise_error(F.concat(F.lit("Broken payload of run "), F.coalesce("run_id", F.lit("null"))))
    # One parse: the object's fields, or null for what is no object.
    fields = F.try_variant_get(F.try_parse_json("body"), "$", _FIELDS)
    if strict:
        fields = F.coalesce(fields, refused.cast(_FIELDS))
    parsed = payloads.select("dag_id", "run_id", fields.alias("body"))
    text = {name: F.try_variant_get(F.col("body")[name], "$", "string") for name in ("state", "start_date", "end_date")}
    return parsed.select(
        "dag_id",
        "run_id",
        F.when(F.col("body").isNotNull(), normalize_state(text["state"])).alias("state"),
        parse_time(text["start_date"], strict=strict).alias("start_date"),
        parse_time(text["end_date"], strict=strict).alias("end_date"),
    )


def find_run(runs: DataFrame, dag_id: str, run_id: str) -> DataFrame:
    """The row of one run (none if it does not exist)."""
    return runs.where((F.col("dag_id") == dag_id) & (F.col("run_id") == run_id))


def require_run(runs: DataFrame, dag_id: str, run_id: str):
    """The row of one run, or an error."""
    row = find_run(runs, dag_id, run_id).first()
    if row is None:
        raise RunNotFound(f"Unknown run {run_id!r} of {dag_id!r}")
    return row


def service_levels(runs: DataFrame, max_minutes: float) -> DataFrame:
    """Per pipeline: runs by outcome, durations, and finished runs over the limit."""
    seconds = (F.unix_micros("end_date") - F.unix_micros("start_date")) / F.lit(1_000_000.0)
    timed = runs.withColumn("seconds", seconds)
    return timed.groupBy("dag_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("state") == "success").alias("succeeded"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count("seconds").alias("finished"),
        F.avg("seconds").alias("avg_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.count_if(F.col("seconds") > F.lit(max_minutes * 60.0)).alias("over_limit"),
    )


def concurrency(runs: DataFrame, *, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """How many runs of a pipeline were active, from when to when: ``(dag_id, since, until, running)``.

    A run is active from its start up to, but not at, its end; without an end (``until`` is then null for the
    last span) it still is. Runs without a start are not counted, those that end before or at it take no time. Spans without any
    active run are left out.

    Starts and ends are steps of +1 and -1, netted per moment before the shuffle and added up along time in
    slices: a pipeline with any share of the runs is spread over many tasks.
    """
    start, ended = F.col("start_date"), F.col("end_date").isNotNull()
    first = F.struct(start.alias("since"), F.lit(1).cast("long").alias("step"))
    last = F.struct(F.greatest("end_date", "start_date").alias("since"), F.lit(-1).cast("long").alias("step"))
    steps = F.when(ended, F.array(first, last)).otherwise(F.array(first))
    moments = runs.where(start.isNotNull()).select("dag_id", F.inline(steps)).groupBy("dag_id", "since")
    moments = moments.agg(F.sum("step").alias("step")).where("step != 0")
    keys, order = ["dag_id"], ["dag_id", "since"]
    ordered = in_order(moments, order, rows_per_slice=rows_per_slice)
    counted = running_total(ordered, keys, order, "step", "running")
    spans = neighbour(counted, keys, order, ["since"], "_next").where("running > 0")
    return spans.select("dag_id", "since", F.col("_next.since").alias("until"), "running")
