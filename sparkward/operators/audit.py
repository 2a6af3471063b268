"""From decisions to audit events: one per decision, reproducible on a rerun."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOG = logging.getLogger(__name__)

ALLOWED, DENIED = "allowed", "denied"

AUDIT_COLUMNS = [
    "event_id", "timestamp", "tool_name", "actor",
    "parameters", "decision", "reason", "backend_job_id",
]

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("actor", T.StringType()),
        T.StructField("parameters", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("backend_job_id", T.StringType()),
    ]
)

# Spark writes times in JSON to the millisecond unless told otherwise.
JSON_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

UNAVAILABLE_REASON = "Denied: audit sink unavailable (fail-closed policy)"


def event_id(request_id: Column, phase: Column) -> Column:
    """Identifier that stays the same when a batch is run again."""
    return F.sha2(F.concat_ws("|", request_id.cast("string"), phase), 256)


def query_events(decisions: DataFrame, operation: str = "sql_query") -> DataFrame:
    """Events of SQL decisions (the output of ``policy.decide``).

    A denial by the text alone records the statement, and the names found in it
    if they were the reason; a decision after an estimate records the estimate
    too. A null field is left out of ``parameters``.
    """
    authorized = F.col("phase") == "authorize"
    parameters = F.struct(
        F.col("sql"),
        F.col("candidate_tables"),
        F.when(
            authorized, F.coalesce("referenced_tables", F.array().cast("array<string>"))
        ).alias("referenced_tables"),
        F.when(authorized, F.col("estimated_bytes")).alias("estimated_bytes"),
    )
    return _events(decisions, operation, parameters, F.col("phase"))


def access_events(decisions: DataFrame, operation: str, column: str) -> DataFrame:
    """Events of bucket or pipeline decisions; ``column`` holds what was asked for."""
    return _events(decisions, operation, F.struct(F.col(column)), F.lit(operation))


def _events(
    decisions: DataFrame, operation: str, parameters: Column, phase: Column
) -> DataFrame:
    # A request without an identifier is told from others by what it holds.
    content = F.to_json(F.struct("ts", "actor", parameters.alias("parameters")))
    request = F.coalesce(F.col("request_id").cast("string"), F.concat(F.lit("content:"), F.sha2(content, 256)))
    return decisions.select(
        event_id(request, phase).alias("event_id"),
        F.col("ts").alias("timestamp"),
        F.lit(operation).alias("tool_name"),
        F.col("actor"),
        F.to_json(parameters).alias("parameters"),
        F.col("decision"),
        F.col("reason"),
        F.lit(None).cast("string").alias("backend_job_id"),
    )


def log_lines(events: DataFrame, *others: str) -> DataFrame:
    """Each event as one line of JSON in a column ``value``, for text sinks; with ``others`` beside it."""
    return events.select(F.to_json(F.struct(*AUDIT_COLUMNS), JSON_TIMES).alias("value"), *others)


def record_then_release(
    decisions: DataFrame,
    events: DataFrame,
    write: Callable[[DataFrame], None],
    *,
    fail_closed: bool = True,
) -> DataFrame:
    """Write the events first, then hand out the decisions.

    If the trail cannot be written, the cause is logged and every decision of the
    batch becomes a denial; with ``fail_closed=False`` the error is raised instead.
    A fault of the program (an unresolved column, a wrong type, a batch name that was used
    before, an event without an identifier) is always raised: it is no outage.
    """
    try:
        write(events)
    except (AnalysisException, TypeError, NameError, AttributeError, LookupError, ValueError):
        raise
    except Exception:
        if not fail_closed:
            raise
        _LOG.exception("The audit trail could not be written; the batch is denied")
        return decisions.withColumns(
            {
                "allowed": F.lit(False),
                "decision": F.lit(DENIED),
                "reason": F.lit(UNAVAILABLE_REASON),
            }
        )
    return decisions


def decision_counts(events: DataFrame) -> DataFrame:
    """Decisions by kind, operation and actor."""
    return events.groupBy("decision", "tool_name", "actor").agg(
        F.count(F.lit(1)).alias("decisions")
    )
