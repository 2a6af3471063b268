"""Guarded reading of inventories: decide, record the decision, then read."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkward.operators.audit import access_events, record_then_release
from sparkward.operators.policy import Policy, decide_buckets, decide_dags, require_allowed
from sparkward.session import local_frame
from sparkward.sources import objects as object_source
from sparkward.sources import runs as run_source


def _request_schema(asked: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("request_id", T.StringType()),
            T.StructField("ts", T.TimestampType()),
            T.StructField("actor", T.StringType()),
            T.StructField(asked, T.StringType()),
        ]
    )


class GuardedInventories:
    """Objects and pipeline runs for actors the policy allows to see them.

    Every request is decided and recorded (``write_events``) before a row is
    released; a denial is a ``PolicyDenied``. The inventories are DataFrames, so
    the bucket, the prefix and the identifiers reach their scans as filters.
    """

    def __init__(
        self,
        spark: SparkSession,
        policy: Policy,
        write_events: Callable[[DataFrame], None],
        *,
        fail_closed: bool = True,
    ) -> None:
        self._spark = spark
        self._policy = policy
        self._write_events = write_events
        self._fail_closed = fail_closed

    def list_objects(
        self,
        objects: DataFrame,
        bucket: str,
        prefix: str = "",
        max_results: int = object_source.DEFAULT_MAX_RESULTS,
        *,
        actor: str,
    ) -> DataFrame:
        """Objects of an allowed bucket, by name."""
        self._authorize("bucket", bucket, actor, "object_list")
        return object_source.list_objects(objects, bucket, prefix, max_results)

    def object_metadata(
        self, objects: DataFrame, bucket: str, name: str, *, actor: str
    ) -> DataFrame:
        """The row of one object of an allowed bucket."""
        self._authorize("bucket", bucket, actor, "object_metadata")
        return object_source.object_metadata(objects, bucket, name)

    def run_status(self, runs: DataFrame, dag_id: str, run_id: str, *, actor: str) -> DataFrame:
        """The record of one run of an allowed pipeline."""
        self._authorize("dag_id", dag_id, actor, "run_status")
        return run_source.find_run(runs, dag_id, run_id)

    def _authorize(self, asked: str, value: str, actor: str, operation: str) -> None:
        row = [uuid.uuid4().hex, datetime.now(timezone.utc), actor, value]
        request = local_frame(self._spark, _request_schema(asked), [row])
        decide = decide_buckets if asked == "bucket" else decide_dags
        decision = decide(request, self._policy)
        require_allowed(
            record_then_release(
                decision,
                access_events(decision, operation, asked),
                self._write_events,
                fail_closed=self._fail_closed,
            )
        )
