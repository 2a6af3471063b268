"""Running one SQL statement under the policy, in a session of its own."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkward.functions.sqltext import JVM_CALL_WORDS
from sparkward.operators import policy as rules
from sparkward.operators.audit import event_id, query_events, record_then_release
from sparkward.operators.checks import run_suite, scan_counts
from sparkward.operators.policy import Policy, PolicyDenied
from sparkward.plans.footprint import Footprint, NotEstimable, estimate, footprint_frame
from sparkward.session import V1_SOURCES, local_frame
from sparkward.sources.specs import CheckSpec

_REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("actor", T.StringType()),
        T.StructField("sql", T.StringType()),
        T.StructField("referenced_tables", T.ArrayType(T.StringType())),
        T.StructField("estimated_bytes", T.LongType()),
    ]
)

_JUDGED = T.StructType(
    _REQUEST.fields
    + [
        T.StructField("read_only", T.BooleanType()),
        T.StructField("sql_reason", T.StringType()),
        T.StructField("candidate_tables", T.ArrayType(T.StringType())),
        T.StructField("preflight_reason", T.StringType()),
    ]
)


def open_session(
    spark: SparkSession,
    tables: Mapping[str, str | Callable[[SparkSession], DataFrame]],
    *,
    whole_files: bool = False,
) -> SparkSession:
    """A session that sees the given tables and nothing else by name.

    ``tables`` maps logical names (``project.dataset.table``; quote them with
    backticks in SQL) to Parquet paths, or to functions that read a DataFrame in
    the session given to them. Reading files by path is switched off, and each
    view is a projection, which no INSERT is accepted into. ``whole_files`` keeps
    Spark's default readers, whose sizes are those of the files, whichever reader
    the given session uses.
    """
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and session.conf.isModifiable(name):
            session.conf.set(name, value)
    if whole_files:
        session.conf.unset(V1_SOURCES)
    for name, source in tables.items():
        df = session.read.parquet(source) if isinstance(source, str) else source(session)
        df.select("*").createOrReplaceTempView(f"`{name}`")
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    # Plans are read in full before a statement runs.
    session.conf.set("spark.sql.debug.maxToStringFields", str(2**31 - 1))
    return session


@dataclass(frozen=True)
class _Outcome:
    """The decision on one statement."""

    allowed: bool
    reason: str
    event_id: str
    footprint: Footprint | None
    cause: NotEstimable | None

    def require(self) -> Footprint:
        """The footprint of an allowed statement; a denial is raised."""
        if not self.allowed:
            raise PolicyDenied(self.reason, self.event_id) from self.cause
        return self.footprint


@dataclass(frozen=True)
class QueryResult:
    """Rows of a statement with the number behind a cut, and what reading them takes."""

    rows: DataFrame
    total_rows: int
    truncated: bool
    footprint: Footprint


class GovernedSession:
    """Estimates and runs statements that pass the policy.

    ``write_events`` receives every decision as a DataFrame of audit events
    before anything is released; see ``sources.trail.append_events``.
    """

    def __init__(
        self,
        spark: SparkSession,
        tables: Mapping[str, str | Callable[[SparkSession], DataFrame]],
        policy: Policy,
        write_events: Callable[[DataFrame], None],
        *,
        fail_closed: bool = True,
    ) -> None:
        self._spark = spark
        self._session = open_session(spark, tables)
        # Another reader scales the sizes of files by the columns read; bounds come from the default.
        same_reader = spark.conf.get(V1_SOURCES) == spark.newSession().conf.get(V1_SOURCES)
        self._planning = (
            self._session if same_reader else open_session(spark, tables, whole_files=True)
        )
        self._policy = policy
        self._write_events = write_events
        self._fail_closed = fail_closed

    def estimate(self, sql: str, *, actor: str) -> Footprint:
        """Bytes, cost and tables of a statement; denied like a query would be."""
        return self._authorize([sql], actor, "sql_estimate")[0].require()

    def footprints(self, statements: Mapping[str, str], *, actor: str) -> DataFrame:
        """Footprints of several named statements as rows; one denial is an error."""
        outcomes = self._authorize(list(statements.values()), actor, "sql_estimate")
        found = {name: o.require() for name, o in zip(statements, outcomes, strict=True)}
        return footprint_frame(self._spark, found)

    def query(self, sql: str, *, actor: str, row_limit: int | None = None) -> DataFrame:
        """Rows of a statement, at most ``row_limit`` and the policy's ceiling."""
        return self._capped(self._checked(sql, actor), row_limit)

    def run(self, sql: str, *, actor: str, row_limit: int | None = None) -> QueryResult:
        """Rows as :meth:`query` gives them, and what was cut: decided and recorded once."""
        outcome = self._authorize([sql], actor, "sql_query")[0]
        footprint = outcome.require()
        whole = self._session.sql(sql)
        total, cap = whole.count(), self.row_cap(row_limit)
        cut = cap is not None and total > cap
        return QueryResult(self._capped(whole, row_limit), total, cut, footprint)

    def _capped(self, rows: DataFrame, row_limit: int | None) -> DataFrame:
        cap = self.row_cap(row_limit)
        return rows if cap is None else rows.limit(cap)

    def total_rows(self, sql: str, *, actor: str) -> DataFrame:
        """Number of rows behind a capped result, as one row."""
        return self._checked(sql, actor).agg(F.count(F.lit(1)).alias("total_rows"))

    def run_checks(
        self, specs: Sequence[CheckSpec], *, actor: str, as_of: str | None = None
    ) -> tuple[DataFrame | None, dict[str, str]]:
        """Results of the tables the policy allows, and reasons for the others.

        Each table is decided once, before any is scanned, and charged for every
        scan its checks need; a denied table does not cost the others their results.
        """
        scans = scan_counts(self._spark, specs)
        names = list(scans)
        statements = [f"SELECT * FROM `{name}`" for name in names]
        decided = self._authorize(statements, actor, "quality_checks", list(scans.values()))
        outcomes = dict(zip(names, decided, strict=True))
        denied = {name: o.reason for name, o in outcomes.items() if not o.allowed}
        tables = {
            name: self._session.table(f"`{name}`") for name, o in outcomes.items() if o.allowed
        }
        allowed = [spec for spec in specs if spec.table in tables]
        return (run_suite(tables, allowed, as_of=as_of) if allowed else None), denied

    def row_cap(self, requested: int | None = None) -> int | None:
        """The smaller of what is asked for and the policy's ceiling; None is no cap."""
        if requested is not None and requested < 1:
            raise ValueError("row_limit must be at least 1")
        given = [cap for cap in (requested, self._policy.max_rows) if cap is not None]
        return min(given, default=None)

    def _checked(self, sql: str, actor: str) -> DataFrame:
        self._authorize([sql], actor, "sql_query")[0].require()
        return self._session.sql(sql)

    def _authorize(
        self, statements: list[str], actor: str, operation: str, scans: list[int] | None = None
    ) -> list[_Outcome]:
        """Decide on some statements and write all decisions to the trail at once.

        ``scans`` is how often each statement is going to read its tables, once unless given.
        """
        now = datetime.now(timezone.utc)
        requests = [[uuid.uuid4().hex, now, actor, sql, None, None] for sql in statements]
        frame = local_frame(self._spark, _REQUEST, requests)
        # The text is judged before Spark plans it.
        text = rules.judge_text(frame, self._policy, extra_words=JVM_CALL_WORDS)
        found = {row["request_id"]: row.asDict() for row in text.collect()}
        judged = {i: found[i] for i, *_ in requests}
        times = dict(zip(judged, scans or [1] * len(judged), strict=True))
        footprints: dict[str, Footprint] = {}
        causes: dict[str, NotEstimable] = {}
        for request_id, row in judged.items():
            if row["preflight_reason"] is None:
                try:
                    once = estimate(self._planning, row["sql"])
                except NotEstimable as cause:
                    # Nothing could be resolved, which the second phase refuses.
                    causes[request_id] = cause
                else:
                    scanned = once.estimated_bytes * times[request_id]
                    footprints[request_id] = replace(once, estimated_bytes=scanned)
                    row["referenced_tables"] = list(once.referenced_tables)
                    row["estimated_bytes"] = scanned
        frame = local_frame(
            self._spark, _JUDGED, [[row[name] for name in _JUDGED.names] for row in judged.values()]
        )
        decisions = rules.judge_estimate(frame, self._policy)
        released = record_then_release(
            decisions,
            query_events(decisions, operation),
            self._write_events,
            fail_closed=self._fail_closed,
        ).select(
            "request_id",
            "allowed",
            "reason",
            event_id(F.col("request_id"), F.col("phase")).alias("event_id"),
        )
        found = {row["request_id"]: row for row in released.collect()}
        return [
            _Outcome(
                found[i]["allowed"],
                found[i]["reason"],
                found[i]["event_id"],
                footprints.get(i),
                causes.get(i),
            )
            for i, *_ in requests
        ]
