"""Registered queries: policy over the derived query log, and the audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.functions.sqltext import FORBIDDEN_WORDS
from sparkward.operators import audit, policy
from sparkward.operators.newest import newest, newest_per_key
from sparkward.operators.policy import Policy
from sparkward.plans.derived import (
    OBJECTS,
    QUERY_LOG,
    RUN_PAYLOADS,
    objects,
    query_log,
    run_payloads,
    select_sql,
)
from sparkward.plans.derived import table as derived_table
from sparkward.session import local_frame, shared_dir
from sparkward.sources import trail
from sparkward.streaming import monitor, sides

POLICY = Policy(
    tables=["proj.sales.*"],
    buckets=["blog.*", "*.example.org", "m.free-bets.example.com", "th[a-e]?*.example.net"],
    dags=["dag-[0-2]", "dag-[!0-3]"],
    max_bytes=1_000_000,
)
# The patterns above as regexes, written by hand for the SQL.
_BUCKET_REGEX = (
    r"^(blog\..*|.*\.example\.org|m\.free-bets\.example\.com|th[a-e].+\.example\.net)$"
)
_DAG_REGEX = r"^(dag-[0-2]|dag-[^0-3])$"

# --- text rules -------------------------------------------------------------

_ONE_PASS_SQL = (
    r"""'('')(?:[^''\\]|\\[^\n])*''|(")(?:[^"\\]|\\[^\n])*"|(`[^`]*`)|--[^\n]*|(?s:/\*.*?\*/)'"""
)
_WHITE_SQL = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_WORDS_SQL = ", ".join(f"'{w}'" for w in FORBIDDEN_WORDS)

_LOG_SQL = select_sql(QUERY_LOG, "events")

_CLASSIFIED_SQL = rf"""
log AS ({_LOG_SQL}),
cleaned AS (SELECT *, trim(regexp_replace(sql, {_ONE_PASS_SQL}, '\1\1\2\2\3 ', 'g'),
                           {_WHITE_SQL}) AS cleaned FROM log),
worded AS (SELECT *, regexp_extract_all(upper(cleaned), '[A-Z_][A-Z0-9_]*') AS words FROM cleaned),
banned AS (SELECT *, list_sort(list_distinct(list_filter(words, lambda w: w IN ({_WORDS_SQL}))))
                     AS forbidden FROM worded),
refused AS (SELECT *, CASE
    WHEN cleaned = '' THEN 'Empty query'
    WHEN len(words) = 0 THEN 'No SQL tokens found'
    WHEN words[1] NOT IN ('SELECT', 'WITH')
      THEN concat('Statement must start with SELECT or WITH, found ''', words[1], '''')
    WHEN len(forbidden) > 0
      THEN concat('Forbidden keyword(s) present: [''', array_to_string(forbidden, ''', '''), ''']')
    WHEN contains(rtrim(cleaned, ';'), ';') THEN 'Multiple statements are not permitted'
    END AS refusal FROM banned)"""

_REFS_SQL = (
    r"regexp_extract_all(sql, '(?i)(?:FROM|JOIN)\s+`?([A-Za-z0-9_.-]+)`?', 1)"
)
_REFERENCED_SQL = rf"""
found AS (SELECT *, {_REFS_SQL} AS found FROM refused),
named AS (SELECT *, list_filter(found, lambda n, i: list_position(found, n) = i)
                    AS candidate_tables FROM found),
judged AS (SELECT *,
    list_filter(candidate_tables, lambda n: NOT regexp_matches(n, '^proj\.sales\.'))
      AS off_list,
    list_filter(coalesce(referenced_tables, []),
                lambda n: NOT regexp_matches(n, '^proj\.sales\.')) AS refs_off_list
    FROM named),
preflighted AS (SELECT *, CASE
    WHEN refusal IS NOT NULL THEN refusal
    WHEN len(off_list) > 0 THEN concat('Table(s) [''', array_to_string(off_list, ''', '''),
      '''] are not in the allow-list (preflight check)') END AS preflight_reason FROM judged),
authorized AS (SELECT *, CASE
    WHEN refusal IS NOT NULL THEN refusal
    WHEN len(coalesce(referenced_tables, [])) = 0
      THEN 'Query does not reference any resolvable table'
    WHEN len(refs_off_list) > 0
      THEN concat('Table ''', refs_off_list[1], ''' is not in the allow-list')
    WHEN estimated_bytes > 1000000
      THEN concat('Estimated ', estimated_bytes::VARCHAR, ' bytes exceeds ceiling of 1000000')
    END AS authorize_refusal FROM preflighted),
decided AS (SELECT *,
    CASE WHEN preflight_reason IS NOT NULL THEN 'preflight' ELSE 'authorize' END AS phase,
    coalesce(preflight_reason, authorize_refusal) IS NULL AS allowed,
    CASE WHEN coalesce(preflight_reason, authorize_refusal) IS NULL THEN 'allowed'
         ELSE 'denied' END AS decision,
    coalesce(preflight_reason, authorize_refusal, 'Query passed all guardrails') AS reason
    FROM authorized)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


_TEXT_CTES = _CLASSIFIED_SQL
_DECIDED_CTES = f"{_CLASSIFIED_SQL},{_REFERENCED_SQL}"


def _joined(column: str):
    return F.array_join(F.col(column), ",").alias(column)


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.classify_sql(query_log(spark, sf_dir)).select("request_id", "cleaned")


def _read_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.classify_sql(query_log(spark, sf_dir)).select(
        "request_id", _joined("words"), _joined("forbidden"), "read_only", "sql_reason"
    )


_READ_ONLY_SQL = _with(
    _TEXT_CTES,
    "SELECT request_id, array_to_string(words, ',') AS words, "
    "array_to_string(forbidden, ',') AS forbidden, refusal IS NULL AS read_only, "
    "coalesce(refusal, 'Statement is read-only') AS sql_reason FROM refused",
)


def _compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.classify_sql(query_log(spark, sf_dir), mode="compat").select(
        "request_id", "cleaned"
    )


_COMPAT_SQL = rf"""
SELECT request_id, trim(
  regexp_replace(regexp_replace(regexp_replace(sql, '(?s:/\*.*?\*/)', ' ', 'g'),
                                '--[^\n]*', ' ', 'g'),
                 '''(?:[^''\\]|\\[^\n])*''|"(?:[^"\\]|\\[^\n])*"', '''''', 'g'),
  {_WHITE_SQL}) AS cleaned
FROM ({_LOG_SQL}) AS log"""


def _table_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = policy.preflight(query_log(spark, sf_dir), POLICY)
    return log.select("request_id", _joined("candidate_tables"))


_TABLE_REFS_SQL = _with(
    _DECIDED_CTES,
    "SELECT request_id, array_to_string(candidate_tables, ',') AS candidate_tables FROM named",
)

_ALLOW_LIST = ["proj.sales.orders", "proj.sales.c*", "*.hr.*", "[!a-s]"]
_ALLOW_LIST_REGEX = r"^(proj\.sales\.orders|proj\.sales\.c.*|.*\.hr\..*|[^a-s])$"


def _allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = local_frame(
        spark, policy.PATTERN_SCHEMA, [(pattern,) for pattern in _ALLOW_LIST]
    )
    names = policy.reference_counts(query_log(spark, sf_dir))
    return policy.allow_list_report(names, patterns)


_ALLOW_LIST_SQL = _with(
    _DECIDED_CTES,
    "SELECT table_name, count(*)::BIGINT AS mentions, "
    f"regexp_matches(table_name, '{_ALLOW_LIST_REGEX}') AS allowed "
    "FROM (SELECT unnest(candidate_tables) AS table_name FROM named) AS u GROUP BY table_name",
)


def _wild_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per customer, two thirds of them with wildcards, against one name per order."""
    patterns = derived_table(spark, sf_dir, "customer").selectExpr(
        "CASE c_custkey % 3 WHEN 0 THEN concat('shop.c', c_custkey, '.o[0-3]') "
        "WHEN 1 THEN concat('*.c', c_custkey, '.o5') "
        "ELSE concat('shop.c', c_custkey, '.o6') END AS pattern"
    )
    names = derived_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "concat('shop.c', o_custkey, '.o', o_orderkey % 7) AS table_name"
    )
    return policy.allow_list_report(names, patterns)


_WILD_ALLOW_LIST_SQL = """
SELECT o_orderkey, concat('shop.c', o_custkey, '.o', o_orderkey % 7) AS table_name,
  c_custkey IS NOT NULL AND CASE o_custkey % 3 WHEN 0 THEN o_orderkey % 7 <= 3
    WHEN 1 THEN o_orderkey % 7 = 5 ELSE o_orderkey % 7 = 6 END AS allowed
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""


def _inner_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per customer with its literal text in the middle, against one name per order."""
    patterns = derived_table(spark, sf_dir, "customer").selectExpr(
        "CASE c_custkey % 3 WHEN 0 THEN concat('*.c', c_custkey, '.*') "
        "WHEN 1 THEN concat('[a-z]*.c', c_custkey, '.o?.[!t]*') ELSE '???' END AS pattern"
    )
    names = derived_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "concat(CASE o_orderkey % 2 WHEN 0 THEN 'shop' ELSE 'Shop' END, '.c', o_custkey, '.o', "
        "o_orderkey % 12, '.', CASE o_orderkey % 5 WHEN 0 THEN 't' ELSE 'u' END) AS table_name"
    )
    return policy.allow_list_report(names, patterns)


_INNER_ALLOW_LIST_SQL = """
SELECT o_orderkey, concat(CASE o_orderkey % 2 WHEN 0 THEN 'shop' ELSE 'Shop' END, '.c', o_custkey, '.o',
    o_orderkey % 12, '.', CASE o_orderkey % 5 WHEN 0 THEN 't' ELSE 'u' END) AS table_name,
  c_custkey IS NOT NULL AND CASE o_custkey % 3 WHEN 0 THEN true
    WHEN 1 THEN o_orderkey % 2 = 0 AND o_orderkey % 12 < 10 AND o_orderkey % 5 <> 0 ELSE false END AS allowed
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""


# Real texts inside literals, comments and behind them, by the remainder of a number. What
# is left of a statement then depends on its form alone, which the SQL states.
_SINGLE = "replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(39), concat(chr(92), chr(39)))"
_DOUBLE = "replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34)))"
_TEXT_FORMS = [
    f"concat('SELECT ', chr(39), {_SINGLE}, chr(39), ' AS t FROM proj.sales.a')",
    "concat('/* ', replace(text, '*', ''), ' */ SELECT 1 FROM proj.sales.a')",
    "concat('-- ', replace(text, chr(10), ' '), chr(10), 'SELECT 1 FROM proj.sales.a')",
    f"concat('SELECT ', chr(34), {_DOUBLE}, chr(34), '; DROP TABLE x')",
    f"concat('SELECT 1; SELECT ', chr(39), {_SINGLE}, chr(39))",
]
_TEXT_LEFT = [
    ("SELECT ''  AS t FROM proj.sales.a", policy.READ_ONLY),
    ("SELECT 1 FROM proj.sales.a", policy.READ_ONLY),
    ("SELECT 1 FROM proj.sales.a", policy.READ_ONLY),
    ('SELECT "" ; DROP TABLE x', policy.FORBIDDEN % "['DROP']"),
    ("SELECT 1; SELECT ''", policy.SEVERAL),
]


def _real_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = derived_table(spark, sf_dir, "documents").selectExpr(
        "concat('document-', doc_id) AS request_id", "doc_id AS number", "coalesce(text, '') AS text"
    )
    turns = derived_table(spark, sf_dir, "conversations").selectExpr(
        "concat('turn-', conv_id, '-', turn) AS request_id", "conv_id + turn AS number",
        "coalesce(text, '') AS text",
    )
    forms = " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(_TEXT_FORMS))
    log = documents.union(turns).selectExpr(
        "request_id", f"CASE number % {len(_TEXT_FORMS)} {forms} END AS sql"
    )
    return policy.classify_sql(log).select("request_id", "cleaned", "read_only", "sql_reason")


def _real_texts_sql() -> str:
    rows = ", ".join(
        "({}, '{}', '{}')".format(i, left.replace("'", "''"), reason.replace("'", "''"))
        for i, (left, reason) in enumerate(_TEXT_LEFT)
    )
    return f"""
SELECT request_id, cleaned, sql_reason = '{policy.READ_ONLY}' AS read_only, sql_reason FROM (
  SELECT concat('document-', doc_id) AS request_id, doc_id AS number FROM documents
  UNION ALL SELECT concat('turn-', conv_id, '-', turn), conv_id + turn FROM conversations) AS t
JOIN (VALUES {rows}) AS f(form, cleaned, sql_reason) ON number % {len(_TEXT_FORMS)} = form"""


def _preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.preflight(query_log(spark, sf_dir), POLICY).select(
        "request_id", "preflight_reason"
    )


_PREFLIGHT_SQL = _with(_DECIDED_CTES, "SELECT request_id, preflight_reason FROM preflighted")


def _authorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.authorize(query_log(spark, sf_dir), POLICY).select(
        "request_id", "allowed", "decision", "reason"
    )


_AUTHORIZE_SQL = _with(
    _DECIDED_CTES,
    "SELECT request_id, authorize_refusal IS NULL AS allowed, "
    "CASE WHEN authorize_refusal IS NULL THEN 'allowed' ELSE 'denied' END AS decision, "
    "coalesce(authorize_refusal, 'Query passed all guardrails') AS reason FROM authorized",
)


def _decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.decide(query_log(spark, sf_dir), POLICY)


def _decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decide(spark, sf_dir).select(
        "request_id", "actor", "phase", "allowed", "decision", "reason"
    )


_DECISION_SQL = _with(
    _DECIDED_CTES, "SELECT request_id, actor, phase, allowed, decision, reason FROM decided"
)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed, denied = policy.split_decisions(_decide(spark, sf_dir))
    return allowed.select("request_id", F.lit("released").alias("outcome")).unionByName(
        denied.select("request_id", F.lit("refused").alias("outcome"))
    )


_SPLIT_SQL = _with(
    _DECIDED_CTES,
    "SELECT request_id, CASE WHEN allowed THEN 'released' ELSE 'refused' END AS outcome "
    "FROM decided",
)


def _bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.decide_buckets(objects(spark, sf_dir), POLICY).select(
        "page_id", "bucket", "allowed", "reason"
    )


_BUCKET_SQL = f"""
SELECT page_id, bucket, regexp_matches(bucket, '{_BUCKET_REGEX}') AS allowed,
  CASE WHEN regexp_matches(bucket, '{_BUCKET_REGEX}') THEN 'Bucket is allow-listed'
       ELSE concat('Bucket ''', bucket, ''' is not in the allow-list') END AS reason
FROM ({select_sql(OBJECTS, "pages")}) AS o"""


def _dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.decide_dags(run_payloads(spark, sf_dir), POLICY).select(
        "dag_id", "run_id", "allowed", "reason"
    )


_DAG_SQL = f"""
SELECT dag_id, run_id, regexp_matches(dag_id, '{_DAG_REGEX}') AS allowed,
  CASE WHEN regexp_matches(dag_id, '{_DAG_REGEX}') THEN 'DAG is allow-listed'
       ELSE concat('DAG ''', dag_id, ''' is not in the allow-list') END AS reason
FROM ({select_sql(RUN_PAYLOADS, "orders")}) AS r"""

# --- audit ------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.query_events(_decide(spark, sf_dir))


_EVENTS_SELECT = """
SELECT sha256(concat_ws('|', request_id::VARCHAR, phase)) AS event_id, ts AS "timestamp",
  'sql_query' AS tool_name, actor,
  CASE WHEN phase = 'authorize'
         THEN to_json({'sql': sql, 'referenced_tables': coalesce(referenced_tables, []),
                       'estimated_bytes': estimated_bytes})::VARCHAR
       WHEN refusal IS NULL
         THEN to_json({'sql': sql, 'candidate_tables': candidate_tables})::VARCHAR
       ELSE to_json({'sql': sql})::VARCHAR END AS parameters,
  decision, reason, NULL::VARCHAR AS backend_job_id
FROM decided"""
_EVENTS_SQL = _with(_DECIDED_CTES, _EVENTS_SELECT)
_EVENTS_CTES = f"{_DECIDED_CTES}, events_out AS ({_EVENTS_SELECT})"


def _access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = objects(spark, sf_dir).selectExpr(
        "page_id AS request_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts",
        "concat('agent-', CAST(page_id % 7 AS STRING)) AS actor", "bucket",
    )
    decisions = policy.decide_buckets(requests, POLICY)
    return audit.access_events(decisions, "object_access", "bucket")


_ACCESS_EVENTS_SQL = f"""
SELECT sha256(concat_ws('|', page_id::VARCHAR, 'object_access')) AS event_id,
  TIMESTAMP '2024-01-01 00:00:00' AS "timestamp", 'object_access' AS tool_name,
  concat('agent-', CAST(page_id % 7 AS VARCHAR)) AS actor,
  to_json({{'bucket': bucket}})::VARCHAR AS parameters,
  CASE WHEN allowed THEN 'allowed' ELSE 'denied' END AS decision, reason,
  NULL::VARCHAR AS backend_job_id
FROM ({_BUCKET_SQL}) AS b"""


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.log_lines(_events(spark, sf_dir))


_LOG_LINES_SQL = _with(
    _EVENTS_CTES,
    "SELECT to_json({'event_id': event_id, "
    "'timestamp': strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.%f'), 'tool_name': tool_name, "
    "'actor': actor, 'parameters': parameters, 'decision': decision, 'reason': reason"
    "})::VARCHAR AS value FROM events_out",
)


def _written_trail(spark: SparkSession, sf_dir: str) -> str:
    """Write the events as a JSON trail in the shared folder; its path."""
    path = shared_dir(spark, "trail")
    events = _events(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    trail.append_events(events, path, "log")
    return path


_TRAIL_COLUMNS = ["event_id", "actor", "decision", "reason", "parameters"]


def _plain_time(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), *_TRAIL_COLUMNS
    )


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_time(trail.read_recent(spark, _written_trail(spark, sf_dir), 100))


def _newest_sql(limit: int) -> str:
    return _with(
        _EVENTS_CTES,
        f'SELECT "timestamp", {", ".join(_TRAIL_COLUMNS)} FROM events_out '
        f'ORDER BY "timestamp" DESC, event_id DESC LIMIT {limit}',
    )


def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail.retain_newest(_events(spark, sf_dir), 1000).select("timestamp", *_TRAIL_COLUMNS)


def _retention_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail.retain_newest_per_actor(_events(spark, sf_dir), 200).select(
        "timestamp", *_TRAIL_COLUMNS
    )


_RETENTION_ACTOR_SQL = _with(
    _EVENTS_CTES,
    f'SELECT "timestamp", {", ".join(_TRAIL_COLUMNS)} FROM events_out QUALIFY '
    'row_number() OVER (PARTITION BY actor ORDER BY "timestamp" DESC, event_id DESC) <= 200',
)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.decision_counts(_events(spark, sf_dir))


_COUNTS_SQL = _with(
    _EVENTS_CTES,
    "SELECT decision, tool_name, actor, count(*)::BIGINT AS decisions "
    "FROM events_out GROUP BY decision, tool_name, actor",
)


def _fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trail that cannot be written: every decision comes out as a denial."""

    def unavailable(events: DataFrame) -> None:
        raise OSError("trail is unavailable")

    decisions = _decide(spark, sf_dir)
    released = audit.record_then_release(decisions, audit.query_events(decisions), unavailable)
    return released.select("request_id", "allowed", "decision", "reason")


_FAIL_CLOSED_SQL = (
    "SELECT event_id AS request_id, false AS allowed, 'denied' AS decision, "
    "'Denied: audit sink unavailable (fail-closed policy)' AS reason FROM events"
)


def _recent_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "audit-table")
    trail.append_table(_events(spark, sf_dir), path, "log")
    return _plain_time(trail.read_recent_from_table(spark, path, 500))


def _audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice under one name, as after a restart, and read back."""
    path = shared_dir(spark, "audit-table")
    events = _events(spark, sf_dir)
    for _ in range(2):
        trail.append_table(events, path, "log")
    return (
        trail.read_table(spark, path)
        .groupBy(F.col("event_date").cast("string").alias("event_date"), "decision")
        .agg(F.count(F.lit(1)).alias("events"))
    )


_AUDIT_TABLE_SQL = _with(
    _EVENTS_CTES,
    'SELECT "timestamp"::DATE::VARCHAR AS event_date, decision, count(*)::BIGINT AS events '
    "FROM events_out GROUP BY ALL",
)


def _stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trail as a stream: closed ten-minute windows, read back as a table."""
    path, out = _written_trail(spark, sf_dir), shared_dir(spark, "windows")
    events = monitor.read_events_stream(spark, path)
    query = monitor.run_to_files(
        monitor.decision_windows(events), out, shared_dir(spark, "windows-state")
    )
    query.awaitTermination()
    return spark.read.schema(
        "window_start TIMESTAMP, window_end TIMESTAMP, tool_name STRING, decision STRING, "
        "events LONG"
    ).parquet(out).withColumns(
        {name: F.col(name).cast("timestamp_ntz") for name in ("window_start", "window_end")}
    )


_STREAM_WINDOWS_SQL = _with(
    _EVENTS_CTES
    + """,
windowed AS (SELECT time_bucket(INTERVAL 10 MINUTE, "timestamp") AS window_start, tool_name,
                    decision FROM events_out),
seen AS (SELECT date_trunc('millisecond', max("timestamp")) - INTERVAL 1 MINUTE AS watermark
         FROM events_out)""",
    "SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, tool_name, decision, "
    "count(*)::BIGINT AS events FROM windowed "
    "WHERE window_start + INTERVAL 10 MINUTE <= (SELECT watermark FROM seen) "
    "GROUP BY window_start, tool_name, decision",
)


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch written twice, its name tried for other events, then those under their own."""
    decisions, halves = _decide(spark, sf_dir), []
    for half in (0, 1):
        path = shared_dir(spark, "replayed")
        events = audit.query_events(decisions.where(F.col("request_id") % 2 == half))
        events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).write.parquet(path)
        halves.append(spark.read.schema(audit.AUDIT_SCHEMA).parquet(path))
    parts = []
    for sink, append, read in (
        ("json", trail.append_events, trail.read_events),
        ("table", trail.append_table, trail.read_table),
    ):
        path = shared_dir(spark, f"replay-{sink}")
        append(halves[0], path, "first")
        append(halves[0], path, "first")
        refused = False
        try:
            append(halves[1], path, "first")
        except ValueError:
            refused = True
        append(halves[1], path, "second")
        counted = read(spark, path).groupBy("decision").agg(
            F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids")
        )
        parts.append(counted.select(F.lit(sink).alias("sink"), "*", F.lit(refused).alias("refused")))
    return parts[0].unionByName(parts[1])


_REPLAY_SQL = _with(
    _EVENTS_CTES,
    "SELECT sink, decision, count(*)::BIGINT AS events, count(*)::BIGINT AS ids, true AS refused "
    "FROM events_out, (VALUES ('json'), ('table')) AS s(sink) GROUP BY sink, decision",
)


def _halves(spark: SparkSession, sf_dir: str, name: str, append) -> str:
    """The events appended in two batches, the first of them twice; the trail's path."""
    path, stored = shared_dir(spark, name), shared_dir(spark, f"{name}-events")
    events = _events(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    events.write.parquet(stored)
    events = spark.read.schema(audit.AUDIT_SCHEMA).parquet(stored)
    first, second = F.col("event_id") < "8", F.col("event_id") >= "8"
    for batch, part in (("first", first), ("second", second), ("first", first)):
        append(events.where(part), path, batch)
    return path


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the commit records of both kinds of trail say of each batch."""
    parts = []
    for sink, append in (("json", trail.append_events), ("table", trail.append_table)):
        records = trail.commits(spark, _halves(spark, sf_dir, f"commits-{sink}", append))
        parts.append(records.withColumn("sink", F.lit(sink)))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("sink", "batch").agg(
        F.max("attempt").alias("attempt"),
        F.sum("events").alias("events"),
        F.timestamp_micros(F.min("low")).cast("timestamp_ntz").alias("first"),
        F.timestamp_micros(F.max("high")).cast("timestamp_ntz").alias("last"),
    )


_COMMITS_SQL = _with(
    _EVENTS_CTES,
    "SELECT sink, CASE WHEN event_id < '8' THEN 'first' ELSE 'second' END AS batch, 0::BIGINT AS attempt, "
    'count(*)::BIGINT AS events, min("timestamp") AS first, max("timestamp") AS last '
    "FROM events_out, (VALUES ('json'), ('table')) AS s(sink) GROUP BY ALL",
)


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of a JSON trail, from the files that can hold them."""
    path = _halves(spark, sf_dir, "zones", trail.append_events)
    return _plain_time(trail.read_recent(spark, path, 700))


def _retention_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One actor has half of all events, and a quarter of all fall on the first moment of their day."""
    events = derived_table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 4 == 0, F.date_trunc("day", "ts")).otherwise(F.col("ts")).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("event_id") % 2 == 0, "hot").otherwise(F.concat(F.lit("agent-"), F.col("user_id") % 50)).alias("actor"),
    )
    return newest_per_key(events, ["actor"], 400, ranked_rows=500)


_RETENTION_HOT_SQL = """
WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN date_trunc('day', ts) ELSE ts END::TIMESTAMP AS "timestamp",
                  CASE WHEN event_id % 2 = 0 THEN 'hot' ELSE concat('agent-', user_id % 50) END AS actor FROM events)
SELECT event_id, "timestamp", actor FROM e
QUALIFY row_number() OVER (PARTITION BY actor ORDER BY "timestamp" DESC, event_id DESC) <= 400"""


def _newest_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many events of one time, told apart by whole numbers."""
    days = derived_table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    days = days.select("event_id", F.col("day").cast("timestamp_ntz").alias("day"), "event_type")
    return newest(days, 1500, time="day", key="event_id", ranked_rows=100)


_NEWEST_NUMERIC_SQL = (
    "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day, event_type FROM events "
    "ORDER BY day DESC, event_id DESC LIMIT 1500"
)


def _stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the events arrives after their windows were closed: counted, not lost."""
    decisions = _decide(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    last = decisions.agg(F.max("ts")).first()[0]
    late = (F.col("request_id") % 5 == 0) & (F.col("ts") < F.lit(last) - F.expr("INTERVAL 1 DAY"))
    path, out = shared_dir(spark, "late-trail"), shared_dir(spark, "late-windows")
    state = shared_dir(spark, "late-state")
    for batch, arriving in (("in-time", ~late), ("late", late)):
        trail.append_events(audit.query_events(decisions.where(arriving)), path, batch)
        windows = monitor.decision_windows(monitor.read_events_stream(spark, path))
        monitor.run_to_files(windows, out, state).awaitTermination()
    closed = spark.read.schema(windows.schema).parquet(out)
    compared = monitor.late_events(trail.read_events(spark, path), closed)
    return compared.withColumns(
        {name: F.col(name).cast("timestamp_ntz") for name in ("window_start", "window_end")}
    )


_STREAM_LATE_SQL = _with(
    _DECIDED_CTES
    + """,
seen AS (SELECT max(ts) AS last, date_trunc('millisecond', max(ts)) - INTERVAL 1 MINUTE AS watermark
         FROM decided),
counted AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start,
                   time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS window_end,
                   decision, count(*) AS recorded,
                   count(*) FILTER (WHERE NOT (request_id % 5 = 0 AND ts < last - INTERVAL 1 DAY)) AS in_time
            FROM decided, seen GROUP BY ALL),
closed AS (SELECT max(window_end) AS last_end FROM counted, seen
           WHERE window_end <= watermark AND in_time > 0)""",
    "SELECT window_start, window_end, 'sql_query' AS tool_name, decision, recorded::BIGINT AS recorded, "
    "CASE WHEN window_end <= last_end THEN in_time ELSE 0 END::BIGINT AS counted, "
    "window_end > last_end AS open, "
    "CASE WHEN window_end <= last_end THEN recorded - in_time END::BIGINT AS late FROM counted, closed",
)



def _stream_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the events comes late, with some of the others once more: late ones come out as rows."""
    decisions = _decide(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    last = decisions.agg(F.max("ts")).first()[0]
    recent = F.col("ts") >= F.lit(last) - F.expr("INTERVAL 1 DAY")
    late = (F.col("request_id") % 5 == 0) & ~recent
    path, out = shared_dir(spark, "side-trail"), shared_dir(spark, "side-windows")
    state = shared_dir(spark, "side-state")
    for batch, arriving in (("in-time", ~late), ("late", late | recent)):
        trail.append_events(audit.query_events(decisions.where(arriving)), path, batch)
        given = sides.windows_with_late(
            monitor.read_events_stream(spark, path), window="6 hours", remember="2 days", slices=2
        )
        sides.late_to_files(given, out, state).awaitTermination()
    totals = sides.window_totals(spark.read.schema(given.schema).parquet(out))
    return totals.withColumns(
        {name: F.col(name).cast("timestamp_ntz") for name in ("window_start", "window_end")}
    )


_STREAM_SIDE_SQL = _with(
    _DECIDED_CTES
    + """,
seen AS (SELECT max(ts) AS last, date_trunc('millisecond', max(ts)) - INTERVAL 1 MINUTE AS watermark
         FROM decided),
arrived AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS window_start, decision, watermark,
                   request_id % 5 = 0 AND ts < last - INTERVAL 1 DAY AS late FROM decided, seen)""",
    "SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, 'sql_query' AS tool_name, decision, "
    "count(*) FILTER (WHERE NOT late)::BIGINT AS events, count(*) FILTER (WHERE late)::BIGINT AS late "
    "FROM arrived WHERE window_start + INTERVAL 6 HOUR <= watermark GROUP BY ALL",
)

QUERIES = {
    "policy_clean_sql": (_clean, _with(_TEXT_CTES, "SELECT request_id, cleaned FROM cleaned")),
    "policy_clean_sql_compat": (_compat, _COMPAT_SQL),
    "policy_read_only": (_read_only, _READ_ONLY_SQL),
    "policy_table_refs": (_table_refs, _TABLE_REFS_SQL),
    "policy_allow_list": (_allow_list, _ALLOW_LIST_SQL),
    "policy_allow_list_wild": (_wild_allow_list, _WILD_ALLOW_LIST_SQL),
    "policy_allow_list_inner": (_inner_allow_list, _INNER_ALLOW_LIST_SQL),
    "policy_real_texts": (_real_texts, _real_texts_sql()),
    "policy_preflight": (_preflight, _PREFLIGHT_SQL),
    "policy_authorize": (_authorize, _AUTHORIZE_SQL),
    "policy_decision": (_decision, _DECISION_SQL),
    "policy_split": (_split, _SPLIT_SQL),
    "policy_bucket": (_bucket, _BUCKET_SQL),
    "policy_dag": (_dag, _DAG_SQL),
    "audit_events": (_events, _EVENTS_SQL),
    "audit_access_events": (_access_events, _ACCESS_EVENTS_SQL),
    "audit_log_lines": (_log_lines, _LOG_LINES_SQL),
    "audit_recent": (_recent, _newest_sql(100)),
    "audit_retention": (_retention, _newest_sql(1000)),
    "audit_retention_per_actor": (_retention_actor, _RETENTION_ACTOR_SQL),
    "audit_decision_counts": (_counts, _COUNTS_SQL),
    "audit_fail_closed": (_fail_closed, _FAIL_CLOSED_SQL),
    "audit_table": (_audit_table, _AUDIT_TABLE_SQL),
    "audit_replay": (_replay, _REPLAY_SQL),
    "audit_commits": (_commits, _COMMITS_SQL),
    "audit_zones": (_zones, _newest_sql(700)),
    "audit_retention_hot": (_retention_hot, _RETENTION_HOT_SQL),
    "audit_newest_numeric": (_newest_numeric, _NEWEST_NUMERIC_SQL),
    "audit_stream_late": (_stream_late, _STREAM_LATE_SQL),
    "audit_stream_side": (_stream_side, _STREAM_SIDE_SQL),
    "audit_table_recent": (_recent_table, _newest_sql(500)),
    "audit_stream_windows": (_stream_windows, _STREAM_WINDOWS_SQL),
}
