"""Registered queries: SQL text run under the policy, objects, and pipeline runs.

The statements are plain SQL. Where one is run by Spark its tables carry their
three-part names, in the comparison their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.operators.access import GuardedInventories
from sparkward.operators.governed import GovernedSession
from sparkward.operators.policy import Policy, PolicyDenied
from sparkward.plans import derived, footprint
from sparkward.session import shared_dir
from sparkward.sources import objects as object_source
from sparkward.sources import runs, trail
from sparkward.sources.specs import parse_checks

_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "labels", "embeddings",
]
POLICY = Policy(tables=["shop.gold.*"], max_bytes=10**15, max_rows=None)


def _name(table: str) -> str:
    return f"shop.gold.{table}"


def _used(*statements: str) -> list[str]:
    return [table for table in _TABLES if any(f"{{{table}}}" in text for text in statements)]


def governed_session(spark: SparkSession, sf_dir: str, tables: list[str]) -> GovernedSession:
    """Tables under their three-part names; decisions go to a JSON trail."""
    path = shared_dir(spark, "governed-trail")
    return GovernedSession(
        spark,
        {_name(table): f"{sf_dir}/{table}.parquet" for table in tables},
        POLICY,
        lambda events: trail.append_events(events, path, uuid.uuid4().hex),
    )


def _spark_text(statement: str) -> str:
    return statement.format(**{table: f"`{_name(table)}`" for table in _TABLES})


def _plain_text(statement: str) -> str:
    return statement.format(**{table: table for table in _TABLES})


def _governed(statement: str, row_limit: int | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = governed_session(spark, sf_dir, _used(statement))
        return session.query(_spark_text(statement), actor="agent-1", row_limit=row_limit)

    limit = "" if row_limit is None else f" LIMIT {row_limit}"
    return run, f"SELECT * FROM ({_plain_text(statement)}) AS q{limit}"


def _truncated(statement: str, row_limit: int):
    """How much of a result a cap lets through, and that it says so."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = governed_session(spark, sf_dir, _used(statement))
        result = session.run(_spark_text(statement), actor="agent-1", row_limit=row_limit)
        return result.rows.agg(F.count(F.lit(1)).alias("returned_rows")).select(
            "returned_rows",
            F.lit(result.total_rows).cast("bigint").alias("total_rows"),
            F.lit(result.truncated).alias("truncated"),
        )

    sql = (
        f"SELECT least({row_limit}, count(*)) AS returned_rows, count(*) AS total_rows, "
        f"count(*) > {row_limit} AS truncated FROM ({_plain_text(statement)}) AS q"
    )
    return run, sql


_LARGE_LINES = (
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM {lineitem} "
    "WHERE l_extendedprice * (1 - l_discount) > 90000 AND l_returnflag <> 'N' "
    "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey"
)

_JOIN = """
SELECT r_name, n_name, count(*) AS line_count, CAST(sum(l_quantity) AS BIGINT) AS quantity,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'
GROUP BY r_name, n_name ORDER BY r_name, n_name"""

_OUTER_JOIN = """
SELECT d.lang, l.quality, count(*) AS documents, count(l.doc_id) AS labelled
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
GROUP BY d.lang, l.quality"""

_SEMI_JOIN = """
SELECT c_mktsegment, count(*) AS customers FROM {customer} c
WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey
              AND o.o_totalprice > 450000)
GROUP BY c_mktsegment"""

_ANTI_JOIN = """
SELECT p_brand, count(*) AS parts FROM {part} p
WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey
                  AND l.l_discount > 0.09)
GROUP BY p_brand"""

_ROLLUP = """
SELECT l_returnflag, l_linestatus,
       CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT) AS level,
       count(*) AS line_count, count(DISTINCT l_suppkey) AS suppliers,
       round(avg(l_discount), 6) AS discount, max(l_shipdate) AS last_shipped
FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)"""

_FULL_JOIN = """
SELECT coalesce(s.region, c.region) AS region, suppliers, customers, balance
FROM (SELECT n_regionkey AS region, count(*) AS suppliers
      FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
      WHERE s_acctbal > 5000 GROUP BY n_regionkey) AS s
FULL OUTER JOIN (SELECT n_regionkey AS region, count(*) AS customers,
                        round(sum(c_acctbal), 2) AS balance
                 FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
                 WHERE c_mktsegment = 'BUILDING' GROUP BY n_regionkey) AS c
ON s.region = c.region"""

_GROUPING_SETS = """
SELECT p_brand, p_size, count(*) AS parts, round(avg(p_retailprice), 6) AS price,
       CAST(grouping(p_brand) * 2 + grouping(p_size) AS BIGINT) AS level
FROM {part} GROUP BY GROUPING SETS ((p_brand), (p_size), ())"""

_SETOP_ALL = """
SELECT o_orderstatus AS code, count(*) AS n FROM (
  SELECT o_orderstatus FROM {orders}
  UNION ALL SELECT l_linestatus FROM {lineitem}
  EXCEPT ALL SELECT l_returnflag FROM {lineitem}) AS codes
GROUP BY o_orderstatus"""

# A CTE's name would count as a table that is not on the list.
_SUBQUERY = """
SELECT c_mktsegment, count(*) AS customers, round(max(total), 2) AS largest
FROM {customer} JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders}
                      GROUP BY o_custkey) AS spending ON c_custkey = o_custkey
WHERE total > (SELECT 20 * avg(o_totalprice) FROM {orders} WHERE o_orderstatus = 'F')
GROUP BY c_mktsegment"""

_CUBE = """
SELECT o_orderstatus, o_orderpriority, count(*) AS order_count,
       round(sum(o_totalprice), 2) AS total
FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)"""

_WINDOW = """
SELECT o_custkey, o_orderkey, CAST(price_rank AS BIGINT) AS price_rank, round(running, 2) AS running,
       round(before, 2) AS before
FROM (SELECT o_custkey, o_orderkey,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)
               AS price_rank,
             sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
             lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
               AS before
      FROM {orders}) AS ranked
WHERE price_rank <= 3 ORDER BY o_custkey, price_rank"""

_SETOP = """
SELECT o_custkey AS id FROM {orders} WHERE o_orderstatus = 'F'
INTERSECT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0
EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 480000
UNION SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1
ORDER BY id"""

_FUNCTIONS = """
SELECT event_type, upper(substr(event_type, 1, 3)) AS code, count(*) AS event_count,
       CAST(max(length(props)) AS BIGINT) AS longest, round(sum(sqrt(abs(value))), 4) AS roots,
       CAST(sum(floor(value)) AS BIGINT) AS floors,
       count(DISTINCT CASE WHEN value > 10 THEN user_id END) AS users,
       min(coalesce(nullif(event_type, 'view'), 'seen')) AS label
FROM {events} GROUP BY event_type"""

_ARRAYS = """
SELECT label, count(*) AS vectors, CAST(min(cardinality(embedding)) AS BIGINT) AS dimensions,
       round(sum(CAST(embedding[{first}] AS DOUBLE)), 4) AS first_sum
FROM {embeddings} GROUP BY label"""


def _arrays():
    """Array subscripts start at 0 in one engine and at 1 in the other."""

    def text(statement: str, first: int, quoted: bool) -> str:
        filled = statement.replace("{first}", str(first))
        if not quoted:
            filled = filled.replace("cardinality(", "len(")
        return _spark_text(filled) if quoted else _plain_text(filled)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = governed_session(spark, sf_dir, _used(_ARRAYS))
        return session.query(text(_ARRAYS, 0, True), actor="agent-1")

    return run, text(_ARRAYS, 1, False)


_CHECKED, _REFUSED = _name("lineitem"), "shop.raw.orders"


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites under the policy: one table is checked, one refused by its name, one suite by its bytes."""
    path = shared_dir(spark, "governed-trail")
    session = GovernedSession(
        spark,
        {_CHECKED: f"{sf_dir}/lineitem.parquet", _REFUSED: f"{sf_dir}/orders.parquet"},
        POLICY,
        lambda events: trail.append_events(events, path, uuid.uuid4().hex),
    )
    specs = parse_checks(
        {
            _CHECKED: [
                {"type": "row_count", "min_rows": 1},
                {"type": "null_rate", "column": "l_tax", "max_null_rate": 0.5},
                {"type": "uniqueness", "column": "l_orderkey"},
            ],
            _REFUSED: [{"type": "row_count", "min_rows": 1}],
        }
    )
    results, denied = session.run_checks(specs, actor="agent-1")
    # Room for two scans of the table, and a suite that needs three.
    room = 2 * session.estimate(f"SELECT * FROM `{_CHECKED}`", actor="agent-1").estimated_bytes
    narrow = GovernedSession(
        spark,
        {_CHECKED: f"{sf_dir}/lineitem.parquet"},
        Policy(tables=["shop.gold.*"], max_bytes=room),
        lambda events: trail.append_events(events, path, uuid.uuid4().hex),
    )
    columns = ["l_orderkey", "l_partkey", "l_suppkey"]
    three = [{"type": "uniqueness", "column": column} for column in columns]
    _, too_large = narrow.run_checks(parse_checks({_CHECKED: three}), actor="agent-2")
    denied |= {table: reason.split(" bytes")[1] for table, reason in too_large.items()}
    denied = {k: v.replace(str(room), "the ceiling") for k, v in denied.items()}
    checked = results.select("table", "check_type", "passed", F.col("metric_value").cast("double").alias("metric_value"))
    refused = [
        spark.range(1).select(F.lit(table).alias("table"), F.lit(reason).alias("reason"))
        for table, reason in denied.items()
    ]
    return reduce(
        lambda all_, one: all_.unionByName(one, allowMissingColumns=True),
        refused,
        checked.withColumn("reason", F.lit(None).cast("string")),
    )


_CHECKS_SQL = f"""
SELECT '{_CHECKED}' AS "table", check_type, passed, metric_value, CAST(NULL AS VARCHAR) AS reason FROM (
 SELECT 'row_count' AS check_type, count(*) >= 1 AS passed, count(*)::DOUBLE AS metric_value FROM lineitem
 UNION ALL SELECT 'null_rate', avg((l_tax IS NULL)::INT) <= 0.5, avg((l_tax IS NULL)::INT)::DOUBLE FROM lineitem
 UNION ALL SELECT 'uniqueness', count(*) = count(DISTINCT l_orderkey),
  (count(*) - count(DISTINCT l_orderkey))::DOUBLE FROM lineitem) AS checks
UNION ALL SELECT '{_CHECKED}', NULL, NULL, NULL, ' exceeds ceiling of the ceiling'
UNION ALL SELECT '{_REFUSED}', NULL, NULL, NULL,
 'Table(s) [''{_REFUSED}''] are not in the allow-list (preflight check)'"""


def _total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = governed_session(spark, sf_dir, _used(_LARGE_LINES))
    return session.total_rows(_spark_text(_LARGE_LINES), actor="agent-1")


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.query_log(spark, sf_dir)
    scanned = log.select("request_id", (F.col("estimated_bytes") * 1_000_000).alias("bytes"))
    return scanned.withColumn("cost_usd", footprint.cost_usd(F.col("bytes")))


_COSTS_SQL = """
SELECT request_id, bytes, round_even(bytes / 1024.0 ** 4 * 6.25, 6) AS cost_usd
FROM (SELECT event_id AS request_id,
             CAST((event_id * 7919) % 2000 AS BIGINT) * 1000 * 1000000 AS bytes FROM events) AS s"""

# --- objects ----------------------------------------------------------------

_TYPES_SQL = " ".join(
    f"WHEN '{extension}' THEN '{mime}'" for extension, mime in object_source.CONTENT_TYPES.items()
)
# Hosts of one domain share a bucket; a page that was saved twice is one object.
_INVENTORY = [
    "regexp_extract(bucket, '[^.]+[.][^.]+$', 0) AS bucket",
    "concat(bucket, '/', name) AS name",
    "size_bytes",
]
_OBJECTS_SQL = f"""
SELECT bucket, name, max(size_bytes) AS size_bytes,
  CASE lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) {_TYPES_SQL} END AS content_type
FROM (SELECT {", ".join(_INVENTORY)} FROM ({derived.select_sql(derived.OBJECTS, "pages")}) AS p)
  AS o GROUP BY bucket, name"""


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived.objects(spark, sf_dir).selectExpr(*_INVENTORY)
    return (
        pages.groupBy("bucket", "name")
        .agg(F.max("size_bytes").alias("size_bytes"))
        .withColumn("content_type", object_source.content_type(F.col("name")))
    )


def _objects_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_source.list_objects(_inventory(spark, sf_dir), "example.net", "m.")


def _objects_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look up the last object of a bucket."""
    inventory = _inventory(spark, sf_dir)
    name = inventory.where("bucket = 'example.net'").agg(F.max("name")).first()[0]
    return object_source.object_metadata(inventory, "example.net", name)


def _guarded(spark: SparkSession, path: str) -> GuardedInventories:
    return GuardedInventories(
        spark,
        Policy(buckets=["example.*"], dags=["dag-[0-3]"]),
        lambda events: trail.append_events(events, path, uuid.uuid4().hex),
    )


def _outcomes(spark: SparkSession, path: str, asked: str, requests: Mapping) -> DataFrame:
    """Rows of the allowed requests, refusals of the others, and what the trail holds of both."""
    parts = []
    for value, request in requests.items():
        try:
            parts.append(request(value).select(F.lit("row").alias("kind"), F.to_json(F.struct("*")).alias("body")))
        except PolicyDenied as denial:
            refusal = F.lit(denial.reason).alias("body")
            parts.append(spark.range(1).select(F.lit("refused").alias("kind"), refusal))
    events = trail.read_events(spark, path).select(
        F.lit("event").alias("kind"),
        F.concat_ws(" ", "tool_name", "actor", F.get_json_object("parameters", f"$.{asked}"), "decision").alias("body"),
    )
    return reduce(DataFrame.unionByName, [*parts, events])


_LISTED, _UNLISTED = "example.net", "sample.org"


def _guarded_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An allowed and a refused bucket, each recorded before anything is listed."""
    path = shared_dir(spark, "guarded-trail")
    access = _guarded(spark, path)
    inventory = _inventory(spark, sf_dir).select("bucket", "name", "size_bytes")

    def listed(bucket: str) -> DataFrame:
        return access.list_objects(inventory, bucket, "m.", actor="agent-1")

    return _outcomes(spark, path, "bucket", dict.fromkeys([_LISTED, _UNLISTED], listed))


_GUARDED_LISTING_SQL = f"""
SELECT 'row' AS kind, concat('{{"bucket":"', bucket, '","name":"', name, '","size_bytes":', size_bytes, '}}') AS body
FROM (SELECT * FROM ({_OBJECTS_SQL}) AS q WHERE bucket = '{_LISTED}' AND starts_with(name, 'm.')
      ORDER BY name LIMIT 100) AS l
UNION ALL SELECT 'refused', 'Bucket ''{_UNLISTED}'' is not in the allow-list'
UNION ALL SELECT 'event', 'object_list agent-1 {_LISTED} allowed'
UNION ALL SELECT 'event', 'object_list agent-1 {_UNLISTED} denied'"""


# --- runs -------------------------------------------------------------------


def _run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = runs.run_status(derived.run_payloads(spark, sf_dir))
    return status.withColumns(
        {
            "start_date": F.col("start_date").cast("timestamp_ntz"),
            "end_date": F.col("end_date").cast("timestamp_ntz"),
        }
    )


def _run_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth payload is cut off half way: those rows have no state."""
    payloads = derived.run_payloads(spark, sf_dir)
    number = F.regexp_extract("run_id", r"(\d+)$", 1).cast("bigint")
    cut = F.expr("substring(body, 1, length(body) div 2)")
    status = runs.run_status(
        payloads.withColumn("body", F.when(number % 5 == 0, cut).otherwise(F.col("body"))), strict=False
    )
    return status.select("dag_id", "run_id", "state", F.col("start_date").cast("timestamp_ntz").alias("start_date"))


_RUN_STATUS_SQL = f"""
SELECT dag_id, run_id,
  CASE WHEN body ->> '$.state' IN ('queued', 'running', 'success', 'failed')
       THEN body ->> '$.state' ELSE 'unknown' END AS state,
  CAST(replace(body ->> '$.start_date', 'Z', '') AS TIMESTAMP) AS start_date,
  CAST(replace(body ->> '$.end_date', '+00:00', '') AS TIMESTAMP) AS end_date
FROM (SELECT dag_id, run_id, body::JSON AS body
      FROM ({derived.select_sql(derived.RUN_PAYLOADS, "orders")}) AS p) AS j"""


def _run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look up the run of the newest order."""
    orders = derived.table(spark, sf_dir, "orders")
    newest = orders.agg(F.max_by("o_custkey", "o_orderkey"), F.max("o_orderkey")).first()
    return runs.find_run(_run_status(spark, sf_dir), f"dag-{newest[0] % 5}", f"run-{newest[1]}")


def _guarded_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of an allowed and of a refused pipeline, each recorded."""
    path = shared_dir(spark, "guarded-trail")
    access, status = _guarded(spark, path), _run_status(spark, sf_dir)
    number = F.regexp_extract("run_id", r"(\d+)$", 1).cast("bigint")
    newest = dict(status.groupBy("dag_id").agg(F.max_by("run_id", number)).where("dag_id IN ('dag-1', 'dag-4')").collect())

    def found(dag_id: str) -> DataFrame:
        run = access.run_status(status, dag_id, newest.get(dag_id, ""), actor="agent-2")
        return run.select("dag_id", "run_id", "state")

    return _outcomes(spark, path, "dag_id", dict.fromkeys(["dag-1", "dag-4"], found))


_GUARDED_RUN_SQL = f"""
SELECT 'row' AS kind, concat('{{"dag_id":"', dag_id, '","run_id":"', run_id, '","state":"', state, '"}}') AS body
FROM ({_RUN_STATUS_SQL}) AS r WHERE run_id = (
  SELECT concat('run-', max(o_orderkey)) FROM orders WHERE o_custkey % 5 = 1)
UNION ALL SELECT 'refused', 'DAG ''dag-4'' is not in the allow-list'
UNION ALL SELECT 'event', 'run_status agent-2 dag-1 allowed'
UNION ALL SELECT 'event', 'run_status agent-2 dag-4 denied'"""


def _service_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = runs.run_status(derived.run_payloads(spark, sf_dir))
    return runs.service_levels(status, max_minutes=720).withColumn(
        "avg_seconds", F.round("avg_seconds", 6)
    )


_SERVICE_LEVELS_SQL = f"""
SELECT dag_id, count(*)::BIGINT AS runs,
  (count(*) FILTER (WHERE state = 'success'))::BIGINT AS succeeded,
  (count(*) FILTER (WHERE state = 'failed'))::BIGINT AS failed,
  count(seconds)::BIGINT AS finished, round(avg(seconds), 6) AS avg_seconds,
  max(seconds) AS max_seconds,
  (count(*) FILTER (WHERE seconds > 43200))::BIGINT AS over_limit
FROM (SELECT *, epoch(end_date - start_date)::DOUBLE AS seconds FROM ({_RUN_STATUS_SQL}) AS r) AS t
GROUP BY dag_id"""


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs of each pipeline were active, over all spans of time."""
    spans = runs.concurrency(runs.run_status(derived.run_payloads(spark, sf_dir)))
    return spans.withColumns({c: F.unix_seconds(c) for c in ("since", "until")})


_OVERLAP_SQL = f"""
WITH r AS ({_RUN_STATUS_SQL}),
steps AS (SELECT dag_id, start_date AS since, 1 AS step FROM r
  UNION ALL SELECT dag_id, greatest(end_date, start_date), -1 FROM r WHERE end_date IS NOT NULL),
moments AS (SELECT dag_id, since, sum(step) AS step FROM steps GROUP BY ALL HAVING sum(step) <> 0),
spans AS (SELECT dag_id, epoch(since)::BIGINT AS since, epoch(lead(since) OVER w)::BIGINT AS until,
  (sum(step) OVER w)::BIGINT AS running FROM moments WINDOW w AS (PARTITION BY dag_id ORDER BY since))
SELECT * FROM spans WHERE running > 0"""


QUERIES = {
    "governed_query": _governed(_LARGE_LINES, 50),
    "governed_total_rows": (
        _total_rows,
        f"SELECT count(*)::BIGINT AS total_rows FROM ({_plain_text(_LARGE_LINES)}) AS q",
    ),
    "governed_checks": (_checks, _CHECKS_SQL),
    "governed_truncated": _truncated(_LARGE_LINES, 50),
    "governed_join": _governed(_JOIN),
    "governed_outer_join": _governed(_OUTER_JOIN),
    "governed_full_join": _governed(_FULL_JOIN),
    "governed_grouping_sets": _governed(_GROUPING_SETS),
    "governed_setop_all": _governed(_SETOP_ALL),
    "governed_subquery": _governed(_SUBQUERY),
    "governed_semi_join": _governed(_SEMI_JOIN),
    "governed_anti_join": _governed(_ANTI_JOIN),
    "governed_rollup": _governed(_ROLLUP),
    "governed_cube": _governed(_CUBE),
    "governed_window": _governed(_WINDOW),
    "governed_setop": _governed(_SETOP),
    "governed_functions": _governed(_FUNCTIONS),
    "governed_arrays": _arrays(),
    "scan_cost": (_costs, _COSTS_SQL),
    "objects_list": (
        _objects_list,
        f"SELECT * FROM ({_OBJECTS_SQL}) AS q WHERE bucket = 'example.net' "
        "AND starts_with(name, 'm.') ORDER BY name LIMIT 100",
    ),
    "objects_metadata": (
        _objects_metadata,
        f"WITH o AS ({_OBJECTS_SQL}) SELECT * FROM o WHERE bucket = 'example.net' "
        "AND name = (SELECT max(name) FROM o WHERE bucket = 'example.net')",
    ),
    "governed_listing": (_guarded_listing, _GUARDED_LISTING_SQL),
    "governed_run_status": (_guarded_run_status, _GUARDED_RUN_SQL),
    "runs_status": (_run_status, _RUN_STATUS_SQL),
    "runs_broken": (
        _run_broken,
        "SELECT dag_id, run_id, CASE WHEN cut THEN NULL ELSE state END AS state, "
        "CASE WHEN cut THEN NULL ELSE start_date END AS start_date FROM (SELECT *, "
        f"CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS BIGINT) % 5 = 0 AS cut FROM ({_RUN_STATUS_SQL}) AS r) AS s",
    ),
    "runs_lookup": (
        _run_lookup,
        f"SELECT * FROM ({_RUN_STATUS_SQL}) AS r "
        "WHERE run_id = (SELECT concat('run-', max(o_orderkey)) FROM orders)",
    ),
    "runs_overlap": (_overlap, _OVERLAP_SQL),
    "runs_service_levels": (_service_levels, _SERVICE_LEVELS_SQL),
}
