"""Inputs that the given tables do not hold, derived from them row by row.

The expressions run unchanged in Spark and in DuckDB. ``#`` stands for a quote
and ``~`` for a newline until replaced, since the two escape them differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS_AS_OF = "2024-02-01 00:00:00"
ORDERS_AS_OF = "2001-09-01 00:00:00"

_STATEMENTS = [
    "SELECT * FROM `proj.sales.orders`",
    "select a from proj.sales.orders o JOIN `proj.hr.salaries` s ON 1=1",
    "DELETE FROM proj.sales.orders",
    "SELECT 1",
    "-- DROP TABLE t~SELECT x FROM proj.sales.customers",
    "SELECT #please do not DELETE this# AS note FROM proj.sales.orders",
    "SELECT #--#; DROP TABLE t",
    "WITH c AS (SELECT 1) SELECT * FROM c",
    "/* lead */ SELECT EXTRACT(YEAR FROM ts) FROM proj.sales.orders;",
    "SELECT 1; DELETE FROM t",
    " ~ ",
    "SELECT REPLACE(a, #x#, #y#) FROM proj.sales.orders",
    "SELECT a FROM proj.sales.orders; ;",
    "SELECT * FROM `proj`.`sales`.`orders`",
    "select o.id from proj.sales.orders o, proj.hr.salaries s",
    "123",
    "/* MERGE ~ */ with a as (select \"drop -- \" x FROM proj.sales.a) /* x */ "
    "select * FROM~proj.sales.b JOIN proj.sales.a -- CALL",
    "update t set a = 1; truncate table t",
]
_TABLES = {
    0: "proj.sales.orders",
    1: "proj.sales.orders,proj.hr.salaries",
    4: "proj.sales.customers",
    5: "proj.sales.orders",
    8: "proj.sales.orders",
    11: "proj.sales.orders",
    12: "proj.sales.orders",
    13: "proj.sales.orders",
    14: "proj.sales.orders,proj.hr.salaries",
    16: "proj.sales.b,proj.sales.a",
}


def _by_kind(values) -> str:
    kind = f"event_id % {len(_STATEMENTS)}"
    return " ".join(["CASE", *(f"WHEN {kind} = {k} THEN '{v}'" for k, v in values), "END"])


QUERY_LOG = [
    "event_id AS request_id",
    "ts",
    "concat('agent-', CAST(user_id % 7 AS STRING)) AS actor",
    f"replace(replace({_by_kind(enumerate(_STATEMENTS))}, '#', chr(39)), '~', chr(10)) AS sql",
    f"split({_by_kind(_TABLES.items())}, ',') AS referenced_tables",
    "CAST((event_id * 7919) % 2000 AS BIGINT) * 1000 AS estimated_bytes",
]

OBJECTS = [
    "regexp_extract(url, '^https?://([^/?#]+)', 1) AS bucket",
    "regexp_extract(url, '^https?://[^/?#]+/?([^?#]*)', 1) AS name",
    "CAST(length(html) AS BIGINT) AS size_bytes",
    "page_id",
]

# Start at midnight of the order date; runs that succeeded end on that day.
RUN_PAYLOADS = [
    "concat('dag-', CAST(o_custkey % 5 AS STRING)) AS dag_id",
    "concat('run-', CAST(o_orderkey AS STRING)) AS run_id",
    "concat('{\"state\": \"', CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' "
    "ELSE 'up_for_retry' END, '\", \"start_date\": \"', "
    "substr(CAST(o_orderdate AS STRING), 1, 10), 'T00:00:00Z\", \"end_date\": ', "
    "CASE WHEN o_orderstatus = 'F' THEN concat('\"', "
    "substr(CAST(o_orderdate AS STRING), 1, 10), 'T', "
    "lpad(CAST(o_custkey % 24 AS STRING), 2, '0'), ':', "
    "lpad(CAST(o_orderkey % 60 AS STRING), 2, '0'), ':30+00:00\"') ELSE 'null' END, '}') AS body",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*QUERY_LOG)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(*OBJECTS)


def run_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*RUN_PAYLOADS)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, null where there is none."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def select_sql(columns: list[str], source: str) -> str:
    """The same derivation as SQL text."""
    return f"SELECT {', '.join(columns)} FROM {source}"


LABELLED_SQL = (
    "SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
