"""Session helpers shared by the library, the bench and the tests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Let row counts and null counts be answered from Parquet footers. Both are
# needed: the aggregate push-down exists only in the newer Parquet reader.
V1_SOURCES = "spark.sql.sources.useV1SourceList"
FOOTER_COUNT_CONF = {
    V1_SOURCES: "",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def footer_counts_enabled(spark: SparkSession) -> bool:
    """True if this session answers COUNT(*) and COUNT(column) from footers."""
    v1_sources = spark.conf.get(V1_SOURCES, "parquet")
    pushdown = spark.conf.get("spark.sql.parquet.aggregatePushdown", "false")
    return pushdown == "true" and "parquet" not in v1_sources.split(",")


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared folder (``spark.checkpoint.dir``).

    Only a local master may fall back to a temporary folder: on a cluster the
    other machines could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the cluster's shared folder and read it back.

    Cuts the lineage: later reads need neither the executors that computed it
    nor the inputs, and what follows plans with its true size.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing will read any more."""
    for table in tables:
        remove(table.sparkSession, table._stored_at)


def filesystem(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path as it wants it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that the library wrote; one that is gone is no error."""
    files, at = filesystem(spark, path)
    files.delete(at, True)


def local_frame(spark: SparkSession, schema: T.StructType, rows: Sequence[Sequence]) -> DataFrame:
    """Configuration-sized rows as a local relation.

    The optimiser knows its size and can fold expressions over it, so nothing
    built on it alone starts a job.
    """
    columns = zip(*rows) if rows else [() for _ in schema.fields]
    table = pa.table({f.name: list(c) for f, c in zip(schema.fields, columns, strict=True)})
    return spark.createDataFrame(table, schema=schema)
