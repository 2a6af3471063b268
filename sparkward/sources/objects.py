"""Inventories of objects: listing and looking up, never reading contents.

The operators take any DataFrame with the columns of ``OBJECT_COLUMNS``. For a
folder it comes from ``list_files``; for stores too large to be listed at once
it is the inventory table such stores can write themselves.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

OBJECT_COLUMNS = ["bucket", "name", "size_bytes", "content_type", "updated_at", "etag"]

DEFAULT_MAX_RESULTS = 100

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"

# File extension and MIME type.
CONTENT_TYPES = {
    "avro": "application/avro",
    "csv": "text/csv",
    "gz": "application/gzip",
    "htm": "text/html",
    "html": "text/html",
    "jpg": "image/jpeg",
    "json": "application/json",
    "jsonl": "application/x-ndjson",
    "orc": "application/vnd.apache.orc",
    "parquet": "application/vnd.apache.parquet",
    "pdf": "application/pdf",
    "png": "image/png",
    "txt": "text/plain",
    "xml": "application/xml",
    "zip": "application/zip",
}


class ObjectNotFound(Exception):
    """No object has that bucket and name."""


def content_type(name: Column) -> Column:
    """MIME type by file extension, null if unknown."""
    pairs = [F.lit(text) for pair in CONTENT_TYPES.items() for text in pair]
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)\z", 1))
    return F.try_element_at(F.create_map(*pairs), extension)


def _without_scheme(path: str) -> str:
    return re.sub(_SCHEME, "", path).rstrip("/")


def list_files(spark: SparkSession, root: str, bucket: str | None = None) -> DataFrame:
    """The files below ``root`` as objects; names are relative to it.

    Listed by Spark through its file systems and their credentials, in parallel
    once there are many folders; contents are never read. As in every file source
    of Spark, empty files and names that begin with ``.`` or ``_`` are left out,
    and no entity tag is known.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = _without_scheme(root)
    return files.select(
        F.lit(bucket or base.rsplit("/", 1)[-1]).alias("bucket"),
        F.substr(F.regexp_replace("path", _SCHEME, ""), F.lit(len(base) + 2)).alias("name"),
        F.col("length").alias("size_bytes"),
        content_type(F.col("path")).alias("content_type"),
        F.col("modificationTime").alias("updated_at"),
        F.lit(None).cast("string").alias("etag"),
    )


def list_objects(
    objects: DataFrame, bucket: str, prefix: str = "", max_results: int = DEFAULT_MAX_RESULTS
) -> DataFrame:
    """Objects of a bucket whose names start with ``prefix``, by name.

    The bucket and the prefix are pushed into the scan of an inventory table.
    """
    if max_results < 1:
        raise ValueError("max_results must be at least 1")
    matching = objects.where((F.col("bucket") == bucket) & F.startswith("name", F.lit(prefix)))
    return matching.orderBy("name").limit(max_results)


def object_metadata(objects: DataFrame, bucket: str, name: str) -> DataFrame:
    """The row of one object (none if it does not exist)."""
    return objects.where((F.col("bucket") == bucket) & (F.col("name") == name))


def require_object(objects: DataFrame, bucket: str, name: str) -> Row:
    """The row of one object, or an error."""
    row = object_metadata(objects, bucket, name).first()
    if row is None:
        raise ObjectNotFound(f"No such object: {bucket}/{name}")
    return row
