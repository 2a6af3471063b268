"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkward.session import discard, stored

__all__ = [
    "LOWER", "SPACES", "WORD", "discard", "in_chunks", "numbered", "original", "remainder", "spread_join",
    "stored", "stored_texts", "unit_interval",
]

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Translation table for bytes that lower-cases A-Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# Above so many files a table is written anew to number its rows.
MOST_FILES = 2_000_000


def numbered(docs: DataFrame) -> DataFrame:
    """``number, row``: the columns of ``docs`` as a struct, and a number of their own for every row.

    Rows of Parquet files are numbered by the rank of their file and their place in it, so they
    have the same numbers whenever the files are read, and nothing is written or shuffled but
    one row per file. Any other table is stored first.
    """
    if not _is_scan(docs):
        docs = stored(docs, "numbered")
    placed = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.row_index").alias("place"),
    )
    files = stored(placed.select("path").distinct(), "files")
    if files.count() > MOST_FILES:
        return numbered(stored(docs, "numbered").where("true"))
    ranked = files.withColumn("rank", F.row_number().over(Window.orderBy("path")).cast("bigint") - 1)
    number = F.shiftleft(F.col("rank"), 40) + F.col("place")
    return placed.join(F.broadcast(ranked), "path").select(number.alias("number"), "row")


def _is_scan(docs: DataFrame) -> bool:
    """Whether a table is what files hold, row by row."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString()


def spread_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join on a key that ``table`` holds once, with no task for all rows of a frequent key.

    A key with over a thousandth of all ``rows`` (a thousand at least) is dealt over several tasks, each with a
    copy of its row in ``table``. There are fewer than a thousand such keys; their list is broadcast.
    ``counts`` may hold ``key, n`` of ``rows``, which are stored.
    """
    limit = max(1_000, rows.count() // 1_000)
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    shares = F.ceil(F.col("n") / limit).cast("int").alias("shares")
    hot = stored(counts.where(F.col("n") > limit).select(key, shares), "hot")
    if hot.isEmpty():
        return rows.join(table, key)
    share = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in rows.columns]), F.coalesce("shares", F.lit(1)))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("share", share.cast("int")).drop("shares")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))
    copied = table.join(F.broadcast(hot), key, "left").withColumn("share", copies).drop("shares")
    return dealt.join(copied, [key, "share"]).drop("share")


# Rows of text that travel to a Python task at a time: some megabytes, also where texts are long.
ROWS_OF_TEXT = 1_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored_texts(df: DataFrame, name: str) -> DataFrame:
    """:func:`stored` for a table made from texts in Python, which are handed over in small batches.

    Spark's own batches of 10,000 rows are held several times over, on both sides of the task.
    """
    settings = df.sparkSession.conf
    before = settings.get(_BATCH_ROWS)
    settings.set(_BATCH_ROWS, str(min(int(before) if int(before) > 0 else ROWS_OF_TEXT, ROWS_OF_TEXT)))
    try:
        return stored(df, name)
    finally:
        settings.set(_BATCH_ROWS, before)


def remainder(identifier: str | Column, modulus: int) -> Column:
    """``crc32`` of an identifier as text, modulo. A null identifier counts as empty text."""
    column = F.col(identifier) if isinstance(identifier, str) else identifier
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def unit_interval(column: Column) -> Column:
    """A uniform number strictly between 0 and 1 that only the value decides."""
    digits = F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def original(df: DataFrame, row: str, added: Sequence[str]) -> list[Column]:
    """The columns packed in ``row``, without those that the operator adds under the same name."""
    names = {name.lower() for name in added}
    return [
        F.col(row).getField(name).alias(name)
        for name in df.schema[row].dataType.names
        if name.lower() not in names
    ]


def in_chunks(texts: Sequence[str | None], limit: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8, null as empty, in runs of about ``limit`` bytes with the first one's position."""
    first, size, run = 0, 0, []
    for position, text in enumerate(texts):
        data = text.encode() if text else b""
        if run and size + len(data) > limit:
            yield first, run
            first, size, run = position, 0, []
        run.append(data)
        size += len(data)
    if run:
        yield first, run
