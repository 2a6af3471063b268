"""Exact duplicates by sorting content: equal texts become neighbours and are compared whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkward.llm.common import SPACES, original, stored

ADDED = ("keep_id", "group_size", "kept", "text_sha256")

# Splitters look at this many leading characters, then at a hash of the whole
# text: a splitter stays small and texts that begin alike are still spread.
OPENING = 32


def mark_copies(docs: DataFrame, smallest_slice: int = 1_000, most_slices: int = 20_000) -> DataFrame:
    """All columns of ``docs (doc_id, text, ...)`` with ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after replacing each run of white space by one
    space; null counts as empty. Spark samples splitters over the opening and
    hash, deals the rows by range, and sorts each range externally; in the sorted
    order runs of equal texts are found by comparing neighbours in full.

    A text with more rows than ``max(smallest_slice, rows / most_slices)`` is cut
    into slices by identifier, which are sorted apart and whose heads are then
    merged, so that no group meets in one task. At most ``most_slices`` texts can
    be that frequent, which bounds the broadcast list of their hashes.

    Of equal texts the row with the smallest identifier stays; a null identifier
    comes last; identifiers may be of any type that has an order. Of repeated rows with the same identifier one stays. Input columns
    named like an added one are replaced. An empty table gives an empty result.
    """
    identifier = docs.schema["doc_id"].dataType
    keyed = docs.select(F.struct("*").alias("row"))
    norm = _normalised("row")
    keyed = keyed.select(
        "row", F.left(norm, F.lit(OPENING)).alias("opening"), F.xxhash64(norm).alias("hash")
    )
    limit = max(smallest_slice, docs.count() // most_slices)
    frequent = stored(
        keyed.groupBy("hash").count().where(F.col("count") > limit)
        .select("hash", F.ceil(F.col("count") / limit).cast("int").alias("slices")),
        "frequent",
    )
    whole = [] if frequent.isEmpty() else [frequent]
    runs = _runs(keyed, whole)
    if whole:
        cut = keyed.join(F.broadcast(frequent.select("hash")), "hash", "left_semi")
        heads = _runs(cut, whole).where("place = 1")
        merged = heads.groupBy("norm").agg(F.min("keep_id").alias("first_id"), F.sum("group_size").alias("all"))
        merged = stored(merged.select(F.sha2("norm", 256).alias("text_sha256"), "first_id", "all"), "merged")
    marked = runs.select("row", "place", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"))
    marked = marked.join(F.broadcast(merged), "text_sha256", "left") if whole else marked.withColumns(
        {"first_id": F.lit(None).cast(identifier), "all": F.lit(None).cast("bigint")}
    )
    keep_id = F.when(F.col("all").isNull(), F.col("keep_id")).otherwise(F.col("first_id"))
    return marked.select(
        *original(marked, "row", ADDED),
        keep_id.alias("keep_id"),
        F.coalesce("all", "group_size").alias("group_size"),
        ((F.col("place") == 1) & F.col("row.doc_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def _normalised(row: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(f"{row}.text"), F.lit("")), SPACES, " ")


def _runs(keyed: DataFrame, frequent: list[DataFrame]) -> DataFrame:
    """Rows in content order with their place in the run of equal texts, its first id and length."""
    deal = ["opening", "hash"]
    if frequent:
        part = F.pmod(F.xxhash64("row.doc_id"), F.col("slices"))
        keyed = keyed.join(F.broadcast(frequent[0]), "hash", "left").withColumn(
            "slice", F.when(F.col("slices").isNull(), 0).otherwise(part).cast("int")
        )
        deal = [*deal, "slice"]
    dealt = keyed.repartitionByRange(*deal)
    # The range partitioning already brings a run together: no second shuffle.
    run = Window.partitionBy(*deal, "norm")
    return dealt.withColumn("norm", _normalised("row")).select(
        "row",
        "norm",
        F.row_number().over(run.orderBy(F.asc_nulls_last("row.doc_id"))).alias("place"),
        F.min("row.doc_id").over(run).alias("keep_id"),
        F.count("*").over(run).alias("group_size"),
    )
