"""Shards of equal size by vector bin packing."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkward.llm.common import WORD, stored

ROW_BYTES = 8


def assign_shards(
    docs: DataFrame,
    shards: int = 24,
    groups_per_slice: int = 20_000,
    parts_of_a_shard: int = 64,
    rows_per_run: int = 100_000,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for ``docs (doc_id, text)``.

    The law is ``bytes``: bytes, and with less weight words and rows, are spread
    evenly over ``shards``; ``grown_shard`` is null, as this law does not promise
    that little moves when a shard is added. Size is the text's UTF-8 bytes plus 8.

    Rows of equal text form a group and go to one shard, save where a group holds
    more than a 1/``parts_of_a_shard`` of a shard's bytes: it is cut by identifier
    into parts below that (at most ``shards * parts_of_a_shard`` such groups exist,
    so their list may be broadcast). Groups are dealt by hash into slices of about
    ``groups_per_slice``, and every slice packs its own: largest first, each to the
    shard where its bytes, words and rows have the highest dot product with the
    capacity that is left. Slices are packed apart, so work and memory of a task do
    not grow with the input; the small differences that each leaves do not add up,
    as slices start at different shards.

    ``slot`` counts a shard's rows from 0 in the order of runs (a hash of the
    identifier) and of identifiers: runs are ranked apart and then moved by the
    rows before them. A null text has no bytes and no words and equals the empty
    text; null identifiers are ordinary values. Repeated rows each get a slot.
    Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("key"),
        ),
        "sizes",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    total, count = groups.agg(F.sum("bytes"), F.count("*")).first()
    most = max(1, (total or 0) // (shards * parts_of_a_shard))
    large = groups.where(F.col("bytes") > most).select("key", F.ceil(F.col("bytes") / most).alias("parts"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    rows = rows.join(F.broadcast(large), "key", "left").withColumn("part", part.cast("int")).drop("parts")

    slices = max(1, count // groups_per_slice)
    units = (
        rows.groupBy("key", "part")
        .agg(F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count("*").alias("rows"))
        .withColumn("slice", F.pmod(F.xxhash64("key", "part"), F.lit(slices)).cast("int"))
    )
    placed = units.groupBy("slice").applyInPandas(
        lambda slice_: _pack(slice_, shards), "key binary, part int, shard int"
    )
    run = F.pmod(F.xxhash64("doc_id", F.lit("run")), F.lit(max(1, count // rows_per_run)))
    rows = stored(
        rows.join(placed, ["key", "part"])
        .select("doc_id", "size", "text_crc32", "shard", run.cast("int").alias("run")),
        "placed",
    )
    return _with_slots(rows).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _pack(units: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Largest unit first to the shard with the highest dot product."""
    units = units.sort_values(["bytes", "words", "key", "part"], ascending=[False, False, True, True])
    needs = units[["bytes", "words", "rows"]].to_numpy(dtype=float)
    capacity = np.maximum(needs.sum(axis=0) / shards, 1.0)
    # Bytes are the law; words and rows decide between shards that are about as full.
    needs = needs / capacity * np.sqrt([1.0, 0.05, 0.05])
    left = np.tile(np.sqrt([1.0, 0.05, 0.05]), (shards, 1))
    chosen = np.empty(len(needs), dtype=np.int32)
    for i, need in enumerate(needs):
        best = int(np.argmax(left @ need))
        left[best] -= need
        chosen[i] = best
    start = int(units["slice"].iloc[0])
    return pd.DataFrame(
        {"key": units["key"], "part": units["part"], "shard": ((chosen + start) % shards).astype(np.int32)}
    )


def _with_slots(rows: DataFrame) -> DataFrame:
    runs = rows.groupBy("shard", "run").agg(F.count("*").alias("length"))
    before = F.sum("length").over(
        Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = runs.select("shard", "run", F.coalesce(before, F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "run").orderBy("doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.join(runs, ["shard", "run"]).withColumn("slot", F.col("first") + F.col("rank"))
