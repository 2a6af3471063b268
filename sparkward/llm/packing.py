"""Token sequences of fixed capacity by harmonic packing."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkward.llm.common import stored, stored_texts

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@cache
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ``tokenizers`` file, encoded by ``tiktoken``.

    The vocabulary in the file lists its merges in order, so its ids are the ranks;
    ids are the same (see the tests) at a fifth of the time. The file's added tokens are
    the special ones.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {token["content"]: token["id"] for token in content["added_tokens"]}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    as_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {
        bytes(as_byte[sign] for sign in token): rank
        for token, rank in content["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )


@cache
def ids_by(path: str) -> Callable[[str], list[int]]:
    """A function that gives the ids of a text; an added token of the file that stands in it is one id."""
    ranks = encoder(path)
    special = sorted(ranks.special_tokens_set)

    def ids(text: str) -> list[int]:
        if any(token in text for token in special):
            return ranks.encode(text, allowed_special="all")
        return ranks.encode_ordinary(text)

    return ids


def cut(length: int, capacity: int, smallest: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then falling powers of two, then the rest.

    All but the rest (below ``smallest``) divide the capacity, so their classes fill
    sequences without a gap.
    """
    whole, rest = divmod(length, capacity)
    sizes = [capacity] * whole
    power = capacity // 2
    while power >= smallest:
        if rest >= power:
            sizes.append(power)
            rest -= power
        power //= 2
    return sizes + [rest] * (rest > 0)


def pieces(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    capacity: int = 1024,
    smallest: int = 64,
    end: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) of every piece of ``docs (doc_id, text)``."""
    identifier = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {identifier}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    schema += ", ids array<int>" * with_ids

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_text = ids_by(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode_text(text or ""), end], dtype="<u4")
                start = 0
                for size in cut(len(ids), capacity, smallest):
                    part = ids[start : start + size]
                    row = (doc_id, start, size, zlib.crc32(part.tobytes()), len(ids))
                    rows.append((*row, part.astype(np.int32)) if with_ids else row)
                    start += size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"doc_id": batch["doc_id"].dtype})

    return docs.select("doc_id", "text").mapInPandas(encode, schema)


def pack(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    capacity: int = 1024,
    smallest: int = 64,
    end: int = 0,
    with_ids: bool = False,
    pieces_per_run: int = 50_000,
) -> DataFrame:
    """The pieces of ``docs (doc_id, text)`` with ``sequence_id`` and ``offset``.

    A document is its ids and one ``end``; a null text has only the end. Documents
    are cut (see :func:`cut`) into pieces of at most ``capacity``, a power of two.
    The class of a piece is ``k = capacity // length``: ``k`` of its class fill a
    sequence at least to ``k / (k + 1)``. Every sequence of a class takes the next
    ``k`` pieces of it. Runs of pieces (a hash of the identifier) are ranked apart,
    each worker knowing from the counts of the others only where its ranks begin,
    so no class and no source meets in one task.

    What no full sequence of its class takes (under ``k`` pieces per class, at most
    some thousand whatever the input) is placed first fit, longest first, in one
    small task. Sequences are numbered from 0 class by class, the mixed ones last.

    Repeated rows are documents of their own; null identifiers are ordinary values.
    Other columns are ignored; an empty table gives an empty result.
    """
    table = stored_texts(pieces(docs, tokenizer, capacity, smallest, end, with_ids), "pieces")
    runs = max(1, table.count() // pieces_per_run)
    table = table.withColumns(
        {
            "k": F.floor(F.lit(capacity) / F.col("length")).cast("int"),
            "run": F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int"),
        }
    )
    counts = table.groupBy("k", "run").agg(F.count("*").alias("pieces"))
    by_run = Window.partitionBy("k").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    in_class = Window.partitionBy("k")
    counts = counts.select(
        "k",
        "run",
        F.coalesce(F.sum("pieces").over(by_run), F.lit(0)).alias("first"),
        F.floor(F.sum("pieces").over(in_class) / F.col("k")).alias("sequences"),
    )
    # One row per class: at most one class for every length.
    classes = counts.groupBy("k").agg(F.first("sequences").alias("sequences"))
    before = F.sum("sequences").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    classes = classes.select("k", F.coalesce(before, F.lit(0)).alias("base"))
    counts = stored(counts.join(classes, "k"), "classes")
    total = counts.groupBy("k").agg(F.first("sequences").alias("n")).agg(F.sum("n")).first()[0] or 0

    order = Window.partitionBy("k", "run").orderBy("doc_id", "start", "ids_crc32")
    ranked = table.withColumn("place", F.row_number().over(order) - 1).join(counts, ["k", "run"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("place")).drop("first", "place", "run")
    full = F.col("rank") < F.col("sequences") * F.col("k")
    ranked = stored(ranked.withColumn("full", full), "ranked")

    in_sequence = Window.partitionBy("sequence_id").orderBy("rank")
    earlier = F.sum("length").over(in_sequence.rowsBetween(Window.unboundedPreceding, -1))
    filled = (
        ranked.where("full")
        .withColumn("sequence_id", F.col("base") + F.floor(F.col("rank") / F.col("k")))
        .withColumn("offset", F.coalesce(earlier, F.lit(0)))
    )
    rest = (
        ranked.where("not full")
        .groupBy(F.lit(True).alias("rest"))
        .applyInPandas(
            lambda rows: _first_fit(rows, capacity, total), "k int, rank bigint, sequence_id bigint, offset bigint"
        )
    )
    mixed = ranked.where("not full").join(rest, ["k", "rank"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns += ["ids"] * with_ids
    return filled.select(columns).unionByName(mixed.select(columns))


def _first_fit(rows: pd.DataFrame, capacity: int, first: int) -> pd.DataFrame:
    """Place the longest first in the first sequence with room."""
    rows = rows.sort_values(["length", "k", "rank"], ascending=[False, True, True])
    used: list[int] = []
    sequence, offset = [], []
    open_from = 0
    for length in rows["length"]:
        while open_from < len(used) and used[open_from] == capacity:
            open_from += 1
        place = next((i for i in range(open_from, len(used)) if used[i] + length <= capacity), len(used))
        if place == len(used):
            used.append(0)
        sequence.append(first + place)
        offset.append(used[place])
        used[place] += length
    return pd.DataFrame({"k": rows["k"], "rank": rows["rank"], "sequence_id": sequence, "offset": offset})
