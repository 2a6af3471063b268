"""Vectors as short codes: integer codebooks, searched exactly by Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkward.llm.common import stored

LARGEST = 2**63 - 1
_ROWS = 1_024  # vectors that are compared with all entries at a time
_LIMB = 40  # bits of a sum that travel in one row


@dataclass
class Codebooks:
    """Per part the entries (entries x width), all integers, and how vectors become integers."""

    entries: list[np.ndarray]
    dimension: int
    scale: int

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position."""
        numbers = (str(int(x)) for book in self.entries for entry in book for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


@cache
def _sequency(size: int) -> np.ndarray:
    """Rows of the Hadamard matrix of ``size`` by their number of sign changes."""
    changes = []
    for row in range(size):
        signs = np.array([(row & column).bit_count() & 1 for column in range(size)])
        changes.append(int(np.count_nonzero(np.diff(signs))))
    return np.argsort(changes, kind="stable")


def transform(rows: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard coefficients of each row, padded with zeros to a power of two, by sequency.

    Squared distances between coefficients are those between rows times the padded width.
    """
    width = rows.shape[1]
    size = 1 << max(0, width - 1).bit_length()
    result = np.zeros((len(rows), size), dtype=rows.dtype)
    result[:, :width] = rows
    half = 1
    while half < size:
        pairs = result.reshape(len(rows), size // (2 * half), 2, half)
        left, right = pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]
        result = np.stack([left, right], axis=2).reshape(len(rows), size)
        half *= 2
    return result[:, _sequency(size)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the index of the nearest of ``entries`` (of equal ones the lowest) and its squared distance.

    Scaled squared differences of coefficients are added in sequency order. An entry
    is out as soon as its sum exceeds the whole distance of the entry that led after
    the first coefficients; sums only grow, so none that could be nearest is lost.
    """
    large = max(_size(rows), _size(entries)) >= _exact_below(rows.shape[1])
    kind = object if large else np.int64  # object: Python's integers, without a bound
    rows, entries = rows.astype(kind), entries.astype(kind)
    index, distance = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=rows.dtype)
    coefficients = transform(entries)
    for first in range(0, len(rows), _ROWS):
        part = slice(first, first + _ROWS)
        index[part], distance[part] = _nearest(transform(rows[part]), coefficients)
    return index, distance // coefficients.shape[1]


def _nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = rows.shape[1]
    opening = max(1, size // 4)
    sums = np.zeros((len(rows), len(entries)), dtype=rows.dtype)
    for j in range(opening):
        sums += (rows[:, j, None] - entries[None, :, j]) ** 2
    leader = np.argmin(sums, axis=1)
    limit = ((rows - entries[leader]) ** 2).sum(axis=1)
    row, entry = np.nonzero((sums <= limit[:, None]).astype(bool))
    left = sums[row, entry]
    for j in range(opening, size):
        left = left + (rows[row, j] - entries[entry, j]) ** 2
        inside = (left <= limit[row]).astype(bool)
        row, entry, left = row[inside], entry[inside], left[inside]
    # The leader is still there, so every row is; rows and their entries are in order.
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(left, starts)
    best = np.flatnonzero((left == least[row]).astype(bool))
    best = best[np.flatnonzero(np.diff(row[best], prepend=-1))]
    return entry[best], left[best]


def _size(rows: np.ndarray) -> int:
    return int(np.abs(rows).max()) if rows.size else 0


def _exact_below(width: int) -> int:
    """Components below this leave every sum of scaled squared differences inside 64 bits."""
    size = 1 << max(0, width - 1).bit_length()
    return max(1, math.isqrt(2**61 // (size * max(width, 1))))


def _integers(vectors: Sequence[np.ndarray], books_of: tuple[int, int, int]) -> np.ndarray:
    """``floor(scale * x)`` of every component, vectors padded with zeros to all parts."""
    dimension, parts, scale = books_of
    result = np.zeros((len(vectors), parts * -(-dimension // parts)))
    for row, vector in zip(result, vectors, strict=True):
        row[: len(vector)] = vector
    with np.errstate(over="ignore"):
        scaled = np.floor(result * scale)
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    exact = [[math.floor(x * scale) if abs(x) < 2.0**62 else int(x) * scale for x in row] for row in result.tolist()]
    return np.array(exact, dtype=object)


def sound(column: str = "embedding") -> Column:
    """True for a vector without null and non-finite components; an empty one counts as zeros."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def fit(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> Codebooks:
    """Codebooks of the sound rows of ``vectors (vec_id, embedding)``.

    Components become ``floor(scale * x)``; vectors are cut into ``parts`` equal
    consecutive parts (padded with zeros where the longest vector doesn't divide). The
    codebooks begin as the parts of the ``entries`` smallest identifiers (null last, then by
    vector). In each round all parts go to their nearest entry, lower index first, and an
    entry becomes the floored mean of its parts; unused ones stay.

    Every round is one scan. A task sends the counts and sums of its parts, which Spark
    adds up; what reaches the driver are the codebooks alone, whatever the input. All
    arithmetic is in integers, without a bound where 64 bits might not do.
    """
    kept = vectors.where(sound()).select("vec_id", "embedding")
    dimension = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    shape = (dimension, parts, scale)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    whole = _integers([np.array(r["embedding"], dtype=float) for r in first], shape)
    books = Codebooks(np.split(whole, parts, axis=1), dimension, scale)
    for _ in range(rounds if first else 0):
        books = _moved(kept, books)
    return books


def _moved(kept: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = shared.value
        parts = len(books.entries)
        sums = [np.zeros(book.shape, dtype=object) for book in books.entries]
        count = [np.zeros(len(book), dtype=np.int64) for book in books.entries]
        for batch in batches:
            rows = _integers(batch["embedding"], (books.dimension, parts, books.scale))
            for part, own in enumerate(np.split(rows, parts, axis=1)):
                index, _ = nearest(own, books.entries[part])
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                if len(used):
                    sums[part][used] += np.add.reduceat(own[order], starts).astype(object)
                    count[part] += np.bincount(index, minlength=len(count[part]))
        found = []
        for part, entry in ((p, e) for p in range(parts) for e in np.flatnonzero(count[p]).tolist()):
            found.append((part, entry, -1, 0, int(count[part][entry])))
            for position, total in enumerate(sums[part][entry].tolist()):
                found.extend((part, entry, position, *limb) for limb in _limbs(int(total)))
        yield pd.DataFrame(found, columns=["part", "entry", "position", "limb", "n"])

    added = (
        kept.select("embedding").mapInPandas(add_up, "part int, entry int, position int, limb int, n bigint")
        .groupBy("part", "entry", "position", "limb").agg(F.sum("n").alias("n"))
    )
    totals: dict[tuple[int, int], dict[int, int]] = {}
    for part, entry, position, limb, n in added.toLocalIterator():
        own = totals.setdefault((part, entry), {})
        own[position] = own.get(position, 0) + (n << (_LIMB * limb))
    moved = [book.astype(object) for book in books.entries]
    for (part, entry), own in totals.items():
        moved[part][entry] = [own.get(i, 0) // own[-1] for i in range(moved[part].shape[1])]
    fits = all(_size(book) < 2**62 for book in moved)
    return Codebooks([book.astype(np.int64) if fits else book for book in moved], books.dimension, books.scale)


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """A sum as pieces that Spark can add without leaving 64 bits."""
    sign, rest, limb = (-1 if total < 0 else 1), abs(total), 0
    while rest:
        yield limb, sign * (rest & ((1 << _LIMB) - 1))
        rest >>= _LIMB
        limb += 1


def encode(vectors: DataFrame, books: Codebooks, carried: Sequence[str] = ("vec_id",)) -> DataFrame:
    """``carried`` columns, ``codes array<int>`` and ``error`` of the sound rows of ``vectors (embedding, ...)``.

    ``codes`` holds the nearest entry of each part; ``error`` is the sum of their squared
    distances (in steps of 1/scale, squared), at most 2^63 - 1. A vector longer than those
    of the codebooks is cut to their length. Rows are independent of each other.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    names = list(carried)
    kinds = [f"`{name}` {vectors.schema[name].dataType.simpleString()}" for name in names]

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = shared.value
        parts = len(books.entries)
        for batch in batches:
            cut = [vector[: books.dimension] for vector in batch.iloc[:, -1]]
            rows = _integers(cut, (books.dimension, parts, books.scale))
            codes, error = np.zeros((len(rows), parts), dtype=np.int32), np.zeros(len(rows), dtype=object)
            for part, own in enumerate(np.split(rows, parts, axis=1)):
                codes[:, part], distance = nearest(own, books.entries[part])
                error = error + distance.astype(object)
            yield batch[names].assign(codes=list(codes), error=[min(int(e), LARGEST) for e in error])

    kept = vectors.where(sound()).select(*names, F.col("embedding").alias("vector to encode"))
    return kept.mapInPandas(code, ", ".join([*kinds, "codes array<int>", "error bigint"]))


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes (codes, ...)`` with ``approximate array<double>``: the vectors that the entries stand for."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<double>")
    def approximate(column: pd.Series) -> pd.Series:
        books = shared.value
        rows = [
            np.concatenate([book[i] for book, i in zip(books.entries, row, strict=True)])[: books.dimension]
            for row in column
        ]
        return pd.Series([row.astype(float) / books.scale for row in rows])

    return codes.withColumn("approximate", approximate("codes"))


def compress(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
    most_hot: int = 1_000,
) -> DataFrame:
    """``vec_id, label, codes, error, label_error, codebooks_sha256`` of ``vectors (vec_id, embedding, label)``.

    :func:`fit`, then :func:`encode`. ``label_error`` is the sum of ``error`` over equal labels,
    nulls together, at most 2^63 - 1. Rows whose vector is null or holds a null or
    non-finite component are left out; a zero or empty vector is a vector. Rows with a null
    identifier are ordinary ones, last among the first entries. Repeated rows are rows of
    their own. Other columns are ignored; an empty table gives an empty result.

    Sums per label are made in the map tasks. Those of labels with over a
    1/``most_hot`` of all rows, fewer than ``most_hot``, are broadcast; the others are joined.
    """
    books = fit(vectors, parts, entries, rounds, scale)
    coded = stored(encode(vectors, books, ("vec_id", "label")), "coded")
    sums = coded.groupBy("label").agg(
        F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("rows")
    )
    label_error = F.least("sum", F.lit(LARGEST).cast("decimal(38,0)")).cast("bigint")
    limit = max(1, coded.count() // most_hot)
    sums = stored(
        sums.select(F.col("label").alias("of"), label_error.alias("label_error"), (F.col("rows") > limit).alias("hot")),
        "labels",
    )
    hot = F.broadcast(sums.where("hot").drop("hot"))
    marked = coded.join(hot, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    cold = sums.where("not hot").select("of", F.col("label_error").alias("cold"))
    rest = marked.where("label_error is null").drop("label_error")
    rest = rest.join(cold, F.col("label").eqNullSafe(F.col("of"))).withColumnRenamed("cold", "label_error")
    columns = ["vec_id", "label", "codes", "error", "label_error"]
    both = marked.where("label_error is not null").select(columns).unionByName(rest.select(columns))
    return both.withColumn("codebooks_sha256", F.lit(books.digest()))
