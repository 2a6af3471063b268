"""Language-model scores by a probabilistic suffix tree.

A text is its words, A-Z lower-cased, each followed by a blank, and then the end: a
sequence of bytes in which 0x0A is the end. The tree predicts each byte from
the longest retained context of up to ``depth`` bytes before it, which makes a
distribution over all sequences of words. Contexts are retained for the evidence there
is for them, so their number grows with the corpus: they are tables, never a whole
on the driver or in a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkward.llm.common import LOWER, discard, in_chunks, stored, stored_texts

END = 10
_END_HASH = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
_LANE = 1024
_NEAR = 3  # bytes of context by which codes are dealt
_FRAME = 250_000
_DEALT = 1021  # groups of keys that travel as lists; a prime, so that all bytes of a key tell its group
_LISTS = 128  # lists that go to Spark at once
_POOL = 3_000_000  # keys that a task holds before it sums or hands them on
_MOST = 1 << 30  # occurrences that a task holds before it hands them on
_PAIRS = 1_000_000  # rare keys of documents that a block of documents holds
_UNKNOWN = math.log10(0.5)  # of a word that no training text holds
# Numbers that travel packed, many in a row.
_TYPES = {"key": np.int64, "n": np.int32, "times": np.int32, "owner": np.int32, "known": np.int32, "value": np.float64}


@dataclass
class Tree:
    """An automaton over contexts: what follows a context with what probability, and the next context."""

    depth: int
    symbols: np.ndarray  # of each byte the column; the last column is for bytes never seen
    following: np.ndarray  # contexts x columns: next context
    log10: np.ndarray  # contexts x columns
    retained: int

    def scores(self, data: np.ndarray) -> np.ndarray:
        """log10 probability of each byte of ``data``, given all bytes before it.

        The bytes are laid out in lanes that advance together. Each lane first reads
        the ``depth`` bytes before its own; then its context is the true one.
        """
        lanes = max(1, -(-len(data) // _LANE))
        padded = np.full(lanes * _LANE + self.depth, self.symbols[END], dtype=np.int64)
        padded[self.depth : self.depth + len(data)] = self.symbols[data]
        steps = np.lib.stride_tricks.sliding_window_view(padded, _LANE + self.depth)[::_LANE]
        steps = np.ascontiguousarray(steps.T)
        columns = self.log10.shape[1]
        following, log10 = self.following.ravel(), self.log10.ravel()
        context = np.zeros(lanes, dtype=np.int64)
        result = np.empty((_LANE, lanes), dtype=log10.dtype)
        for step, symbol in enumerate(steps):
            cell = context * columns + symbol
            if step >= self.depth:
                log10.take(cell, out=result[step - self.depth], mode="clip")
            context = following.take(cell)
        return result.T.ravel()[: len(data)]


def _laid_out(texts: list[bytes], depth: int) -> tuple[np.ndarray, ...]:
    """All texts as one sequence, which bytes are predicted, each text's start; hashes of all words, words per text.

    Before every text stand ``depth`` ends, so that contexts do not reach into the text before.
    """
    words = [text.translate(LOWER).split() for text in texts]
    joined = [b" ".join([*w, b"\n"]) for w in words]
    pad = b"\n" * depth
    data = np.frombuffer(b"".join(pad + j for j in joined), dtype=np.uint8)
    lengths = np.array([len(j) + depth for j in joined])
    starts = np.cumsum(lengths) - lengths
    predicted = np.ones(len(data), dtype=bool)
    predicted[(starts[:, None] + np.arange(depth)[None, :]).ravel()] = False
    count = np.array([len(w) for w in words])
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(count.sum()))
    return data, predicted, starts, hashes, count


def _codes(data: np.ndarray, predicted: np.ndarray, depth: int) -> np.ndarray:
    """Of each predicted byte the code of its context and itself; the byte is the lowest."""
    padded = np.concatenate([np.zeros(7, dtype=np.uint8), data])
    code = np.ndarray(len(data), dtype=">i8", buffer=padded, strides=(1,))  # the eight bytes up to each
    return code[predicted].astype(np.int64) & ((1 << (8 * (depth + 1))) - 1)


def _gathered(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, byte) codes with counts and distinct words with counts."""
    data, predicted, _, hashes, count = _laid_out(texts, depth)
    grams, n_grams = np.unique(_codes(data, predicted, depth), return_counts=True)
    ends = np.full(len(count), _END_HASH)
    tokens, n_tokens = np.unique(np.concatenate([hashes, ends]), return_counts=True)
    return grams, n_grams, tokens.view(np.int64), n_tokens


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of ``parts (key, count, ...)``, each sorted by its distinct keys, the distinct keys with their sums, sorted."""
    if len(parts) == 1:
        return parts[0]
    keys, *counts = (np.concatenate(column) for column in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")  # merges what is sorted already
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(n[order], first) for n in counts)


def _packed(sizes: np.ndarray, **columns: np.ndarray) -> dict[str, pa.Array]:
    """Binary columns in which every row holds as many numbers as ``sizes`` says, one row after the other."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    packed = {}
    for name, values in columns.items():
        values = np.ascontiguousarray(values, dtype=_TYPES[name])
        offsets = (ends * values.itemsize).astype(np.int32)
        packed[name] = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return packed


def _lists(group: np.ndarray, **columns: np.ndarray) -> dict[str, pa.Array]:
    """A row for each ``group`` there is: its number as ``dealt``, and the values of its rows, in their order."""
    order = np.argsort(group.astype(np.uint16), kind="stable")
    sizes = np.bincount(group, minlength=_DEALT)
    present = np.flatnonzero(sizes)
    packed = _packed(sizes[present], **{name: values[order] for name, values in columns.items()})
    return {"dealt": pa.array(present, pa.int32())} | packed


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of :func:`_lists` in pieces of some megabytes, which both sides of a task can hold at ease."""
    yield from (batch.slice(i, _LISTS) for i in range(0, batch.num_rows, _LISTS))


def _rows(batch: pa.RecordBatch, plain: tuple[str, ...], lists: tuple[str, ...]) -> Iterator[tuple]:
    """Of each row its values of the columns ``plain`` and, as arrays, the numbers in the columns ``lists``."""
    columns = [batch.column(name).to_pylist() for name in plain]
    for name in lists:
        columns.append([np.frombuffer(packed or b"", _TYPES[name]) for packed in batch.column(name).to_pylist()])
    return zip(*columns, strict=True)


def _dealt(docs: DataFrame, depth: int) -> DataFrame:
    """``word, dealt, key, n, times``: counts of :func:`count_all` of each task, as lists by group of keys.

    All codes with the same nearest ``_NEAR`` bytes are in the same group. A task's
    counts are some rows a group and not one a key, so shuffling and sorting them costs little.
    """
    near_mask = (1 << (8 * _NEAR)) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(kept: list, word: bool) -> Iterator[pa.RecordBatch]:
            keys, n, times = _summed(kept)
            kept.clear()
            group = (keys if word else (keys >> 8) & near_mask) % _DEALT
            lists = _lists(group, key=keys, n=n, times=times)
            yield from _cut(pa.RecordBatch.from_pydict({"word": pa.repeat(word, len(lists["dealt"]))} | lists))

        def gather(training: bool) -> Iterator[pa.RecordBatch]:
            size[training] = 0
            for _, texts in in_chunks(waiting[training]):
                g, n_g, w, n_w = _gathered(texts, depth)
                pools[False].append((g, n_g if training else np.zeros_like(n_g), n_g))
                if training:
                    pools[True].append((w, n_w, n_w))
                for word, kept in pools.items():
                    counted = sum(int(m.sum()) for *_, m in kept)  # counts travel as 32 bits
                    if counted > _MOST or sum(len(k) for k, *_ in kept) > _POOL:
                        yield from flush(kept, word)
            waiting[training].clear()

        pools: dict[bool, list] = {False: [], True: []}
        waiting: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}
        for batch in batches:
            for text, training in zip(batch.column("text").to_pylist(), batch.column("training").to_pylist(), strict=True):
                waiting[training].append(text)
                size[training] += len(text or "") + 1
                if size[training] > _POOL:
                    yield from gather(training)
        for training in waiting:
            yield from gather(training)
        for word, kept in pools.items():
            if kept:
                yield from flush(kept, word)

    schema = "word boolean, dealt int, key binary, n binary, times binary"
    return docs.select("text", "training").mapInArrow(count, schema)


def _counted(docs: DataFrame, depth: int, schema: str, finish: Callable[..., dict]) -> DataFrame:
    """What ``finish`` makes of ``word, key, n, times`` of every group of :func:`_dealt`, summed over all tasks.

    The parts of a group come one after the other and are merged as they come.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished() -> Iterator[pa.RecordBatch]:
            made = pa.RecordBatch.from_pydict(finish(group[0], *_summed(parts)))
            yield from (made.slice(i, _FRAME) for i in range(0, made.num_rows, _FRAME))

        group, parts, size, most = None, [], 0, _POOL
        for batch in batches:
            for word, dealt, key, n, times in _rows(batch, ("word", "dealt"), ("key", "n", "times")):
                if (word, dealt) != group:
                    if parts:
                        yield from finished()
                    group, parts, size, most = (word, dealt), [], 0, _POOL
                parts.append((key, n.astype(np.int64), times.astype(np.int64)))
                size += len(key)
                if size > most:
                    parts = [_summed(parts)]
                    size = len(parts[0][0])
                    most = max(_POOL, 2 * size)
        if parts:
            yield from finished()

    return _dealt(docs, depth).repartition("word", "dealt").sortWithinPartitions("word", "dealt").mapInArrow(merge, schema)


def count_all(docs: DataFrame, depth: int) -> DataFrame:
    """``word, key, n, times`` of ``docs (text, training)``.

    How often words (by hash) and contexts with their next byte (by code) occur in
    training texts, and how often in all; words of other texts are not counted.
    """

    def finish(word: bool, key: np.ndarray, n: np.ndarray, times: np.ndarray) -> dict:
        return {"word": pa.repeat(word, len(key)), "key": key, "n": n, "times": times}

    return _counted(docs, depth, "word boolean, key bigint, n bigint, times bigint", finish)


def count_training(docs: DataFrame, depth: int) -> DataFrame:
    """``word, key, n``: the counts of :func:`count_all` if all texts are for training."""
    return count_all(docs.select("text", F.lit(True).alias("training")), depth).drop("times")


def _far(key: np.ndarray, n: np.ndarray, depth: int, fewest: int, gain: float, smoothing: float) -> tuple:
    """``given, of_less, stays`` of codes that hold all with the same nearest ``_NEAR`` bytes, or none.

    The probability of a code is ``given + of_less * p``, ``p`` that of its last ``_NEAR`` bytes of context;
    ``stays`` tells whether a longer context of its is retained. See :func:`probabilities`.
    """
    stays = np.zeros(len(key), dtype=bool)
    steps = []
    for length in range(depth, _NEAR, -1):
        suffix, shorter = np.unique(key & ((1 << (8 * length)) - 1), return_inverse=True)
        _, context = np.unique(key >> 8, return_inverse=True)
        _, parent = np.unique(suffix >> 8, return_inverse=True)
        follows = np.bincount(shorter, n)
        before = (follows / np.maximum(np.bincount(parent, follows), 1)[parent])[shorter]
        own = np.bincount(context, n)[context]
        told = n * np.log(np.where(n > 0, n, 1) / np.maximum(own, 1) / np.where(n > 0, before, 1))
        divergent = (own >= max(fewest, 1)) & (np.bincount(context, told)[context] >= gain)
        retained = divergent | (np.bincount(context, stays) > 0)[context]
        steps.append((shorter, np.where(retained, own, 0), n, retained))
        key, n, stays = suffix, follows, np.bincount(shorter, retained) > 0
    given, of_less, near = np.zeros(len(key)), np.ones(len(key)), stays
    for shorter, own, n, retained in reversed(steps):
        given, of_less, near = given[shorter], of_less[shorter], near[shorter]
        given = np.where(retained, (n + smoothing * given) / (own + smoothing), given)
        of_less = np.where(retained, smoothing * of_less / (own + smoothing), of_less)
    return given, of_less, near


def learnt(docs: DataFrame, depth: int, fewest: int, gain: float, smoothing: float) -> DataFrame:
    """``word, key, n, times, p`` of ``docs (text, training)``: :func:`count_all` with :func:`probabilities`.

    Contexts of over ``_NEAR`` bytes are decided in the tasks that hold all codes with
    the same nearest bytes, a group of them at a time; only the shorter ones, far
    fewer, are tables of their own. A word has no ``p``.
    """

    def decide(word: bool, key: np.ndarray, n: np.ndarray, times: np.ndarray) -> dict:
        given, of_less, stays = np.zeros(len(key)), np.zeros(len(key)), np.zeros(len(key), dtype=bool)
        if not word:
            given, of_less, stays = _far(key, n, depth, fewest, gain, smoothing)
        counts = {"word": pa.repeat(word, len(key)), "key": key, "n": n, "times": times}
        return counts | {"given": given, "of_less": of_less, "stays": stays}

    schema = "word boolean, key bigint, n bigint, times bigint, given double, of_less double, stays boolean"
    counted = stored_texts(_counted(docs, depth, schema, decide), "counted")
    near = min(depth, _NEAR)
    code = F.col("key").bitwiseAND((1 << (8 * (near + 1))) - 1)
    level = counted.where("not word").groupBy(code.alias("key")).agg(
        F.sum("n").alias("n"), F.max("stays").alias("stays")
    )
    less = probabilities(level, near, fewest, gain, smoothing).select(F.col("key").alias("suffix"), "p")
    less = stored(less, "near")
    joined = counted.join(less, (code == F.col("suffix")) & ~F.col("word"), "left")
    p = F.col("given") + F.col("of_less") * F.col("p")
    found = stored(joined.select("word", "key", "n", "times", p.alias("p")), "learnt")
    discard(counted, less)
    return found


def probabilities(grams: DataFrame, depth: int, fewest: int, gain: float, smoothing: float) -> DataFrame:
    """``key, p`` for every row of ``grams (key, n, stays)``: the tree's probability of the last byte after its context.

    A context is retained if it occurs ``fewest`` times and its next-byte distribution
    diverges from that of the context one byte shorter: the Kullback-Leibler divergence
    times the occurrences is at least ``gain`` (the logarithm of a likelihood ratio).
    Both are evidence, not shares of the corpus. The suffixes of a retained context stay
    too. Distributions are smoothed towards that of the shorter context, which
    weighs ``smoothing`` occurrences, and at the root towards equal probability of all
    bytes. A row with ``n`` of 0 was not learnt from and only gets its probability; the
    context of one that ``stays`` is retained.

    Every length is a table of its codes. From the longest to the shortest, a table is
    dealt by the shorter context, at most 65,536 codes each, where all sums lie;
    then probabilities go from the shortest to the longest by joins.
    """
    level = grams.select("key", "n", "stays")
    levels: list[DataFrame] = []
    for length in range(depth, 0, -1):
        mask = (1 << (8 * length)) - 1
        level = level.withColumns(
            {
                "next": F.col("key").bitwiseAND(255),
                "context": F.shiftright("key", 8),
                "parent": F.shiftright("key", 8).bitwiseAND(mask >> 8),
            }
        )
        follows = F.sum("n").over(Window.partitionBy("parent", "next"))
        level = level.withColumn("before", F.try_divide(follows, F.sum("n").over(Window.partitionBy("parent"))))
        own = Window.partitionBy("parent", "context")
        level = level.withColumn("all", F.sum("n").over(own))
        ratio = F.try_divide(F.try_divide(F.col("n"), F.col("all")), F.col("before"))
        told = F.when(F.col("n") > 0, F.col("n") * F.log(ratio)).otherwise(0.0)
        divergent = (F.col("all") >= max(fewest, 1)) & (F.sum(told).over(own) >= gain)
        level = level.withColumn("retained", F.max("stays").over(own) | divergent)
        levels.append(stored(level.select("key", "n", "all", "retained"), "level"))
        level = levels[-1].groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(
            F.sum("n").alias("n"), F.max("retained").alias("stays")
        )
    level = stored(level, "level")
    total = level.agg(F.sum("n")).first()[0] or 0
    # Every byte, seen or not, begins with the same share.
    found = level.select("key", ((F.col("n") + 1.0) / (total + 256.0)).alias("p"))
    for length, level in enumerate(reversed(levels), 1):
        shorter = found.select(F.col("key").alias("suffix"), F.col("p").alias("less"))
        mixed = (F.col("n") + smoothing * F.col("less")) / (F.col("all") + smoothing)
        level = level.join(shorter, F.col("key").bitwiseAND((1 << (8 * length)) - 1) == F.col("suffix"))
        found = level.select("key", F.when(F.col("retained"), mixed).otherwise(F.col("less")).alias("p"))
    return found


def grow(grams: DataFrame, depth: int, share: float, fewest: int, gain: float, smoothing: float) -> Tree:
    """The tree of ``grams (key, n)`` as a whole on the driver: for small corpora, or if ``share`` bounds it.

    With a ``share`` of 0 and ``gain`` over the number of positions it is the tree
    of :func:`probabilities`. A context is a candidate if it makes up ``share`` of all positions (so at most
    ``1 / share`` per length are, whatever the corpus) and occurs ``fewest`` times. It is
    retained if its next-byte distribution diverges from that of the context one byte
    shorter: Kullback-Leibler divergence times the context's share at least ``gain``.
    The suffixes of a retained context stay too. Distributions are smoothed towards that of
    the shorter context, which weighs ``smoothing`` occurrences, and at the root
    towards equal probability of all bytes.
    """
    level = stored(
        grams.select(F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(255).alias("next"), "n"),
        "level",
    )
    levels = [level]
    for length in range(depth - 1, -1, -1):
        mask = (1 << (8 * length)) - 1
        level = level.groupBy(F.col("context").bitwiseAND(mask).alias("context"), "next").agg(F.sum("n").alias("n"))
        level = stored(level, "level")
        levels.insert(0, level)
    total = levels[0].agg(F.sum("n")).first()[0] or 0
    least = max(fewest, math.ceil(share * total))

    def shares(table: DataFrame) -> DataFrame:
        sums = table.groupBy("context").agg(F.sum("n").alias("all")).where(F.col("all") >= least)
        return table.join(sums, "context")

    rows: list[pd.DataFrame] = []
    kept = np.empty(0, dtype=np.int64)
    for length in range(depth, 0, -1):
        mask = (1 << (8 * (length - 1))) - 1
        shorter = shares(levels[length - 1]).select(
            F.col("context").alias("parent"), "next", (F.col("n") / F.col("all")).alias("before")
        )
        own = shares(levels[length]).withColumn("parent", F.col("context").bitwiseAND(mask))
        # Contexts that reach past the beginning would hold the end inside; they are ordinary contexts.
        bits = F.sum(F.col("n") * F.log(F.col("n") / F.col("all") / F.col("before"))) / max(total, 1)
        divergent = (
            own.join(shorter, ["parent", "next"]).groupBy("context").agg(bits.alias("gain"))
            .where(F.col("gain") >= gain).select("context")
        )
        found = divergent.toArrow()["context"].to_numpy()
        kept = np.union1d(found, kept & ((1 << (8 * length)) - 1))
        rows.insert(0, _rows_of(levels[length], kept))
    rows.insert(0, levels[0].select("context", "next", "n").toArrow().to_pandas())
    return _automaton(rows, depth, smoothing)


def _rows_of(level: DataFrame, contexts: np.ndarray) -> pd.DataFrame:
    wanted = level.sparkSession.createDataFrame(pd.DataFrame({"context": contexts.astype(np.int64)}), "context bigint")
    return level.join(F.broadcast(wanted), "context").select("context", "next", "n").toArrow().to_pandas()


def _automaton(rows: list[pd.DataFrame], depth: int, smoothing: float) -> Tree:
    """Number all retained contexts and their prefixes, with transitions and distributions."""
    seen = np.unique(np.concatenate([rows[0]["next"].to_numpy(), [END, 32]])).astype(np.int64)
    symbols = np.full(256, len(seen), dtype=np.int64)
    symbols[seen] = np.arange(len(seen))
    columns = len(seen) + 1

    retained = [np.unique(r["context"].to_numpy()).astype(np.int64) for r in rows]
    retained[0] = np.zeros(1, dtype=np.int64)
    contexts = list(retained)
    for length in range(depth, 0, -1):  # a context's prefix must be a context to step from
        contexts[length - 1] = np.union1d(contexts[length - 1], contexts[length] >> 8)
    first = np.cumsum([0, *map(len, contexts)])

    def number(codes: np.ndarray, length: int) -> np.ndarray:
        place = np.searchsorted(contexts[length], codes)
        inside = place < len(contexts[length])
        inside[inside] = contexts[length][place[inside]] == codes[inside]
        return np.where(inside, first[length] + place, -1)

    size = int(first[-1])
    following = np.zeros((size, columns), dtype=np.int32)
    probability = np.empty((size, columns))
    for length in range(depth + 1):
        codes = contexts[length]
        own = slice(first[length], first[length + 1])
        if length:
            shorter = np.full(len(codes), -1, dtype=np.int64)
            for less in range(length - 1, -1, -1):
                at = number(codes & ((1 << (8 * less)) - 1), less)
                shorter = np.where(shorter < 0, at, shorter)
            following[own] = following[shorter]
            probability[own] = probability[shorter]
        counts = np.zeros((len(codes), columns))
        table = rows[length]
        row = number(table["context"].to_numpy().astype(np.int64), length) - first[length]
        if len(table):
            np.add.at(counts, (row, symbols[table["next"].to_numpy()]), table["n"].to_numpy())
        if not length:
            # Every byte, seen or not, begins with the same share.
            probability[own] = 1 / 256
        counted = counts.sum(axis=1, keepdims=True)
        weight = 256.0 if not length else smoothing
        probability[own] = (counts + weight * probability[own]) / (counted + weight)
        if length < depth:
            longer = contexts[length + 1]
            at = number(longer >> 8, length)
            following[at, symbols[longer & 255]] = first[length + 1] + np.arange(len(longer))
    return Tree(depth, symbols, following, np.log10(probability).astype(np.float32), sum(map(len, retained)))


def _frequent(table: DataFrame, least: int, value: Column) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys that occur ``least`` times, with their values."""
    found = table.where(F.col("times") >= least).select("key", value.alias("value")).toArrow()
    keys = found["key"].to_numpy()
    order = np.argsort(keys)
    return keys[order], found["value"].to_numpy()[order]


def _looked_up(
    frequent: tuple[np.ndarray, np.ndarray], keys: np.ndarray, owner: np.ndarray
) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Of each of ``keys`` the value or 0, whether it is frequent; and ``owner, key, times`` of those that aren't."""
    known, value = frequent
    unique, which = np.unique(keys, return_inverse=True)
    place = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
    inside = known[place] == unique if len(known) else np.zeros(len(unique), dtype=bool)
    values = np.zeros(len(unique))
    values[inside] = value[place[inside]]
    inside = inside[which]
    pairs, times = np.unique(owner[~inside] * len(unique) + which[~inside], return_counts=True)
    return values[which], inside, (pairs // len(unique), unique[pairs % len(unique)], times)


def _rare_sums(rare: DataFrame, table: DataFrame) -> DataFrame:
    """``block, word, owner, known, value``: of owners in a block the sums over their rare keys, in several parts.

    ``rare (block, word, dealt, owner, key, times)`` holds lists; ``table (word, key, value)``
    a row a key. The table's keys of a group come first, then all lists with keys of that
    group, one after the other, so no key has too many of them.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, key, value = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("word", "key", "value"))
            for own in (True, False):
                if (word == own).any():
                    lists = _lists(key[word == own] % _DEALT, key=key[word == own], value=value[word == own])
                    yield from _cut(pa.RecordBatch.from_pydict({"word": pa.repeat(own, len(lists["dealt"]))} | lists))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            made = []
            for (block, word), parts in sums.items():
                owner, known, value = (np.concatenate(column) for column in zip(*parts, strict=True))
                owner, which = np.unique(owner, return_inverse=True)
                made.append((block, word, owner, np.bincount(which, known), np.bincount(which, value)))
            sums.clear()
            block, word, owner, known, value = zip(*made, strict=True)
            sizes = np.array([len(o) for o in owner])
            owner, known, value = map(np.concatenate, (owner, known, value))
            lists = _packed(sizes, owner=owner, known=known, value=value)
            return pa.RecordBatch.from_pydict({"block": pa.array(block), "word": pa.array(word)} | lists)

        nothing = (np.empty(0, dtype=np.int64), np.empty(0))
        group, parts, keys, values, sums, size = None, [], None, None, {}, 0
        plain, lists = ("word", "dealt", "block"), ("key", "value", "owner", "times")
        for batch in batches:
            for word, dealt, block, key, value, owner, times in _rows(batch, plain, lists):
                if (word, dealt) != group:
                    group, parts, keys = (word, dealt), [nothing], None
                if block is None:
                    parts.append((key, value))
                    continue
                if keys is None:
                    keys, values = map(np.concatenate, zip(*parts, strict=True))
                    order = np.argsort(keys)
                    keys, values = keys[order], values[order]
                place = np.searchsorted(keys, key)
                inside = np.append(keys, 0)[place] == key
                inside &= place < len(keys)
                found = np.where(inside, np.append(values, 0.0)[place], _UNKNOWN)
                sums.setdefault((block, word), []).append((owner, times * inside, times * found))
                size += len(key)
                if size > _POOL:
                    yield flush()
                    size = 0
        if sums:
            yield flush()

    lists = table.mapInArrow(listed, "word boolean, dealt int, key binary, value binary")
    both = rare.unionByName(lists, allowMissingColumns=True).select(
        "word", "dealt", "block", "key", "value", "owner", "times"
    )
    both = both.repartition("word", "dealt").sortWithinPartitions("word", "dealt", F.col("block").asc_nulls_first())
    return both.mapInArrow(add, "block bigint, word boolean, owner binary, known binary, value binary")


def score_documents(
    docs: DataFrame,
    training: Column,
    depth: int = 6,
    fewest: int = 10,
    gain: float = 3.0,
    smoothing: float = 32.0,
    frequent_share: float = 1e-6,
    frequent_grams: float = 1e-7,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of ``docs (doc_id, text)``.

    Learns from all whole texts where ``training`` holds. Tokens are the words of a
    text, A-Z lower-cased, then one end. ``base_score`` is the log10 probability under
    the unigrams of the training tokens, half a count added to each; ``n_known`` tokens
    occur among them. ``score`` is the log10 probability under the suffix tree (see
    :func:`probabilities` for its parameters; ``depth`` is 6 at most, as a context and the
    next byte are counted as one 64-bit number).

    Counts of words and probabilities of contexts with their next byte grow with the
    corpus and are joined. Documents travel to that join in blocks of some megabytes, a list of
    rare keys for each group of keys, and not a row for each. Only words that make up ``frequent_share`` of the training
    tokens, and contexts with a byte that make up ``frequent_grams`` of all positions, at
    most one over that each, are broadcast; those of a document that are rarer go
    through the join, so no key has many rows there.

    A null text is empty: one token, the end. Repeated rows are scored apart. With no
    training rows every word is unknown and all bytes are equally likely. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    marked = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("training"))
    counted = learnt(marked, depth, fewest, gain, smoothing)
    words = counted.where("word").select("key", "times", F.log10(F.col("n") + 0.5).alias("value"))
    n_all, distinct = counted.where("word").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    grams = counted.where("not word")
    positions = grams.agg(F.sum("times")).first()[0] or 0
    grams = grams.select("key", "times", F.log10("p").alias("value"))
    common = max(2, math.ceil(frequent_share * n_all))
    usual = max(2, math.ceil(frequent_grams * positions))
    norm = math.log10(n_all + 0.5 * (distinct + 1))
    value = F.col("value")
    shared = spark.sparkContext.broadcast((_frequent(words, common, value), _frequent(grams, usual, value.cast("float"))))
    identifier = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block bigint, place int, doc_id {identifier}, training boolean, n bigint, known bigint, base double, score double"
    schema += ", word boolean, dealt int, owner binary, key binary, times binary"
    own = {"block": pa.int64(), "place": pa.int32(), "doc_id": None, "training": pa.bool_(), "n": pa.int64()}
    own |= {"known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "word": pa.bool_(), "dealt": pa.int32()}
    own |= {"owner": pa.binary(), "key": pa.binary(), "times": pa.binary()}

    def framed(columns: dict, size: int, identifiers: pa.DataType) -> pa.RecordBatch:
        filled = {name: pa.nulls(size, kind or identifiers) for name, kind in own.items()} | columns
        return pa.RecordBatch.from_pydict(filled)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = shared.value
        block, place = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0, 0
        rare: dict[bool, list] = {True: [], False: []}

        def flush(identifiers: pa.DataType | None) -> Iterator[pa.RecordBatch]:
            for word, kept in rare.items():
                if kept:
                    owner, key, times = (np.concatenate(column) for column in zip(*kept, strict=True))
                    kept.clear()
                    lists = _lists(key % _DEALT, owner=owner, key=key, times=times)
                    size = len(lists["dealt"])
                    columns = {"block": pa.repeat(block, size), "word": pa.repeat(word, size)} | lists
                    yield from _cut(framed(columns, size, identifiers))

        identifiers = None
        for batch in batches:
            identifiers = batch.schema.field("doc_id").type
            for first, texts in in_chunks(batch.column("text").to_pylist(), 1_000_000):
                data, predicted, starts, hashes, count = _laid_out(texts, depth)
                each = np.arange(len(texts))
                length = np.add.reduceat(predicted.astype(np.int64), starts)
                chance, _, rare_grams = _looked_up(grams, _codes(data, predicted, depth), np.repeat(each, length))
                tokens = np.concatenate([hashes, np.full(len(texts), _END_HASH)]).view(np.int64)
                owner = np.concatenate([np.repeat(each, count), each])
                weight, inside, rare_words = _looked_up(words, tokens, owner)
                rows = {
                    "block": pa.repeat(block, len(texts)),
                    "place": (place + each).astype(np.int32),
                    "doc_id": batch.column("doc_id").slice(first, len(texts)),
                    "training": batch.column("training").slice(first, len(texts)),
                    "n": count + 1,
                    "known": np.bincount(owner, inside, len(texts)).astype(np.int64),
                    "base": np.bincount(owner, weight, len(texts)),
                    "score": np.add.reduceat(chance, np.cumsum(length) - length),
                }
                yield framed(rows, len(texts), identifiers)
                for word, (who, key, times) in ((True, rare_words), (False, rare_grams)):
                    if len(who):
                        rare[word].append((place + who, key, times))
                place += len(texts)
                if place > _FRAME or sum(len(k) for kept in rare.values() for _, k, _ in kept) > _PAIRS:
                    yield from flush(identifiers)
                    block, place = block + 1, 0
        yield from flush(identifiers)

    scored = stored_texts(marked.mapInArrow(score, schema), "scored")
    table = words.where(F.col("times") < common).select(F.lit(True).alias("word"), "key", "value").unionByName(
        grams.where(F.col("times") < usual).select(F.lit(False).alias("word"), "key", "value")
    )
    sums = _rare_sums(scored.where("place is null").select("block", "word", "dealt", "owner", "key", "times"), table)
    sums = stored_texts(sums, "sums")

    def complete(rows: pa.Table, parts: pa.Table) -> pa.Table:
        place = rows["place"].to_numpy()
        added = np.zeros((3, len(place)))
        where = np.empty(place.max(initial=-1) + 1, dtype=np.int64)
        where[place] = np.arange(len(place))
        for part in parts.combine_chunks().to_batches():
            for word, owner, known, of_all in _rows(part, ("word",), ("owner", "known", "value")):
                np.add.at(added[2 * (not word)], where[owner], of_all)
                if word:
                    np.add.at(added[1], where[owner], known)
        base, known, chance = added
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "training": rows["training"],
                "n": rows["n"],
                "known": rows["known"].to_numpy() + known.astype(np.int64),
                "base": rows["base"].to_numpy() + base,
                "score": rows["score"].to_numpy() + chance,
            }
        )

    schema = f"doc_id {identifier}, training boolean, n bigint, known bigint, base double, score double"
    rows = scored.where("place is not null").drop("word", "dealt", "owner", "key", "times")
    return rows.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(complete, schema).select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n") * F.lit(norm)).alias("base_score"),
        "score",
    )
