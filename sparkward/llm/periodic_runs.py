"""Periodic runs of words, found online by catching squares behind blocks of dyadic length."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.llm.common import in_chunks

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, count: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    factors = np.full(max(count, 1), np.uint64(base))
    factors[0] = 1
    return np.multiply.accumulate(factors)


def _spread(x: np.ndarray) -> np.ndarray:
    """A number of 64 mixed bits for each integer."""
    x = x.astype(np.int64).view(np.uint64) + np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Catchers:
    """The squares of a growing sequence of words, merged into maximal stretches.

    On each level ``b = 1, 2, 4, ...`` the completed aligned blocks of ``b`` words are
    catchers: a block lies wholly inside the left half of every square with a period from
    ``2b - 1`` that is centred behind it. Each appended word completes one window of ``b``
    words per level and compares it with the two blocks that begin ``2b - 1`` to ``4b - 2``
    words before it, so a word costs two comparisons a level. Where they agree, the
    suffixes before and behind are compared; agreement over a whole period is a square,
    and squares of one period that overlap are one stretch. Stretches that reach the end
    of what is known go on when words are appended.

    Windows are compared by hashes, so :meth:`runs` compares the words of every stretch it
    returns, and cuts one where a hash erred. Equal windows always have equal hashes, so nothing
    is missed.
    """

    def __init__(self, longest_period: int | None = None) -> None:
        self.longest_period = longest_period
        self.words = np.empty(0, dtype=np.int64)
        self._sums = np.zeros(1, dtype=np.uint64)  # of the first i words, each by its power of the base
        self._inverse = np.ones(1, dtype=np.uint64)
        self._found = np.empty((3, 0), dtype=np.int64)  # period, start, end

    def append(self, words: np.ndarray) -> None:
        """Append any number of words (integers; equal ones are equal words)."""
        before, n = len(self.words), len(self.words) + len(words)
        if n == before:
            return
        self.words = np.concatenate([self.words, np.asarray(words, dtype=np.int64)])
        powers = _powers(_BASE, n)[before:]
        self._sums = np.append(self._sums, self._sums[-1] + np.cumsum(_spread(self.words[before:]) * powers))
        self._inverse = _powers(_INVERSE, n + 1)

        period, start, end = self._found
        growing = end == before
        longer = self._agreeing(end[growing] - period[growing], end[growing], 1)
        end[growing] += longer
        found = [self._found[:, ~growing | (end == n) | (end - start >= 2 * period)]]
        block = 1
        while 2 * block - 1 <= min(n // 2 + 1, self.longest_period or n):
            found.append(self._caught(block, before))
            block *= 2
        merged = np.concatenate(found, axis=1)
        merged = merged[:, np.lexsort((-merged[2], merged[1], merged[0]))]
        new = np.ones(merged.shape[1], dtype=bool)
        new[1:] = (merged[:2, 1:] != merged[:2, :-1]).any(axis=0)
        self._found = merged[:, new]

    def _caught(self, block: int, before: int) -> np.ndarray:
        """Stretches through windows of ``block`` words that were completed behind ``before``."""
        n = len(self.words)
        first = max(0, (before - block + 1 - (4 * block - 2)) // block)
        blocks = -(-(n - block + 1 - (2 * block - 1)) // block) - first
        if blocks <= 0:
            return np.empty((3, 0), dtype=np.int64)
        begin = first * block
        hashes = (self._sums[begin + block :] - self._sums[begin : n - block + 1]) * self._inverse[begin : n - block + 1]
        hashes = np.append(hashes, np.zeros(4 * block, dtype=np.uint64))
        own = hashes[: blocks * block : block, None]
        periods, starts = [], []
        for shift in (2 * block - 1, 3 * block - 1):
            windows = hashes[shift : shift + blocks * block]
            rows = len(windows) // block
            place = np.flatnonzero(windows[: rows * block].reshape(rows, block) == own[:rows])
            periods.append(shift + place % block)
            starts.append(begin + place // block * block)
        period, start = np.concatenate(periods), np.concatenate(starts)
        known = start + period + block <= n
        if self.longest_period is not None:
            known &= period <= self.longest_period
        period, start = period[known], start[known]
        order = np.lexsort((start, period))
        period, start = period[order], start[order]
        # Neighbouring blocks that agree at one distance belong to one stretch.
        head = np.ones(len(start), dtype=bool)
        head[1:] = (np.diff(period) != 0) | (np.diff(start) != block)
        last = np.append(head[1:], True)[: len(start)]
        period, end, start = period[head], start[last] + block, start[head]
        start = start - self._agreeing(start, start + period, -1)
        end = end + period + self._agreeing(end, end + period, 1)
        square = (end - start >= 2 * period) | (end == n)
        return np.stack([period[square], start[square], end[square]])

    def _agreeing(self, left: np.ndarray, right: np.ndarray, way: int) -> np.ndarray:
        """How many words from ``left`` and ``right`` on (or, if ``way`` is -1, before them) agree."""
        n = len(self.words)
        length = np.zeros(len(left), dtype=np.int64)
        step = 1 << n.bit_length() if len(left) else 0
        while step:
            a, b = (left + length, right + length) if way > 0 else (left - length - step, right - length - step)
            inside = (a >= 0) & (b + step <= n)
            a, b = a[inside], b[inside]
            same = self._hash(a, step) == self._hash(b, step)
            length[inside] += step * same
            step >>= 1
        return length

    def _hash(self, start: np.ndarray, length: int) -> np.ndarray:
        return (self._sums[start + length] - self._sums[start]) * self._inverse[start]

    def runs(self, exponent: int = 2, least: int = 1) -> np.ndarray:
        """Rows ``start, length, period`` of all runs of ``exponent`` periods (2 at least) and ``least`` words.

        By start, then period. A run has its smallest period and can't be extended.
        """
        period, start, end = self._found
        wanted = end - start >= np.maximum(least, max(exponent, 2) * period)
        all_of = np.stack([start, end, period], axis=1)[wanted]
        # A stretch over two periods or more that has a smaller one is also a stretch of that.
        all_of = all_of[np.lexsort((all_of[:, 2], all_of[:, 1], all_of[:, 0]))]
        first = np.ones(len(all_of), dtype=bool)
        first[1:] = (all_of[1:, :2] != all_of[:-1, :2]).any(axis=1)
        found = all_of[first]
        if not all(self._true(*row) for row in found.tolist()):
            found = self._mended(all_of, exponent, least)
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        return np.stack([found[:, 0], found[:, 1] - found[:, 0], found[:, 2]], axis=1)

    def _true(self, start: int, end: int, period: int) -> bool:
        return np.array_equal(self.words[start : end - period], self.words[start + period : end])

    def _mended(self, stretches: np.ndarray, exponent: int, least: int) -> np.ndarray:
        """The true parts of stretches of which some rest on a hash that erred."""
        whole: dict[tuple[int, int], int] = {}
        for start, end, period in stretches.tolist():
            differs = np.flatnonzero(self.words[start : end - period] != self.words[start + period : end])
            at = start
            for stop in [*(start + differs).tolist(), end - period]:
                if stop + period - at >= max(least, max(exponent, 2) * period):
                    whole[at, stop + period] = min(period, whole.get((at, stop + period), period))
                at = stop + 1
        return np.array([(s, e, p) for (s, e), p in whole.items()], dtype=np.int64).reshape(-1, 3)


def runs_of_texts(texts: Sequence[Sequence], exponent: int, least: int) -> list[np.ndarray]:
    """Per text, a list of words, the runs of :meth:`Catchers.runs`.

    Texts of similar length form one sequence, each ended by a word of its own that occurs
    nowhere else, so no run crosses a text's end and short ones don't pay for the periods
    of long ones.
    """
    result = [np.empty((0, 3), dtype=np.int64)] * len(texts)
    numbers = {word: i for i, word in enumerate({word for text in texts for word in text})}
    classes: dict[int, list[int]] = {}
    for i, text in enumerate(texts):
        if len(text) >= max(least, 2):
            classes.setdefault(len(text).bit_length(), []).append(i)
    for bits, members in classes.items():
        lengths = np.array([len(texts[i]) + 1 for i in members])
        starts = np.cumsum(lengths) - lengths
        words = np.empty(int(lengths.sum()), dtype=np.int64)
        for k, i in enumerate(members):
            words[starts[k] : starts[k] + lengths[k] - 1] = [numbers[word] for word in texts[i]]
            words[starts[k] + lengths[k] - 1] = -1 - k
        catchers = Catchers(max(1, (1 << bits) // max(exponent, 2)))
        catchers.append(words)
        runs = catchers.runs(exponent, least)
        owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
        runs[:, 0] -= starts[owner]
        for k in np.unique(owner).tolist():
            result[members[k]] = runs[owner == k]
    return result


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run holds behind its first period."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:n]) == 0


def find_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs (doc_id, text)``.

    Words are runs of other than white space, numbered from 0. A run is a stretch of
    words with smallest period ``q`` (words ``q`` apart are identical), of ``exponent * q`` and
    ``least`` words at least, that no neighbour extends. ``runs`` lists
    ``start, length, period`` by start, then period; ``collapsed`` is the text's words joined by
    one space, without those that a run holds behind its first ``q`` words.

    Rows are independent: no shuffle, and a task holds some megabytes of texts at a time, or
    one text that is longer. A null, empty or blank text has no words and no runs and collapses to the
    empty text. Repeated rows are rows of their own, null identifiers ordinary values. Other
    columns are ignored; an empty table gives an empty result.
    """
    identifier = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, texts in in_chunks(batch["text"]):
                words = [text.split() for text in texts]
                found = runs_of_texts(words, exponent, least)
                collapsed = []
                for own, runs in zip(words, found, strict=True):
                    if len(runs):
                        own = [own[i] for i in np.flatnonzero(kept_words(len(own), runs)).tolist()]
                    collapsed.append(b" ".join(own))
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[first : first + len(texts)].to_numpy(),
                        "n_words": [len(own) for own in words],
                        "start": [runs[:, 0] for runs in found],
                        "length": [runs[:, 1] for runs in found],
                        "period": [runs[:, 2] for runs in found],
                        "collapsed": collapsed,
                    }
                )

    schema = f"doc_id {identifier}, n_words bigint, start array<bigint>, length array<bigint>, period array<bigint>"
    found = docs.select("doc_id", "text").mapInPandas(find, schema + ", collapsed binary")
    return found.select(
        "doc_id",
        "n_words",
        F.arrays_zip("start", "length", "period").alias("runs"),
        F.col("collapsed").cast("string").alias("collapsed"),
    )
