"""As few token sequences as possible, by a grouping genetic algorithm over islands."""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.llm.common import stored, stored_texts
from sparkward.llm.packing import TOKENIZER, ids_by

Bins = list[list[int]]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int, with_ids: bool) -> DataFrame:
    """``doc_id, row, piece, start, length, ids_crc32`` (and ``ids``) of ``docs (doc_id, text)``; ``row`` tells pieces apart.

    Only documents above ``capacity`` are cut: the rest comes first, then whole sequences.
    """
    identifier = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {identifier}, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"][: 6 + with_ids]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_text = ids_by(tokenizer)
        row = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode_text(text or ""), end], dtype="<u4")
                start, stop = 0, len(ids) % capacity or capacity
                while start < len(ids):
                    part = ids[start:stop]
                    found = (doc_id, row, max(0, -(-start // capacity)), start, len(part), zlib.crc32(part.tobytes()))
                    rows.append((*found, part.astype(np.int32)) if with_ids else found)
                    start, stop, row = stop, stop + capacity, row + 1
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": batch["doc_id"].dtype})

    return docs.select("doc_id", "text").mapInPandas(cut, schema + ", ids array<int>" * with_ids)


def best_fit(bins: Bins, loose: Sequence[int], capacity: int) -> Bins:
    """Put ``loose``, in their order, each into the fullest bin that has room, or into a new one."""
    open_rooms, by_room = 0, [[] for _ in range(capacity + 1)]
    for i, members in enumerate(bins):
        room = capacity - sum(members)
        if room:
            by_room[room].append(i)
            open_rooms |= 1 << room
    for size in loose:
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            place = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
            bins[place].append(size)
        else:
            room, place = capacity, len(bins)
            bins.append([size])
        if room > size:
            by_room[room - size].append(place)
            open_rooms |= 1 << (room - size)
    return bins


def fewest_bins(stock: Sequence[int], capacity: int) -> int:
    """A number of bins that no packing beats; ``stock[s]`` pieces have length ``s``.

    For every ``a`` up to half a bin: pieces above ``capacity - a`` stand alone, those above half can't
    meet, and what is from ``a`` to half must fit beside the latter or into more bins.
    """
    count = np.array(stock, dtype=np.int64)
    words = count * np.arange(len(count))
    n_to, words_to = np.cumsum(count), np.cumsum(words)
    half = capacity // 2
    least = -(-int(words_to[-1]) // capacity)
    for a in range(half + 1):
        alone = int(n_to[-1] - n_to[capacity - a])
        single = int(n_to[capacity - a] - n_to[half])
        small = int(words_to[half] - (words_to[a - 1] if a else 0))
        room = single * capacity - int(words_to[capacity - a] - words_to[half])
        least = max(least, alone + single + max(0, -(-(small - room) // capacity)))
    return least


def cross(giver: Bins, taker: Bins, stock: Sequence[int], capacity: int, drawn: random.Random) -> Bins:
    """Whole well-filled bins of ``giver`` go into ``taker``.

    Bins of the taker that hold what is now double are dissolved, and so are a few of its
    emptiest; what they held beside is placed by best fit, longest first.
    """
    by_fill = sorted(giver, key=sum, reverse=True)
    share = drawn.uniform(0.2, 0.8)
    injected = [bin_ for bin_ in by_fill[: len(by_fill) // 2 + 1] if drawn.random() < share]
    left = list(stock)
    for bin_ in injected:
        for size in bin_:
            left[size] -= 1
    bins = [[*bin_] for bin_ in injected]
    spared = max(0, len(taker) - 1 - drawn.randrange(1 + len(taker) // 20))
    for bin_ in sorted(taker, key=sum, reverse=True)[:spared]:
        for place, size in enumerate(bin_):
            if not left[size]:
                for other in bin_[:place]:
                    left[other] += 1
                break
            left[size] -= 1
        else:
            bins.append([*bin_])
    loose = [size for size in range(len(left) - 1, 0, -1) for _ in range(left[size])]
    if drawn.random() < 0.5:  # an order near to falling finds other fits
        loose.sort(key=lambda size: -size * drawn.uniform(0.9, 1.0))
    return best_fit(bins, loose, capacity)


def fitness(bins: Bins) -> tuple[int, int]:
    """Less is better: fewer bins, then room gathered in few of them."""
    return len(bins), -sum(sum(bin_) ** 2 for bin_ in bins)


def evolve(
    stock: Sequence[int], elites: list[Bins], capacity: int, drawn: random.Random, generations: int, population: int
) -> list[Bins]:
    """The best two of a population that begins with ``elites``; ends when no packing can have fewer bins."""
    falling = [size for size in range(len(stock) - 1, 0, -1) for _ in range(stock[size])]
    living = list(elites)
    if not living:
        living.append(best_fit([], falling, capacity))
    least = fewest_bins(stock, capacity)
    while len(living) < population and min(map(len, living)) > least:
        order = sorted(falling, key=lambda size: -size * drawn.uniform(0.7, 1.0))
        living.append(best_fit([], order, capacity))
    for _ in range(generations if len(living) > 1 else 0):
        living.sort(key=fitness)
        if len(living[0]) <= least:
            break
        giver, taker = drawn.sample(living, 2)
        child = cross(giver, taker, stock, capacity, drawn)
        if fitness(child) <= fitness(living[-1]):
            living[-1] = child
    return sorted(living, key=fitness)[:2]


def _flat(bins: Bins) -> list[int]:
    """Bins one after the other, each ended by a 0."""
    return [size for bin_ in bins for size in (*sorted(bin_, reverse=True), 0)]


def _bins(flat: Sequence[int]) -> Bins:
    flat = np.asarray(flat, dtype=np.int64)
    ends = np.flatnonzero(flat == 0)
    return [part[part > 0].tolist() for part in np.split(flat, ends[:-1] + 1)] if len(ends) else []


def _solved(
    sliced: DataFrame, capacity: int, islands: int, epochs: int, generations: int, population: int, seed: int, tasks: int
) -> DataFrame:
    """``slice, solution``: the best packing of each slice of ``sliced (slice, length)``.

    Pieces of one length are alike, so an island holds its slice as a count per length.
    After each epoch the best packings of an island go on to the next island of the
    same slice. Slices that can't be packed better take no part in later epochs.
    """
    counts = sliced.groupBy("slice", "length").agg(F.count("*").alias("n"))
    stocks = counts.groupBy("slice").agg(
        F.collect_list("length").alias("lengths"), F.collect_list("n").alias("counts")
    )
    state = stocks.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn(
        "elites", F.array().cast("array<array<int>>")
    )
    schema = "slice bigint, island int, lengths array<bigint>, counts array<bigint>, elites array<array<int>>"
    done: list[DataFrame] = []
    for epoch in range(epochs):

        def advance(batches: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for row in batch.itertuples(index=False):
                    stock = [0] * (capacity + 1)
                    for length, n in zip(row.lengths, row.counts, strict=True):
                        stock[length] = int(n)
                    drawn = random.Random(f"{seed}/{epoch}/{row.slice}/{row.island}")
                    elites = [_bins(flat) for flat in row.elites]
                    best = evolve(stock, elites, capacity, drawn, generations, population)
                    optimal = len(best[0]) <= fewest_bins(stock, capacity)
                    rows.append(
                        (row.slice, row.island, row.lengths, row.counts, [_flat(b) for b in best], *fitness(best[0]), optimal)
                    )
                names = ["slice", "island", "lengths", "counts", "elites", "bins", "spread", "optimal"]
                yield pd.DataFrame(rows, columns=names)

        # An island is much work in few bytes, so tasks are given by number: one island each, up to some thousands.
        dealt = state.repartition(min(10_000, tasks), "slice", "island").select("slice", "island", "lengths", "counts", "elites")
        state = stored(dealt.mapInPandas(advance, schema + ", bins bigint, spread bigint, optimal boolean"), "islands")
        best = state.groupBy("slice").agg(
            F.min_by(F.col("elites")[0], F.struct("bins", "spread", "island")).alias("solution"),
            F.max("optimal").alias("optimal"),
        )
        best = stored(best, "best")
        last = epoch + 1 == epochs
        done.append(best.select("slice", "solution") if last else best.where("optimal").select("slice", "solution"))
        open_slices = best.where("not optimal").select("slice")
        if last or open_slices.isEmpty():
            break
        state = state.join(open_slices, "slice", "left_semi")
        migrants = state.select(
            "slice", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elites").alias("migrants")
        )
        state = state.join(migrants, ["slice", "island"]).withColumn("elites", F.concat("elites", "migrants"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def pack_fewest(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    capacity: int = 2048,
    end: int = 0,
    with_ids: bool = False,
    pieces_per_slice: int = 20_000,
    islands: int = 3,
    epochs: int = 3,
    generations: int = 8,
    population: int = 4,
    reopened: int = 8,
) -> DataFrame:
    """The pieces of ``docs (doc_id, text)`` with ``sequence_id`` and ``offset``, in few sequences.

    A document is its ids and one ``end``; a null text has only the end. A document above
    ``capacity`` is cut into whole sequences, the first piece being the rest. Pieces of
    less than a sequence are dealt by hash into slices of about ``pieces_per_slice``. For each
    slice, ``islands`` populations of packings evolve apart (:func:`cross`) and exchange their
    best after each of ``epochs``.

    The ``reopened`` emptiest sequences of every slice, but not more than a quarter of its
    pieces, are then dissolved and packed together in fewer slices, until one slice is left,
    so the room that slices leave does not add up. Sequence ids are any distinct numbers.

    Rows are told apart by a number of their own: repeated rows and null identifiers are
    ordinary documents, and neither equal texts nor one identifier meet in one task. Other
    columns are ignored; an empty table gives an empty result.
    """
    table = stored_texts(pieces(docs, tokenizer, capacity, end, with_ids), "pieces")
    columns = [name for name in table.columns if name != "row"]
    whole = table.where(F.col("length") == capacity)
    result = whole.withColumns({"sequence_id": -F.col("row") - 1, "offset": F.lit(0).cast("bigint")})
    result = result.select(*columns, "sequence_id", "offset")
    loose = table.where(F.col("length") < capacity)
    left = loose.count()
    level = 0
    while left:
        slices = max(1, left // pieces_per_slice)
        sliced = loose.withColumn("slice", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(slices)).cast("bigint"))
        solved = _solved(sliced, capacity, islands, epochs, generations, population, level, slices * islands)
        placed = stored(_placed(sliced, solved, capacity, reopened if slices > 1 else 0, level), f"level-{level}")
        result = result.unionByName(placed.where("not reopened").select(*columns, "sequence_id", "offset"))
        loose = placed.where("reopened").select(table.columns)
        left = loose.count() if slices > 1 else 0
        level += 1
    return result


def _placed(sliced: DataFrame, solved: DataFrame, capacity: int, reopened: int, level: int) -> DataFrame:
    """Pieces with the place that their slice's packing has for their length; ``reopened`` are those of its emptiest bins."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sliced.schema if f.name != "slice")
    names = [name for name in sliced.columns if name != "slice"]

    def place(own: pd.DataFrame, solution: pd.DataFrame) -> pd.DataFrame:
        flat = np.asarray(solution["solution"].iloc[0], dtype=np.int64)
        bin_of = np.cumsum(flat == 0) - (flat == 0)
        fill = np.bincount(bin_of, flat).astype(np.int64)
        before = np.cumsum(flat) - flat
        offset = before - (np.cumsum(fill) - fill)[bin_of]
        real = flat > 0
        flat, bin_of, offset = flat[real], bin_of[real], offset[real]
        # Pieces and places of one length are as many: by length they pair off.
        order = np.argsort(flat, kind="stable")
        own = own.sort_values(["length", "row"]).reset_index(drop=True)
        assert np.array_equal(own["length"].to_numpy(), flat[order])
        emptiest = np.argsort(fill, kind="stable")[:reopened]
        emptiest = emptiest[fill[emptiest] < capacity]
        held = np.cumsum(np.bincount(bin_of, minlength=len(fill))[emptiest])
        again = emptiest[held <= len(flat) // 4]
        bin_of = bin_of[order]
        sequence = (level << 56) + (int(solution["slice"].iloc[0]) << 24) + bin_of
        return own[names].assign(sequence_id=sequence, offset=offset[order], reopened=np.isin(bin_of, again))

    schema = f"{fields}, sequence_id bigint, offset bigint, reopened boolean"
    return sliced.groupBy("slice").cogroup(solved.groupBy("slice")).applyInPandas(place, schema)
