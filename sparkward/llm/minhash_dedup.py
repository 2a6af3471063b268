"""Near-duplicate documents by SetSketch registers, verified on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.llm.common import LOWER, discard, in_chunks, numbered, original, spread_join, stored, stored_texts
from sparkward.llm.components import components
from sparkward.llm.pairs import buckets, forest, in_units, ordered
from sparkward.operators.selection import small

# Registers are floor(1 - log_BASE(h)) of the smallest exponential h with RATE.
# With a base so near 1, equal registers are about as likely as equal minima.
BASE, RATE, TOP = 1.001, 20.0, 65_535
BAND = 4
REGISTERS = 80


def shingle_sets(texts: Sequence[bytes], words: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles of ``words`` words.

    A-Z are lower-cased; words are runs of other than white space. A text with fewer
    words has one shingle of them all, one without words none.
    """
    sets = []
    for text in texts:
        parts = text.translate(LOWER).split()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
        width = min(words, len(parts))
        if not width:
            sets.append(hashes)
            continue
        mixed = np.full(len(parts) - width + 1, np.uint64(0x9E3779B97F4A7C15 * width % 2**64))
        for i in range(width):
            mixed = _mixed(mixed ^ hashes[i : len(parts) - width + 1 + i])
        sets.append(np.unique(mixed))
    return sets


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def sketches(sets: Sequence[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """SetSketch registers, one row per set; sets must not be empty."""
    result = np.empty((len(sets), registers), dtype=np.uint16)
    drawn = np.random.default_rng(9)
    factors = drawn.integers(0, 2**64, registers, dtype=np.uint64) | np.uint64(1)
    terms = drawn.integers(0, 2**64, registers, dtype=np.uint64)
    first = 0
    while first < len(sets):  # about a million shingles at a time
        end, size = first, 0
        while end < len(sets) and (end == first or size + len(sets[end]) <= 1_000_000):
            size += len(sets[end])
            end += 1
        shingles = np.concatenate(sets[first:end])
        starts = np.cumsum([0, *map(len, sets[first : end - 1])])
        least = np.empty((end - first, registers))
        scratch = np.empty_like(shingles)
        for i in range(registers):
            np.multiply(shingles, factors[i], out=scratch)
            np.add(scratch, terms[i], out=scratch)
            least[:, i] = np.minimum.reduceat(scratch, starts)
        exponential = -np.log1p(-(least + 0.5) / 2.0**64) / RATE
        result[first:end] = np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, TOP)
        first = end
    return result


def merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(left, right)


def likely(
    left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, threshold: float
) -> np.ndarray:
    """Pairs of sketches whose joint likelihood doesn't rule out a similarity of ``threshold``.

    How many registers are larger left, larger right or equal has a likelihood given
    the similarity and the sizes of both sets, which are known. A pair is ruled out if
    ``threshold`` is more than e^-14 times less likely than the best estimate below it.
    """
    larger = (left > right).sum(axis=1)[:, None]
    smaller = (left < right).sum(axis=1)[:, None]
    equal = left.shape[1] - larger - smaller
    share = (n_left / (n_left + n_right))[:, None]
    grid = np.append(np.linspace(0.0, 0.98, 50) * threshold, threshold)[None, :]
    grid = np.minimum(grid, np.minimum(share / (1 - share), (1 - share) / share))

    def passes(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more = np.maximum(passes(share - (1 - share) * grid), 1e-12)
    less = np.maximum(passes((1 - share) - share * grid), 1e-12)
    same = np.maximum(1 - more - less, 1e-12)
    score = larger * np.log(more) + smaller * np.log(less) + equal * np.log(same)
    possible = np.minimum(n_left, n_right) >= threshold * np.maximum(n_left, n_right) - 1e-9
    return possible & (score[:, -1] >= score.max(axis=1) - 14)


def _bands(sketch: np.ndarray) -> np.ndarray:
    """Per row one hash for each band of registers."""
    rows = sketch.reshape(len(sketch), -1, BAND).astype(np.uint64)
    keys = np.full(rows.shape[:2], np.uint64(1469598103934665603))
    keys = _mixed(keys + np.arange(rows.shape[1], dtype=np.uint64)[None, :])
    for i in range(BAND):
        keys = _mixed(keys ^ (rows[:, :, i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def link_documents(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    rows_per_unit: int = 20_000,
    rows_per_block: int = 2_000,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``.

    Documents are linked when ``100 * |A and B| >= percent * |A or B|`` for their
    sets of distinct ``words``-word shingles; a component is what links reach (:func:`link_rows`).

    A text without words, empty or null has no shingles and links with nothing. Rows
    with the same identifier but different texts are different nodes. ``kept`` is
    ``doc_id = component_id``: repeated rows with the smallest id are all kept. A
    null identifier is never the smallest; it is kept only if its component has no
    id. Other columns are ignored; an empty table gives an empty result.
    """
    rows = numbered(docs).select("number", "row.doc_id", "row.text")
    linked = link_rows(rows, words, percent, rows_per_unit, rows_per_block)
    some = linked.where("component is not null")
    least = some.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    least = stored(least, "least")
    some = spread_join(some, least.drop("n"), "component", least.select("component", "n"))
    alone = linked.where("component is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    result = some.select(columns).unionByName(alone.select(columns))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_per_component(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs (doc_id, text, ...)`` without all but one of each component of :func:`link_rows`.

    The one with the smallest identifier stays, null last, then the smallest hash of the
    text, then the first in the table. Rows without words all stay. Only the numbers of the rows
    that go are brought together; up to 200,000 are broadcast, more are joined.
    """
    rows = numbered(docs)
    texts = rows.select("number", "row.doc_id", "row.text", F.xxhash64("row.text").alias("hash"))
    linked = link_rows(texts, words, percent, carried=("hash",))
    some = linked.where("component is not null")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "number")
    groups = some.groupBy("component").agg(F.min(place)["number"].alias("first"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1"), "groups")
    members = spread_join(some, groups.drop("n"), "component", groups.select("component", "n"))
    gone = stored(members.where("number <> first").select("number"), "gone")
    discard(groups, linked)
    kept = rows.join(small(gone), "number", "left_anti")
    return kept.select(*original(kept, "row", ()))


def link_rows(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    rows_per_unit: int = 20_000,
    rows_per_block: int = 2_000,
    carried: Sequence[str] = (),
) -> DataFrame:
    """``number, doc_id, n_shingles, component`` of ``docs (number, doc_id, text)`` and ``carried``, stored.

    ``number`` tells rows apart, whenever ``docs`` is read. ``component`` is null for a row without shingles.

    1. Each text gives its set, a digest of it and 80 registers. Rows with equal
       sets are one node from here on.
    2. Nodes that agree in a band of four registers share a bucket. At a similarity
       of 0.8 a pair misses all 20 bands with a probability of 3e-5.
    3. Every node is paired with the smallest node of each of its buckets. The joint
       likelihood of both sketches drops the hopeless pairs, the rest is verified on
       full sets, and components are formed. A group of n near copies costs n pairs
       a band.
    4. What shares a bucket but is still in different components is compared inside
       the tasks, first by sketches, then, with the full sets of those that have a
       plausible partner, exactly. Each pair is met in the first band it shares. Every
       plausible pair across components is verified, so a link is lost only if all bands miss
       it or, far less often, the likelihood rules it out; but only a spanning forest
       of the links leaves a task, never the pairs of a group.

    Frequent sets, nodes that head many pairs and large components are dealt over several tasks.
    Tables in between are deleted once they were read for the last time.
    """
    threshold = percent / 100
    rows = stored_texts(_sketched(docs, words, carried), "sketches")
    nodes = (
        rows.where("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min("number").alias("number"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
            F.count("*").alias("n"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = stored(nodes, "nodes")
    members = stored(nodes.select("node", "sketch").mapInPandas(_band_rows, "node bigint, bucket bigint"), "bands")

    firsts = members.groupBy("bucket").agg(F.min("node").alias("top"), F.count("*").alias("size"))
    firsts = firsts.where("size > 1")
    pairs = stored(
        members.join(firsts, "bucket").where("node <> top")
        .select(F.col("top").alias("a"), F.col("node").alias("b")).distinct(),
        "pairs",
    )
    likely_pairs = stored(_plausible(pairs, nodes, threshold), "likely")
    discard(pairs)
    links = _verified(likely_pairs, nodes, docs, words, percent)
    discard(likely_pairs)
    joined = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    crossing = stored(
        _crossing(members, nodes, joined, threshold, rows_per_unit, rows_per_block), "crossing"
    )
    discard(members)
    if not crossing.isEmpty():
        sets = _sets(crossing.select("node").distinct(), nodes, docs, words)
        more = stored(_linked(crossing, sets, nodes, percent, rows_per_unit // 4, rows_per_block), "verified")
        discard(sets)
        both = stored(links.unionByName(more), "links")
        discard(links, more)
        links = both
        joined = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    labelled = nodes.join(joined.withColumnRenamed("id", "node"), "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"), "n"
    )
    labelled = stored(labelled, "labelled")
    names = ["number", "doc_id", *carried, "n_shingles"]
    some = rows.where("n_shingles > 0").select(*names, "digest")
    some = spread_join(some, labelled.drop("n"), "digest", labelled.select("digest", "n"))
    none = rows.where("n_shingles = 0").withColumn("component", F.lit(None).cast("bigint"))
    result = stored(some.select(*names, "component").unionByName(none.select(*names, "component")), "linked")
    discard(rows, nodes, links, crossing, labelled)
    return result


def _crossing(
    members: DataFrame, nodes: DataFrame, joined: DataFrame, threshold: float,
    rows_per_unit: int, rows_per_block: int,
) -> DataFrame:
    """``node, bucket, component`` of what has a plausible partner in another component there."""
    labelled = members.join(joined.withColumnRenamed("id", "node"), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    divided = (
        labelled.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
        .where("size > 2 and low <> high")
        .select("bucket")
    )
    units = in_units(labelled.join(divided, "bucket", "left_semi"), rows_per_unit, rows_per_block)

    def compare(unit: pd.DataFrame) -> pd.DataFrame:
        unit = ordered(unit)
        some = np.zeros(len(unit), dtype=bool)
        for first, second in _plausible_across(unit, threshold):
            some[first] = some[second] = True
        return unit.loc[some, ["node", "bucket", "component"]]

    sided = units.join(nodes.select("node", "n_shingles", "sketch"), "node")
    return (
        sided.groupBy("unit", "left", "right")
        .applyInPandas(compare, "node bigint, bucket bigint, component bigint").distinct()
    )


def _plausible_across(unit: pd.DataFrame, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per bucket the rows of pairs across components that meet in no earlier band and may be similar."""
    sketch, component = _matrix(unit["sketch"]), unit["component"].to_numpy()
    size, bands = unit["n_shingles"].to_numpy(dtype=float), _bands(sketch)
    band = np.argmax(bands == unit["bucket"].to_numpy()[:, None], axis=1)
    for part, met in buckets(unit):
        own, start = component[part], part.start
        first, second = np.nonzero(met & (own[:, None] != own[None, :]))
        keep = np.zeros(len(first), dtype=bool)
        for i in range(0, len(first), 20_000):
            f, s = first[i : i + 20_000] + start, second[i : i + 20_000] + start
            new = ~(bands[f, : band[start]] == bands[s, : band[start]]).any(axis=1)
            new[new] = likely(sketch[f[new]], sketch[s[new]], size[f[new]], size[s[new]], threshold)
            keep[i : i + 20_000] = new
        yield first[keep] + start, second[keep] + start


def _linked(
    crossing: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int,
    rows_per_unit: int, rows_per_block: int,
) -> DataFrame:
    """Links ``a, b`` that join what verified pairs across components in each bucket join."""
    units = in_units(crossing, rows_per_unit, rows_per_block)
    units = units.join(nodes.select("node", "n_shingles", "sketch"), "node").join(sets, "node")

    def verify(unit: pd.DataFrame) -> pd.DataFrame:
        unit = ordered(unit)
        node, sets = unit["node"].to_numpy(), unit["shingles"].tolist()
        found = [np.empty((0, 2), dtype=np.int64)]
        for first, second in _plausible_across(unit, percent / 100):
            if len(first):
                ok = _similar(sets, first, second, percent)
                rows, place = np.unique(np.concatenate([first[ok], second[ok]]), return_inverse=True)
                linked = np.zeros((len(rows), len(rows)), dtype=bool)
                linked[place[: ok.sum()], place[ok.sum() :]] = True
                pairs = np.array(forest(linked | linked.T), dtype=np.int64).reshape(-1, 2)
                found.append(node[rows[pairs]])
        return pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    return units.groupBy("unit", "left", "right").applyInPandas(verify, "a bigint, b bigint").distinct()


def _similar(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sorted sets are similar enough. The member of more pairs is looked up once for all."""
    pairs_of = np.bincount(np.concatenate([first, second]))
    swap = pairs_of[second] > pairs_of[first]
    first, second = np.where(swap, second, first), np.where(swap, first, second)
    result = np.zeros(len(first), dtype=bool)
    order = np.argsort(first, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
        own = sets[first[group[0]]]
        others = [sets[i] for i in second[group]]
        lengths = np.array([len(o) for o in others])
        flat = np.concatenate(others)
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum(lengths) - lengths)
        result[group] = 100 * both >= percent * (len(own) + lengths - both)
    return result


def _sketched(docs: DataFrame, words: int, carried: Sequence[str]) -> DataFrame:
    names = ["number", "doc_id", *carried]
    fields = [f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in names]

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, texts in in_chunks(batch["text"]):
                sets = shingle_sets(texts, words)
                some = [i for i, s in enumerate(sets) if len(s)]
                packed: list[bytes | None] = [None] * len(sets)
                if some:
                    for i, row in zip(some, sketches([sets[i] for i in some]), strict=True):
                        packed[i] = row.astype("<u2").tobytes()
                part = batch.iloc[first : first + len(sets)][names]
                yield part.assign(
                    n_shingles=[len(s) for s in sets], digest=[_digest(s) for s in sets], sketch=packed
                )

    schema = ", ".join([*fields, "n_shingles bigint, digest binary, sketch binary"])
    return docs.select(*names, "text").mapInPandas(sketch, schema)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()


def _matrix(sketch: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketch), dtype="<u2").reshape(len(sketch), REGISTERS)


def _band_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = _bands(_matrix(batch["sketch"]))
        yield pd.DataFrame({"node": np.repeat(batch["node"].to_numpy(), keys.shape[1]), "bucket": keys.ravel()})


def _plausible(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` that the sketches don't rule out."""
    slim = nodes.select("node", "n_shingles", "sketch")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            ok = likely(
                _matrix(batch["sketch_a"]), _matrix(batch["sketch_b"]),
                batch["n_a"].to_numpy(dtype=float), batch["n_b"].to_numpy(dtype=float), threshold,
            )
            yield batch.loc[ok, ["a", "b"]]

    sides = spread_join(pairs, slim.toDF("a", "n_a", "sketch_a"), "a").join(slim.toDF("b", "n_b", "sketch_b"), "b")
    return sides.select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInPandas(keep, "a bigint, b bigint")


def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``node, shingles``, sorted: the full sets of some nodes, made again from the text of one row each.

    Up to 200,000 wanted nodes are broadcast, so that no text is shuffled; more are joined.
    """
    wanted = stored(nodes.join(wanted, "node", "left_semi").select("node", "number"), "wanted")
    texts = docs.select("number", "text").join(small(wanted), "number")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, chunk in in_chunks(batch["text"], 1_000_000):
                nodes = batch["node"].iloc[first : first + len(chunk)].to_numpy()
                sets = [np.sort(shingles.view(np.int64)) for shingles in shingle_sets(chunk, words)]
                yield pd.DataFrame({"node": nodes, "shingles": sets})

    sets = stored_texts(texts.select("node", "text").mapInPandas(make, "node bigint, shingles array<bigint>"), "sets")
    discard(wanted)
    return sets


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough, stored. Only sets that occur in a pair are made again."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(wanted, nodes, docs, words)
    both = F.size(F.array_intersect("set_a", "set_b"))
    similar = 100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)
    sides = spread_join(pairs, sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    links = stored(sides.where(similar).select("a", "b"), "verified")
    discard(sets)
    return links
