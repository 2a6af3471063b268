"""Near-duplicate embeddings: random-hyperplane signs in several tables, verified by exact cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.llm.common import stored
from sparkward.llm.components import components
from sparkward.llm.pairs import buckets, forest, in_units, ordered


def shape(vectors: int, threshold: float, missed: float, fewest: int = 8, most: int = 20) -> tuple[int, int]:
    """Signs per table and number of tables.

    Signs grow with the logarithm of the number of vectors, so that the vectors
    that meet by chance stay about 16 per bucket up to 16 million, and tables so that a
    pair exactly at the threshold is missed with probability ``missed`` at most;
    nearer pairs are missed far less.
    """
    bits = min(most, max(fewest, math.ceil(math.log2(max(vectors, 2))) - 4))
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log(1 - meets))


@cache
def _planes(dimension: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([dimension, bits, tables, 71]).standard_normal((dimension, bits * tables))


def link_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    missed: float = 0.02,
    rows_per_unit: int = 4_000,
    rows_per_block: int = 2_000,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors (vec_id, embedding)``.

    Two rows are linked when the cosine of their vectors, in double precision, is at
    least ``threshold``. Candidates are vectors whose signs against the hyperplanes
    of a table agree in all bits (see :func:`shape` for bits and tables); each is
    verified by its cosine, so no link is wrong, and pairs at the very threshold are
    found with a probability of at least ``1 - missed``.

    Rows with identical vectors are reduced in the map tasks and compared as one.
    Inside a bucket each pair counts in the first table where it meets, and only
    numbers of links and a spanning forest leave the task. Large buckets are cut
    into pairs of blocks.

    A vector that is null, empty, zero, or holds a null or non-finite component links
    with nothing, also not with its copies; neither do vectors of different
    lengths. Its component is its own ``vec_id``. ``kept`` is ``vec_id =
    component_id``, so repeated rows with the smallest id are all kept. A null
    ``vec_id`` counts as a row, is never the smallest, and is kept only if its
    component has no id. Other columns are ignored; an empty table gives an empty
    result.
    """
    sound = F.coalesce(
        (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    # Adding zero makes equal vectors of those that differ in the sign of a zero.
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    zero = F.lit(0).cast(kind)
    rows = vectors.select(
        "vec_id", F.transform("embedding", lambda x: x + zero).alias("vector"), sound.alias("sound")
    )
    nodes = (
        rows.where("sound").groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = stored(nodes, "vectors")
    bits, tables = shape(nodes.count(), threshold, missed)
    schema = f"node bigint, copies bigint, vector array<{kind}>, signs array<int>"
    signed = stored(nodes.mapInPandas(_signer(bits, tables), schema), "signs")
    members = signed.select("node", F.posexplode("signs").alias("table", "sign"), F.size("vector").alias("length"))
    members = members.select("node", "table", F.xxhash64("length", "table", "sign").alias("bucket"))
    units = in_units(members, rows_per_unit, rows_per_block).join(signed, "node")

    def compare(unit: pd.DataFrame) -> pd.DataFrame:
        unit = ordered(unit)
        groups = unit.groupby(unit["vector"].map(len)).indices  # a bucket has one length only
        unit_vectors = [np.empty(0)] * len(unit)
        for rows in groups.values():
            matrix = np.array(unit["vector"].iloc[rows].tolist(), dtype=float)
            matrix /= np.linalg.norm(matrix, axis=1)[:, None]
            for place, vector in zip(rows, matrix, strict=True):
                unit_vectors[place] = vector
        signs, table = np.array(unit["signs"].tolist()), unit["table"].to_numpy()
        ids, copies = unit["node"].to_numpy(), unit["copies"].to_numpy()
        node, root, links = [], [], []
        for part, met in buckets(unit):
            matrix = np.array(unit_vectors[part])
            near = (matrix @ matrix.T >= threshold) & met
            if not near.any():
                continue
            first, second = np.nonzero(near)
            earlier = signs[part, : table[part.start]]
            new = ~(earlier[first] == earlier[second]).any(axis=1)
            count = np.zeros(len(matrix), dtype=np.int64)
            np.add.at(count, first[new], copies[part][second[new]])
            np.add.at(count, second[new], copies[part][first[new]])
            for member, top in forest(near | near.T):
                node.append(ids[part][member])
                root.append(ids[part][top])
                links.append(0)
            linked = np.flatnonzero(count)
            node.extend(ids[part][linked])
            root.extend(ids[part][linked])
            links.extend(count[linked])
        return pd.DataFrame({"node": node, "root": root, "links": links}, dtype="int64")

    found = stored(
        units.groupBy("unit", "left", "right").applyInPandas(compare, "node bigint, root bigint, links bigint"),
        "links",
    )
    joined = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = (
        nodes.join(links, "node", "left")
        .join(joined.withColumnRenamed("id", "node"), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "component").select(
        "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    result = rows.where("sound").join(nodes, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return result.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _signer(bits: int, tables: int):
    weights = (1 << np.arange(bits)).astype(np.int64)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby(batch["vector"].map(len)):
                matrix = np.array(same["vector"].tolist(), dtype=float)
                above = matrix @ _planes(matrix.shape[1], bits, tables) >= 0
                signs = (above.reshape(len(matrix), tables, bits) @ weights).astype(np.int32)
                yield same[["node", "copies", "vector"]].assign(signs=list(signs))

    return sign
