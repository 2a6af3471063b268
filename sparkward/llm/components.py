"""Connected components by alternating stars, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.llm.common import discard, spread_join, stored


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every end of ``edges (u, v)``, which are stored; the component is its smallest id.

    Each round links all larger neighbours of a node to the smallest of them (large
    star), then all smaller ones (small star). The number of links never grows, a
    node with very many links is reduced in the map tasks before it is shuffled and dealt over
    several tasks where its links are joined, and every round is written to the shared folder
    and the round before deleted. Loops and repeated links are harmless; without links the result is empty.
    """
    links = _stars(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    before = None
    while (now := _fingerprint(links)) != before:
        before, former = now, links
        links = _stars(_large_star(links))
        discard(former)
    pairs = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("id"), "component").distinct())


def _least(links: DataFrame) -> DataFrame:
    return stored(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("m", "u").alias("m"), "n")
    joined = spread_join(both, least.drop("n"), "u", least.select("u", "n"))
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _stars(links: DataFrame) -> DataFrame:
    """Small star: link a node and its smaller neighbours to the smallest of them."""
    links = stored(links.distinct(), "links")
    least = _least(links)
    others = spread_join(links, least.drop("n"), "u", least.select("u", "n"))
    others = others.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    stars = stored(
        others.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars"
    )
    discard(links, least)
    return stars


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(
        links.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")),
        ).first()
    )
