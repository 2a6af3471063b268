"""Column masking and row-level access."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkward.operators.selection import BROADCAST_ROWS, met
from sparkward.session import discard, stored


def _hide(column: Column) -> Column:
    return F.mask(column.cast("string"))


def keyed_hash(column: Column, key: str) -> Column:
    """A stable pseudonym; without the key, values can't be found by trying them."""
    return F.sha2(F.concat(F.lit(f"{key}|"), column.cast("string")), 256)


def _last_four(column: Column) -> Column:
    text = column.cast("string")
    shown = F.right(text, F.lit(4))
    hidden = F.greatest(F.length(text) - 4, F.lit(0))
    return F.when(text.isNotNull(), F.concat(F.repeat(F.lit("*"), hidden), shown))


def _null(column: Column) -> Column:
    return F.when(F.lit(False), column)


# "mask" replaces letters and digits, "last4" shows four characters, "null" drops
# the value and keeps the type.
MASKS = {"mask": _hide, "last4": _last_four, "null": _null}


def mask_columns(
    df: DataFrame, masks: Mapping[str, str], *, hash_key: str | None = None
) -> DataFrame:
    """Replace columns by masked ones: ``{column: kind of mask}``.

    The kind ``hash`` is a pseudonym and needs ``hash_key``, which is to be kept secret.
    """
    kinds = dict(MASKS)
    if hash_key:
        kinds["hash"] = lambda column: keyed_hash(column, hash_key)
    elif "hash" in masks.values():
        raise ValueError("The mask 'hash' needs a hash_key")
    unknown = sorted(set(masks.values()) - set(kinds))
    if unknown:
        raise ValueError(f"Unknown masks {unknown}; expected some of {sorted(kinds)}")
    missing = sorted(set(masks) - set(df.columns))
    if missing:
        raise ValueError(f"No columns {missing}")
    return df.withColumns({name: kinds[kind](F.col(f"`{name}`")) for name, kind in masks.items()})


def visible_rows(
    df: DataFrame, entitlements: DataFrame, actor: str, keys: Mapping[str, str]
) -> DataFrame:
    """Rows an actor is entitled to.

    ``entitlements`` has a column ``actor``; ``keys`` maps columns of ``df`` to
    its columns. Spark broadcasts the actor's entitlements if they are small
    and otherwise joins by key; an actor with none sees no row.
    """
    granted = entitlements.where(F.col("actor") == actor).select(*keys.values()).distinct()
    condition = [df[left] == granted[right] for left, right in keys.items()]
    return df.join(granted, condition, "left_semi")


def inherited_grants(grants: DataFrame, hierarchy: DataFrame, *, few: int = BROADCAST_ROWS) -> DataFrame:
    """All ``(actor, node)`` that ``grants`` (the same columns) reach down a ``hierarchy`` of ``(child, parent)``.

    A grant on a node holds for everything below it, however deep, and for itself. A child may
    have several parents, and nodes may lead back to themselves: each pair is followed once. Rows with a null
    are ignored. For one actor, hand in that actor's grants only: a result has as many rows as there are nodes below them.

    One join per level, each with the pairs that are new since the last and have something below them: broadcast
    if they are ``few``, else dealt with the hierarchy over parts, so a parent of any number of children is no single task.
    """
    edges = hierarchy.where(F.col("child").isNotNull() & F.col("parent").isNotNull())
    edges = stored(edges.select("child", F.col("parent").alias("node")).distinct(), "edges")
    parents = stored(edges.select("node").distinct(), "parents")
    given = grants.where(F.col("actor").isNotNull() & F.col("node").isNotNull())
    new = reached = stored(given.select("actor", "node").distinct(), "grants")
    while True:
        leading = stored(met(new, parents, ["node"], "left_semi", few=few), "leading")
        if leading.isEmpty():
            break
        below = met(edges, leading, ["node"], "inner", few=few).select("actor", F.col("child").alias("node")).distinct()
        new = stored(below.join(reached.hint("merge"), ["actor", "node"], "left_anti"), "grants")
        reached = reached.unionByName(new)
    discard(edges, parents)
    return reached
