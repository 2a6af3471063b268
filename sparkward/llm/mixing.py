"""Sources mixed to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkward.llm.common import WORD, discard, numbered, original, stored, unit_interval
from sparkward.operators.selection import borders, small


def quality(text: Column) -> Column:
    """A weight from 0.2 to 1: less for texts rich in signs other than letters and white space."""
    signs = F.char_length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    share = F.when(F.char_length(text) > 0, signs / F.char_length(text)).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + 4.0 * share)


def targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``source, number, source_size, target`` for ``sizes (source, source_size)``.

    Sources take ``weights`` in turn, by code point with null last. They share
    ``share`` times all sizes by weight; a target above ``most`` times its source's
    size stops there and the excess is shared again by weight until none is above.
    That ends where each target is the smaller of its stop and one common level
    times its weight: by rising ratio of stop and weight, a source is stopped if
    what the sources before it leave still reaches its ratio.

    One row per source goes through one task, as a common level needs all of them.
    """
    every = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = sizes.withColumn("number", F.row_number().over(every) - 1).withColumn(
        "weight", F.get(cycle, F.col("number") % len(weights))
    )
    weighed = weighed.withColumn("stop", F.col("source_size") * F.lit(float(most)))
    rising = Window.orderBy(F.col("stop") / F.col("weight"), "number")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_words = F.sum("source_size").over(whole) * F.lit(float(share))
    left = all_words - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    heavier = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    weighed = weighed.withColumns({"left": left, "heavier": heavier})
    level = F.col("left") / F.col("heavier")
    weighed = weighed.withColumns(
        {"stopped": level * F.col("weight") >= F.col("stop"), "level": level}
    )
    # The first source that is not stopped sees the common level.
    common = F.min(F.when(~F.col("stopped"), F.struct(F.col("stop") / F.col("weight"), "number", "level"))).over(whole)
    target = F.when(F.col("stopped"), F.col("stop")).otherwise(common["level"] * F.col("weight"))
    return weighed.select("source", "number", "source_size", target.alias("target"))


def keyed(docs: DataFrame) -> DataFrame:
    """``number, row, source, size, key`` of ``docs (doc_id, text, source)``; no row is shuffled.

    The key is an exponential number divided by the document's quality weight. The
    identifier alone decides the number (the text where that is null), so reruns agree.
    """
    text = F.coalesce("row.text", F.lit(""))
    drawn = unit_interval(F.coalesce(F.col("row.doc_id").cast("string"), text))
    return numbered(docs).select(
        "number",
        "row",
        F.col("row.source").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        (-F.log(drawn) / quality(text)).alias("key"),
    )


def cuts(
    rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    rows_per_cell: int = 20_000,
) -> DataFrame:
    """Per source of ``rows (number, source, size, key)``, stored, how much of it is taken.

    ``of, source_size, target, full, last_key, last_number``: ``full`` complete epochs, and besides
    each document with a size whose key and number are not behind the last ones. These are found
    by rounds of histograms over keys and, if too many rows have one key, over numbers
    (:func:`borders`), until at most ``rows_per_cell`` rows of a source are left to be summed one by one.
    """
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1)
    sources = sources.withColumn("full", full.cast("bigint"))
    sources = stored(sources.withColumn("wanted", F.col("target") - F.col("full") * F.col("source_size")), "targets")
    at_key = borders(rows, ["source"], "key", "size", sources, ranked_rows=rows_per_cell)
    left = F.col("wanted") - F.col("before")
    tied = stored(
        at_key.where(F.col("n") > rows_per_cell).select(F.col("source").alias("of"), F.col("low").alias("tie"), left.alias("wanted")),
        "tied",
    )
    border = at_key.select(F.col("source").alias("of"), "low", "high", left.alias("left"))
    inside = rows.join(small(border), F.col("source").eqNullSafe(F.col("of"))).where("key between low and high")
    if not tied.isEmpty():
        ties = rows.join(small(tied), F.col("source").eqNullSafe(F.col("of"))).where("key = tie")
        at_number = borders(
            ties.select("source", "number", "size"), ["source"], "number", "size",
            stored(tied.select(F.col("of").alias("source"), "wanted"), "tied"), ranked_rows=rows_per_cell,
        )
        first = at_number.select(
            F.col("source").alias("tied"), F.lit(True).alias("is_tied"), F.col("low").alias("from"), F.col("high").alias("to"), left.alias("left_of_ties")
        )
        inside = inside.join(small(first), F.col("of").eqNullSafe(F.col("tied")), "left")
        inside = inside.where("is_tied is null or number between from and to")
        inside = inside.withColumn("left", F.coalesce("left_of_ties", "left")).withColumn("begin", F.coalesce("from", F.lit(0)))
    else:
        inside = inside.withColumn("begin", F.lit(0).cast("bigint"))
    along = Window.partitionBy("of").orderBy("key", "number")
    sooner = F.coalesce(F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = sooner + F.col("size") / 2.0 <= F.col("left")
    inside = inside.select("of", "low", "begin", "key", "number", taken.alias("taken"))
    # Where none of these is taken, the last one taken lies just before them.
    last = F.coalesce(F.max(F.when(F.col("taken"), F.struct("key", "number"))), F.struct(F.min("low").alias("key"), (F.min("begin") - 1).alias("number")))
    last = inside.groupBy("of").agg(last.alias("last"))
    found = sources.join(last, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("of"), "source_size", "target", "full", F.col("last.key").alias("last_key"), F.col("last.number").alias("last_number")
    )
    return stored(found, "cuts")


def with_epochs(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows (number, source, size, key, ...)`` with ``source_size, target, epochs``: how often each is taken.

    The table of sources is broadcast up to 200,000 of them, so rows are not shuffled.
    """
    last = (F.col("key") < F.col("last_key")) | (
        (F.col("key") == F.col("last_key")) & (F.col("number") <= F.col("last_number"))
    )
    drawn = F.when((F.col("size") > 0) & F.coalesce(last, F.lit(False)), 1).otherwise(0)
    joined = rows.join(small(cut), F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("epochs", F.col("full") + drawn).drop("of", "full", "last_key", "last_number")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    rows_per_cell: int = 20_000,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, epochs, taken`` for ``docs (doc_id, text, source)``.

    A target is met by as many complete epochs of its source as fit. For the rest,
    documents are drawn without replacement, heavier ones sooner: the key of a
    document is an exponential number divided by its quality weight (:func:`keyed`); by rising
    key documents are taken while the one at the border lies more than half inside (:func:`cuts`).
    ``epochs`` says how often a document is taken, ``taken`` is that times its size.

    A null text has no words; documents without words are taken 0 words and belong
    to complete epochs only. Equal keys go by the place in the table. Repeated rows are
    documents of their own, and so are rows with a null identifier. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = stored(keyed(docs).select("number", "row.doc_id", "source", "size", "key"), "keys")
    mixed = with_epochs(rows, cuts(rows, weights, share, most, rows_per_cell))
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken")
    )


def taken_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as :func:`mix` takes it.

    The keys are computed twice, for the cuts and for the rows, so that no text is shuffled or stored.
    """
    rows = keyed(docs)
    slim = stored(rows.select("number", "source", "size", "key"), "keys")
    mixed = with_epochs(rows, cuts(slim))
    discard(slim)
    taken = mixed.where("epochs > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))))
    return taken.select(*original(taken, "row", ()))
