"""The newest N rows, for any N and any skew."""

from __future__ import annotations

from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkward.functions.times import micros, moment_of
from sparkward.operators.selection import borders, same, small
from sparkward.session import stored

# Spark's own top-N sends this many rows of every task to one task.
DIRECT_ROWS = 100

# A time span with at most this many rows is ranked without narrowing it further.
RANKED_ROWS = 1_000_000

# Widths, in microseconds, of the time spans that are looked at in turn: about
# twelve days, three hours, a hundred seconds, a second, a millisecond, one.
_SPANS = [10**12, 10**10, 10**8, 10**6, 10**3, 1]

# A key with at most this many events is ranked without narrowing it.
RANKED_PER_KEY = 100_000

# Behind every time and every number of an identifier.
_LAST = 2**62

# Of events at one and the same time, into so many spans numeric identifiers are cut at most.
_KEY_SPANS = 1_000


def _order(time: str, key: str) -> list[Column]:
    return [F.desc_nulls_last(time), F.desc_nulls_last(key)]


def newest(
    events: DataFrame,
    limit: int,
    *,
    time: str = "timestamp",
    key: str = "event_id",
    direct_rows: int = DIRECT_ROWS,
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """The ``limit`` newest events by ``(time, key)``, nulls last, in no fixed order.

    A few are found by Spark's top-N. For more, the time of the oldest event to
    keep is narrowed down by counting events per span of time, which reads
    nothing but the times; the result is then a filter on the time, which skips
    older files, and a ranking of the few events in the last span.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    if limit <= direct_rows:
        return events.orderBy(*_order(time, key)).limit(limit)
    return _newest_by_time(events, limit, time, key, ranked_rows)


def _cut(within: DataFrame, bucket: Column, wanted: int, weight: Column | None = None) -> Row | None:
    """The bucket that holds the ``wanted``-th newest event; None if there are fewer.

    A row stands for one event, or for ``weight`` of them.

    There is one row per bucket, which the calendar or the kind of bucket bounds, not the events.
    """
    number = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = within.groupBy(bucket.alias("bucket")).agg(number.alias("n"))
    newest_first = F.desc_nulls_last("bucket")
    up_to = Window.orderBy(newest_first).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("running", F.sum("n").over(up_to))
    return running.where(F.col("running") >= wanted).orderBy(newest_first).first()


def oldest_needed(events: DataFrame, bucket: Column, limit: int, weight: Column | None = None):
    """The bucket (say, a date) of the oldest of the ``limit`` newest events.

    A row stands for one event, or for ``weight`` of them. None if every bucket is needed.
    """
    cut = _cut(events, bucket, limit, weight)
    return None if cut is None else cut["bucket"]


def _newest_by_time(
    events: DataFrame, limit: int, time: str, key: str, ranked_rows: int
) -> DataFrame:
    moment, data_type = F.col(time), events.schema[time].dataType
    later, within, wanted, cut = None, events, limit, None
    for span in _SPANS:
        at = micros(moment, data_type)
        cut = _cut(within, at - F.pmod(at, F.lit(span)), wanted)
        if cut is None:
            return events
        wanted -= cut["running"] - cut["n"]
        if cut["bucket"] is None:
            later, within = events.where(moment.isNotNull()), events.where(moment.isNull())
            break
        start = moment_of(cut["bucket"], data_type)
        end = moment_of(cut["bucket"] + span, data_type)
        later = events.where(moment >= end)
        within = events.where((moment >= start) & (moment < end))
        if cut["n"] <= ranked_rows or wanted == cut["n"]:
            break
    kept = [later]
    while cut["n"] > ranked_rows and wanted < cut["n"]:
        # Many events at one time: go on with their identifiers.
        bucket = _key_bucket(within, key)
        if bucket is None:
            break
        cut = _cut(within, bucket, wanted)
        wanted -= cut["running"] - cut["n"]
        if cut["bucket"] is None:
            kept.append(within.where(bucket.isNotNull()))
            within = within.where(bucket.isNull())
        else:
            kept.append(within.where(bucket > F.lit(cut["bucket"])))
            within = within.where(bucket == F.lit(cut["bucket"]))
    if wanted < cut["n"]:
        within = within.orderBy(*_order(time, key)).limit(wanted)
    return reduce(DataFrame.unionByName, [*kept, within])


def _key_bucket(within: DataFrame, key: str) -> Column | None:
    """A coarser identifier with few values that keeps the order; None if it has one value.

    Text is cut one sign behind what all begin with, whole numbers to spans of a
    power of ten; identifiers of other types are ranked as they are.
    """
    kind = within.schema[key].dataType
    if not isinstance(kind, T.StringType | T.IntegralType):
        return None
    low, high, nulls = within.agg(F.min(key), F.max(key), F.count_if(F.col(key).isNull())).first()
    if low is None or (low == high and not nulls):
        return None
    if isinstance(kind, T.StringType):
        same = len(commonprefix([low, high]))
        # A missing identifier stays null, so that it comes last.
        return F.substring(key, 1, same + 1)
    span = 1
    while (high - low) // span >= _KEY_SPANS:
        span *= 10
    number = F.col(key).cast("decimal(38,0)")
    return number - F.pmod(number, F.lit(span).cast("decimal(38,0)"))


def newest_per_key(
    events: DataFrame,
    keys: list[str],
    limit: int,
    *,
    time: str = "timestamp",
    key: str = "event_id",
    slices: int | None = None,
    ranked_rows: int = RANKED_PER_KEY,
) -> DataFrame:
    """The ``limit`` newest events of each key, for any limit and any skew.

    Keys with up to ``ranked_rows`` events are ranked as they are. For the others, fewer than
    events / ``ranked_rows``, the time of the oldest wanted event is found by rounds of
    histograms (:func:`selection.borders`): events behind it are kept by a filter and only those
    in a last interval, ``ranked_rows`` at most, are ranked. If more have one and the
    same time, identifiers are narrowed down alike, by their number or first bytes; what is then
    still too much is ranked in ``slices`` of whole input partitions first.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    if not limit:
        return events.limit(0)
    within_key = Window.partitionBy(*keys).orderBy(*_order(time, key))
    hot = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ranked_rows)
    hot = stored(hot.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]), "hot")
    if hot.isEmpty():
        ranked = events.withColumn("_rank", F.row_number().over(within_key))
        return ranked.where(F.col("_rank") <= limit).drop("_rank")

    hot_keys = [f"_key_{i}" for i in range(len(keys))]
    # Newer is less; events without a time come last.
    moment = micros(F.col(time), events.schema[time].dataType)
    numbered = events.withColumns(
        {"_at": F.coalesce(-moment, F.lit(_LAST)), "_key_at": _key_number(events, key), "_one": F.lit(1).cast("long")}
    )
    wanted = hot.select(*[F.col(h).alias(k) for h, k in zip(hot_keys, keys, strict=True)], F.lit(limit).cast("long").alias("wanted"))
    at_time = borders(numbered, keys, "_at", "_one", wanted, ranked_rows=ranked_rows)
    tied = stored(
        at_time.where(F.col("n") > ranked_rows).select(
            *[F.col(k).alias(h) for h, k in zip(hot_keys, keys, strict=True)],
            F.col("low").alias("_tie"), (F.col("wanted") - F.col("before")).alias("wanted"),
        ),
        "tied",
    )
    at_key = None
    if not tied.isEmpty():
        ties = numbered.join(small(tied), same(keys, hot_keys) & (F.col("_at") == F.col("_tie"))).select(*keys, "_key_at", "_one")
        left = tied.select(*[F.col(h).alias(k) for h, k in zip(hot_keys, keys, strict=True)], "wanted")
        at_key = borders(ties, keys, "_key_at", "_one", left, ranked_rows=ranked_rows)

    cold = numbered.join(small(hot), same(keys, hot_keys), "left_anti").withColumn("_left", F.lit(limit).cast("long"))
    found = at_time.select(
        *[F.col(k).alias(h) for h, k in zip(hot_keys, keys, strict=True)], "low", "high", (F.col("wanted") - F.col("before")).alias("_left")
    )
    placed = numbered.join(small(found), same(keys, hot_keys)).drop(*hot_keys)
    parts = [placed.where(F.col("_at") < F.col("low"))]
    cut = placed.where(F.col("_at").between(F.col("low"), F.col("high"))).drop("low", "high")
    if at_key is not None:
        found = at_key.select(
            *[F.col(k).alias(h) for h, k in zip(hot_keys, keys, strict=True)],
            "low", "high", (F.col("wanted") - F.col("before")).alias("_left_of_ties"),
        )
        cut = cut.join(small(found), same(keys, hot_keys), "left").drop(*hot_keys)
        parts.append(cut.where(F.col("_key_at") < F.col("low")))
        cut = cut.where(F.col("low").isNull() | F.col("_key_at").between(F.col("low"), F.col("high"))).withColumn(
            "_left", F.coalesce("_left_of_ties", "_left")
        )
    if slices is None:
        slices = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within_slice = Window.partitionBy(*keys, "_slice").orderBy(*_order(time, key))
    cut = cut.withColumn("_slice", F.spark_partition_id() % F.lit(slices))
    cut = cut.withColumn("_rank", F.row_number().over(within_slice)).where(F.col("_rank") <= F.col("_left"))
    to_rank = cut.select(*events.columns, "_left").unionByName(cold.select(*events.columns, "_left"))
    ranked = to_rank.withColumn("_rank", F.row_number().over(within_key)).where(F.col("_rank") <= F.col("_left"))
    return reduce(DataFrame.unionByName, [p.select(*events.columns) for p in [*parts, ranked]])


def _key_number(events: DataFrame, key: str) -> Column:
    """A whole number that falls where the identifier rises; equal for some identifiers. Null comes last."""
    kind = events.schema[key].dataType
    if isinstance(kind, T.StringType):
        opening = F.rpad(F.hex(F.substring(F.col(key).cast("binary"), 1, 6)), 12, "0")
        return F.coalesce(-F.conv(opening, 16, 10).cast("long"), F.lit(_LAST))
    if isinstance(kind, T.IntegralType):
        return F.coalesce(-F.col(key).cast("double"), F.lit(float(_LAST)))
    return F.lit(0).cast("long")
