"""Policy decisions over a whole log of SQL statements or access requests.

Every rule is a Column on the request's own row: no decision needs a shuffle,
a join or Python code, whatever the size of the log.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkward.functions.globs import glob_to_regex, matches_any
from sparkward.functions.sqltext import (
    LEADING_WORDS,
    clean_sql,
    forbidden_words,
    has_more_statements,
    sql_words,
    table_references,
)
from sparkward.functions.text import quoted, quoted_names
from sparkward.operators.selection import BROADCAST_ROWS, met
from sparkward.session import discard, local_frame, stored

# The reasons, in the order they are tested.
EMPTY = "Empty query"
NO_WORDS = "No SQL tokens found"
WRONG_START = "Statement must start with SELECT or WITH, found '%s'"
FORBIDDEN = "Forbidden keyword(s) present: %s"
SEVERAL = "Multiple statements are not permitted"
READ_ONLY = "Statement is read-only"
NAMES_OFF_LIST = "Table(s) %s are not in the allow-list (preflight check)"
NO_TABLE = "Query does not reference any resolvable table"
TABLE_OFF_LIST = "Table %s is not in the allow-list"
TOO_LARGE = "Estimated %s bytes exceeds ceiling of %s"
PASSED = "Query passed all guardrails"
ACCESS_DENIED = "%s %s is not in the allow-list"
ACCESS_ALLOWED = "%s is allow-listed"

# Of this library alone: a request whose scan nobody estimated.
NOT_ESTIMATED = "Query has no estimate of the bytes scanned"

_BITMAP = T.StructType([T.StructField("bits", T.ArrayType(T.LongType()))])
PATTERN_SCHEMA = T.StructType([T.StructField("pattern", T.StringType(), False)])

PREFLIGHT, AUTHORIZE = "preflight", "authorize"


@dataclass(frozen=True)
class Policy:
    """What requests may touch. Empty pattern lists allow nothing.

    Ceilings default to 10 GB scanned and 10,000 rows returned; ``max_rows=None``
    returns results whole.
    """

    tables: Sequence[str] = field(default_factory=tuple)
    buckets: Sequence[str] = field(default_factory=tuple)
    dags: Sequence[str] = field(default_factory=tuple)
    max_bytes: int = 10_000_000_000
    max_rows: int | None = 10_000
    read_only: bool = True

    def __post_init__(self) -> None:
        for name in ("max_bytes", "max_rows"):
            if getattr(self, name) is not None and getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")


class PolicyDenied(Exception):
    """A single request was denied."""

    def __init__(self, reason: str, event_id: str | None = None) -> None:
        super().__init__(reason)
        self.reason = reason
        self.event_id = event_id


def _unless_empty(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0)) > 0


def classify_sql(
    log: DataFrame, *, mode: str = "strict", extra_words: list[str] | None = None
) -> DataFrame:
    """Add ``cleaned``, ``words``, ``forbidden``, ``read_only`` and ``sql_reason``.

    Each step is its own projection, so that the text is cleaned and split once
    per row rather than once per rule. A null statement counts as empty.
    """
    steps = (
        log.withColumn("cleaned", clean_sql(F.coalesce(F.col("sql"), F.lit("")), mode))
        .withColumn("words", sql_words(F.col("cleaned")))
        .withColumn("forbidden", forbidden_words(F.col("words"), extra_words))
    )
    first = F.get(F.col("words"), F.lit(0))
    refusal = (
        F.when(F.col("cleaned") == "", F.lit(EMPTY))
        .when(F.size("words") == 0, F.lit(NO_WORDS))
        .when(~first.isin(LEADING_WORDS), F.format_string(WRONG_START, first))
        .when(
            F.size("forbidden") > 0, F.format_string(FORBIDDEN, quoted_names(F.col("forbidden")))
        )
        .when(has_more_statements(F.col("cleaned")), F.lit(SEVERAL))
    )
    return (
        steps.withColumn("refusal", refusal)
        .withColumn("read_only", F.col("refusal").isNull())
        .withColumn("sql_reason", F.coalesce("refusal", F.lit(READ_ONLY)))
        .drop("refusal")
    )


def _not_allowed(names: Column, patterns: Sequence[str]) -> Column:
    return F.filter(names, lambda name: ~matches_any(name, patterns))


def _read_only_refusal(policy: Policy) -> Column:
    if not policy.read_only:
        return F.lit(None).cast("string")
    return F.when(~F.col("read_only"), F.col("sql_reason"))


def _with_preflight(classified: DataFrame, policy: Policy) -> DataFrame:
    named = classified.withColumn("candidate_tables", table_references(F.col("sql"))).withColumn(
        "off_list", _not_allowed(F.col("candidate_tables"), policy.tables)
    )
    off_list = F.when(
        _unless_empty(F.col("off_list")),
        F.format_string(NAMES_OFF_LIST, quoted_names(F.col("off_list"))),
    )
    return named.withColumn("preflight_reason", F.coalesce(_read_only_refusal(policy), off_list))


def _with_refusal(judged: DataFrame, policy: Policy) -> DataFrame:
    """First reason to refuse, in order: not read-only, no table, table, bytes."""
    off_list = _not_allowed(F.col("referenced_tables"), policy.tables)
    first, estimated = F.col("first_off_list"), F.col("estimated_bytes")
    refusal = F.coalesce(
        _read_only_refusal(policy),
        F.when(~_unless_empty(F.col("referenced_tables")), F.lit(NO_TABLE)),
        F.when(first.isNotNull(), F.format_string(TABLE_OFF_LIST, quoted(first))),
        F.when(
            estimated > policy.max_bytes,
            F.format_string(TOO_LARGE, estimated.cast("string"), F.lit(str(policy.max_bytes))),
        ),
        F.when(estimated.isNull(), F.lit(NOT_ESTIMATED)),
    )
    # A name that is null can be matched by no pattern either.
    first_off_list = F.get(F.transform(off_list, lambda n: F.coalesce(n, F.lit(""))), F.lit(0))
    return judged.withColumn("first_off_list", first_off_list).withColumn("refusal", refusal)


def judge_text(
    log: DataFrame,
    policy: Policy,
    *,
    mode: str = "strict",
    extra_words: list[str] | None = None,
) -> DataFrame:
    """First phase: add what the text alone says, for ``judge_estimate``.

    ``preflight_reason`` is the denial; null defers to the second phase.
    """
    classified = classify_sql(log, mode=mode, extra_words=extra_words)
    return _with_preflight(classified, policy).drop("cleaned", "words", "forbidden", "off_list")


def judge_estimate(judged: DataFrame, policy: Policy) -> DataFrame:
    """Second phase: one decision per request from ``judge_text`` and an estimate."""
    refused = _with_refusal(judged, policy).withColumn(
        "refusal", F.coalesce("preflight_reason", "refusal")
    )
    stopped = F.col("preflight_reason").isNotNull()
    by_names = stopped & F.col("read_only") if policy.read_only else stopped
    return (
        _decision(refused)
        .withColumn("phase", F.when(stopped, F.lit(PREFLIGHT)).otherwise(F.lit(AUTHORIZE)))
        .withColumn("candidate_tables", F.when(by_names, F.col("candidate_tables")))
        .drop("preflight_reason", "read_only", "sql_reason", "first_off_list")
    )


def decide(
    log: DataFrame,
    policy: Policy,
    *,
    mode: str = "strict",
    extra_words: list[str] | None = None,
) -> DataFrame:
    """Both phases, one decision per request.

    Adds ``phase`` (where the decision fell), ``allowed``, ``decision``,
    ``reason`` and ``candidate_tables`` (set where they were the reason). A
    request denied by its text never reaches the second phase.
    """
    return judge_estimate(judge_text(log, policy, mode=mode, extra_words=extra_words), policy)


def preflight(
    log: DataFrame,
    policy: Policy,
    *,
    mode: str = "strict",
    extra_words: list[str] | None = None,
) -> DataFrame:
    """The first phase alone: adds ``candidate_tables`` and ``preflight_reason``.

    A preflight never allows: names found in text prove nothing.
    """
    judged = judge_text(log, policy, mode=mode, extra_words=extra_words)
    return judged.drop("read_only", "sql_reason")


def authorize(
    log: DataFrame,
    policy: Policy,
    *,
    mode: str = "strict",
    extra_words: list[str] | None = None,
) -> DataFrame:
    """The second phase alone: text, ``referenced_tables`` and ``estimated_bytes``."""
    classified = classify_sql(log, mode=mode, extra_words=extra_words)
    return _decision(_with_refusal(classified, policy)).drop(
        "cleaned", "words", "forbidden", "read_only", "sql_reason", "first_off_list"
    )


def _decision(judged: DataFrame, passed: str = PASSED) -> DataFrame:
    allowed = F.col("refusal").isNull()
    return judged.withColumns(
        {
            "allowed": allowed,
            "decision": F.when(allowed, F.lit("allowed")).otherwise(F.lit("denied")),
            "reason": F.coalesce("refusal", F.lit(passed)),
        }
    ).drop("refusal")


def _decide_access(
    requests: DataFrame, column: str, patterns: Sequence[str], noun: str
) -> DataFrame:
    asked = quoted(F.coalesce(F.col(column), F.lit("")))
    denied = F.when(
        ~matches_any(F.col(column), patterns), F.format_string(ACCESS_DENIED, F.lit(noun), asked)
    )
    return _decision(requests.withColumn("refusal", denied), ACCESS_ALLOWED % noun)


def decide_buckets(requests: DataFrame, policy: Policy, column: str = "bucket") -> DataFrame:
    """Access decisions for reading object buckets."""
    return _decide_access(requests, column, policy.buckets, "Bucket")


def decide_dags(requests: DataFrame, policy: Policy, column: str = "dag_id") -> DataFrame:
    """Access decisions for starting or inspecting pipeline runs."""
    return _decide_access(requests, column, policy.dags, "DAG")


def split_decisions(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The allowed and the denied requests."""
    return decisions.where("allowed"), decisions.where("NOT allowed")


def require_allowed(decision: DataFrame) -> None:
    """Raise for a single denied request (one row)."""
    row = decision.select("allowed", "reason").first()
    if row is None or not row["allowed"]:
        raise PolicyDenied(row["reason"] if row else "No decision")


def reference_counts(log: DataFrame) -> DataFrame:
    """How often each table is named in the log.

    Names are counted before any shuffle, so a table named in a third of all
    statements costs no more than another.
    """
    return (
        log.select(F.explode(table_references(F.col("sql"))).alias("table_name"))
        .groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )


@F.pandas_udf(T.StringType())
def _regex_of(patterns: pd.Series) -> pd.Series:
    return patterns.map(glob_to_regex)


# Lengths of the literal pieces that an entry may be filed under.
_PIECES = (1, 2, 3, 6)

# So many entries with wildcards are tested as they are.
_FEW_ENTRIES = 50

# A piece that more names hold is dealt over several tasks.
_NAMES_PER_TASK = 10_000

# Bits of a filter: so many for each number in it, and at most 8 MB.
_BITS_PER_NUMBER, _MOST_BITS = 16, 1 << 26


def _literals(pattern: Column) -> Column:
    """The texts between an entry's wildcards; a bracket that is never closed is text."""
    return F.split(F.regexp_replace(pattern, r"\[!?+(?s:.)[^\]]*+\]|[*?]", "\u0000"), "\u0000")


def _numbered(kind: int, piece: Column) -> Column:
    """A piece as a number. Two pieces of one number cost a test more, no more."""
    return F.xxhash64(F.lit(kind), piece)


def _pieces_of(text: Column, n: int) -> Column:
    """The numbers of all pieces of ``n`` characters; the length is their kind."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    pieces = F.transform(starts, lambda at: _numbered(n, F.substring(text, at, F.lit(n))))
    return F.when(F.length(text) >= n, pieces).otherwise(F.array().cast("array<long>"))


# Kinds of pieces beside those of a length: a name begins with it, ends with it, or anything (the empty piece).
_BEGINS, _ENDS, _ANY = -1, -2, 0


def _filed(wild: DataFrame) -> DataFrame:
    """Every piece that an entry could be filed under: ``(pattern, kind, number)``.

    A name that the entry allows begins with its first literal text, ends with its last and holds
    every piece of all of them. Longer pieces are held by fewer names.
    """
    literals = _literals(F.col("pattern"))

    def of_kind(kind: int, numbers: Column) -> Column:
        return F.transform(F.array_distinct(numbers), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("number")))

    def end(kind: int, at: int) -> Column:
        text = F.element_at(literals, at)
        return F.when(text != "", F.array(_numbered(kind, text))).otherwise(F.array().cast("array<long>"))

    def inner(n: int, longer: int) -> Column:
        fitting = F.filter(literals, lambda text: (F.length(text) >= n) & (F.length(text) < longer))
        return F.flatten(F.transform(fitting, lambda text: _pieces_of(text, n)))

    # Of each literal text the pieces of the greatest length that it has.
    longer = [*_PIECES[1:], 2**31 - 1]
    kinds = [of_kind(_BEGINS, end(_BEGINS, 1)), of_kind(_ENDS, end(_ENDS, -1))]
    kinds += [of_kind(n, inner(n, m)) for n, m in zip(_PIECES, longer, strict=True)]
    every = F.concat(*kinds)
    nothing = F.array(F.struct(F.lit(_ANY).alias("kind"), _numbered(_ANY, F.lit("")).alias("number")))
    return wild.select("pattern", F.inline(F.when(F.size(every) > 0, every).otherwise(nothing)))


def _probes(named: DataFrame, kinds: Sequence[int], wanted: DataFrame) -> DataFrame:
    """Every piece of a name, of the kinds that entries are filed under: ``(table_name, number)``.

    Of the pieces that are not ``wanted`` (column ``number``, stored) a bitmap lets few through.
    """
    name, length = F.col("table_name"), F.length("table_name")
    cut = {_BEGINS: lambda n: F.left(name, n), _ENDS: lambda n: F.right(name, n)}

    def of_kind(kind: int) -> Column:
        if kind in _PIECES:
            return _pieces_of(name, kind)
        if kind == _ANY:
            return F.array(_numbered(kind, F.lit("")))
        return F.transform(F.sequence(F.lit(1), length), lambda n: _numbered(kind, cut[kind](n)))

    every = F.array_distinct(F.concat(*[of_kind(kind) for kind in kinds]))
    probes = named.where(length > 0).select("table_name", F.explode(every).alias("number"))
    return probes.where(_maybe_in(wanted, F.col("number")))


def _places(number: Column, words: int) -> tuple[Column, Column]:
    """Where a number's bit is: the word and the place in it."""
    return F.pmod(F.shiftright(number, 6), F.lit(words)).cast("int"), number.bitwiseAND(63).cast("int")


def _maybe_in(wanted: DataFrame, number: Column) -> Column:
    """True for every number in a stored table (column ``number``), and for few others."""
    bits = min(max(_BITS_PER_NUMBER * wanted.count(), 64), _MOST_BITS)
    words = 1 << max((bits - 1).bit_length() - 6, 0)
    word, bit = _places(F.col("number"), words)
    filled = wanted.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    filled = filled.toArrow()
    bitmap = np.zeros(words, np.int64)
    bitmap[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    # Read back from the shared folder, so that no plan holds it.
    table = stored(local_frame(wanted.sparkSession, _BITMAP, [(bitmap,)]), "bitmap")
    word, bit = _places(number, words)
    return F.getbit(F.get(table.select("bits").scalar(), word), bit) == 1


def _allowed_by_length(named: DataFrame, shapes: DataFrame) -> DataFrame:
    """Names allowed by entries of nothing but ``*`` and ``?``: these say how long a name is."""
    signs = F.length(F.replace("pattern", F.lit("*")))
    starred = F.col("pattern").contains("*")
    # One number per length that an entry asks for.
    asked = F.struct(
        F.min(F.when(starred, signs)).alias("least"), F.collect_set(F.when(~starred, signs)).alias("exactly")
    )
    asked, length = shapes.agg(asked.alias("asked")).scalar(), F.length("table_name")
    return named.where((length >= asked["least"]) | F.array_contains(asked["exactly"], length)).select("table_name")


def allow_list_report(
    names: DataFrame,
    patterns: DataFrame,
    *,
    few_entries: int = _FEW_ENTRIES,
    names_per_task: int = _NAMES_PER_TASK,
    few_pieces: int = BROADCAST_ROWS,
) -> DataFrame:
    """Match names (column ``table_name``) against an allow-list that is a table.

    Entries (column ``pattern``) may be of any number, with or without wildcards. Those without
    are joined by equality. Up to ``few_entries`` others are a condition on the name alone. Of more,
    those of nothing but ``*`` and ``?`` are one condition on the length, and each other is filed
    under the one literal piece of it that the fewest names hold: the text before its first or behind
    its last wildcard, or a piece of up to six characters from anywhere. Names look up their own
    pieces, those that a bitmap of the filed ones lets through, and are tested against the entries filed there. An entry with a piece that no name
    holds allows none. A piece held by more than ``names_per_task`` names is dealt over several
    tasks, and up to ``few_pieces`` pieces are broadcast. Entries of brackets and wildcards alone are
    filed under the empty piece, which every name but the empty one holds. A null name is allowed
    by none.
    """
    is_wild = F.col("pattern").rlike(r"[*?\[]")
    entries = patterns.select("pattern").where(F.col("pattern").isNotNull()).distinct()
    plain = entries.where(~is_wild).select(F.col("pattern").alias("table_name"))
    wild = entries.where(is_wild)
    named = names.select("table_name").where(F.col("table_name").isNotNull()).distinct()
    short = [row["pattern"] for row in wild.limit(few_entries + 1).collect()]
    if len(short) <= few_entries:
        found = named.where(matches_any(F.col("table_name"), short))
    else:
        found = _looked_up(stored(named, "named"), wild, names_per_task, few_pieces)
    listed = plain.union(found).distinct().withColumn("listed", F.lit(True))
    # Never broadcast: a list just short enough for Spark takes five times its size in the driver.
    return names.join(listed.hint("merge"), "table_name", "left").select(
        *names.columns, F.coalesce("listed", F.lit(False)).alias("allowed")
    )


def _looked_up(named: DataFrame, wild: DataFrame, names_per_task: int, few_pieces: int) -> DataFrame:
    """Names that an entry with wildcards allows, by an index of the entries' literal pieces."""
    of_length = F.col("pattern").rlike(r"\A[*?]+\z")
    filed = stored(_filed(wild.where(~of_length)), "filed")
    by_length = _allowed_by_length(named, wild.where(of_length))
    # At most one row per kind of piece.
    kinds = sorted(row["kind"] for row in filed.select("kind").distinct().collect())
    if not kinds:
        discard(filed)
        return by_length
    wanted = stored(filed.select("number").distinct(), "wanted")
    # Only pieces that some entry has are counted, before any shuffle.
    held = _probes(named, kinds, wanted).groupBy("number").agg(F.count(F.lit(1)).alias("held"))
    held = stored(held, "held")
    # An entry with a piece that no name holds allows none: that piece is the rarest of all.
    known = met(filed, held, ["number"], "left", few=few_pieces)
    rarest = F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "kind", "number")).alias("rarest")
    chosen = known.groupBy("pattern").agg(rarest).select("pattern", "rarest.*").where("held > 0")
    parts = F.ceil(F.col("held") / F.lit(names_per_task)).cast("int").alias("parts")
    chosen = stored(chosen.select("kind", "number", parts, _regex_of("pattern").alias("regex")), "chosen")
    discard(filed, wanted, held)
    kinds = sorted(row["kind"] for row in chosen.select("kind").distinct().collect())
    if not kinds:
        return by_length
    places = stored(chosen.select("number", "parts").distinct(), "places")
    several = stored(places.where("parts > 1"), "several")
    probes = met(_probes(named, kinds, places), several, ["number"], "left", few=few_pieces)
    part = F.pmod(F.xxhash64("table_name"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    dealt = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Its files tell too little of its size to let Spark choose the join.
    found = (
        probes.select("table_name", "number", part)
        .join(dealt.drop("parts", "kind").hint("merge"), ["number", "part"])
        .where(F.rlike(F.col("table_name"), F.col("regex")))
        .select("table_name")
    )
    return found.union(by_length)
