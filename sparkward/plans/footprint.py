"""What a statement would read, from Spark's own EXPLAIN; nothing is run."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkward.session import local_frame

# Fixed value: US dollars per TiB scanned.
PRICE_PER_TIB = 6.25
_TIB = 1024.0**4

_UNITS = {"B": 0, "KiB": 1, "MiB": 2, "GiB": 3, "TiB": 4, "PiB": 5, "EiB": 6}
_TREE = r"^[\s:|+\-]*"
_LEAF = re.compile(
    _TREE + r"(?:Relation|RelationV2|HiveTableRelation|InMemoryRelation|LogicalRDD|Range)\b"
    r".*?Statistics\(sizeInBytes=([0-9.E+]+) (\w+)"
)
_VIEW = re.compile(_TREE + r"View \((.+?), \[")
_NAMED = re.compile(_TREE + r"(?:Relation|RelationV2|HiveTableRelation)(?:\[[^\]]*\])? ([\w`.]+)\[?")
_NODE = re.compile(_TREE + r"'?(\w+)")
# What the root of a query can be, and what must occur nowhere: commands, writes,
# and the clause that pipes rows through a shell.
_QUERY_ROOTS = {
    "Aggregate", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate",
    "GlobalLimit", "HiveTableRelation", "InMemoryRelation", "Intersect", "Join", "LocalLimit",
    "LocalRelation", "LogicalRDD", "Offset", "OneRowRelation", "Project", "Range",
    "RebalancePartitions", "Relation", "RelationV2", "Repartition", "RepartitionByExpression",
    "Sample", "Sort", "Tail", "Union", "Window", "WindowGroupLimit", "WithCTE",
}
_REFUSED = re.compile(
    r"\w*Command|InsertInto\w*|\w+Into\w*Statement|AppendData|Overwrite\w+|ReplaceData|WriteDelta"
    r"|DeleteFrom\w+|Update\w+|Merge\w+|CreateTable\w*|ReplaceTable\w*|ScriptTransformation"
)
# However the name was written in the statement.
_JVM_CALL = re.compile(r"(?i)\b(?:(?:try_)?reflect|java_method)\(")

_ALL_TITLES = [
    "Parsed Logical Plan", "Analyzed Logical Plan", "Optimized Logical Plan", "Physical Plan",
]

_FORMATS = {"parquet", "orc", "json", "csv", "text", "avro", "binaryFile"}


_FOOTPRINT = T.StructType(
    [
        T.StructField("statement", T.StringType()),
        T.StructField("estimated_bytes", T.LongType()),
        T.StructField("referenced_tables", T.ArrayType(T.StringType())),
    ]
)


class NotEstimable(Exception):
    """Spark cannot plan the statement, or it is no query."""


@dataclass(frozen=True)
class Footprint:
    """Bytes and tables a statement would read. The bytes are an upper bound:
    whole files, whichever columns and rows are needed."""

    estimated_bytes: int
    referenced_tables: tuple[str, ...]

    @property
    def cost_usd(self) -> float:
        return round(self.estimated_bytes / _TIB * PRICE_PER_TIB, 6)


def cost_usd(scanned_bytes: Column) -> Column:
    """Price of a scan in US dollars, to six decimals, ties to even."""
    return F.bround(scanned_bytes / F.lit(_TIB) * F.lit(PRICE_PER_TIB), 6)


def _sections(session: SparkSession, kind: str, sql: str, titles: list[str]) -> list[list[str]]:
    """Lines of the sections of a plan, in order; the last title only ends one.

    A string or a name in the statement may hold any text, a whole plan
    included. It can add lines, and with them tables and bytes, but it cannot
    take a line away or move a section: a title that occurs twice is refused.
    """
    text = session.sql(f"EXPLAIN {kind} {sql}").first()[0]
    marks = [f"== {title} ==" for title in titles]
    if any(text.count(mark) != 1 for mark in marks):
        raise NotEstimable(text.strip().split("\n", 1)[0])
    found = []
    for mark, following in zip(marks, marks[1:]):
        found.append(text.split(mark, 1)[1].split(following, 1)[0].strip("\n").split("\n"))
    return found


def _plain(name: str) -> str:
    return name.strip().strip("`").replace("`.`", ".")


def estimate(session: SparkSession, sql: str) -> Footprint:
    """Footprint of a statement in a session, without running it."""
    _, analyzed, _ = _sections(session, "EXTENDED", sql, _ALL_TITLES)
    (optimized,) = _sections(session, "COST", sql, _ALL_TITLES[2:])
    if "AnalysisException" in analyzed[0]:
        raise NotEstimable(analyzed[0])
    root = _NODE.match(optimized[0])
    nodes = [found.group(1) for found in map(_NODE.match, analyzed + optimized) if found]
    if root is None or root.group(1) not in _QUERY_ROOTS or any(map(_REFUSED.fullmatch, nodes)):
        raise NotEstimable("Statement is not a plain query")
    if any(map(_JVM_CALL.search, analyzed + optimized)):
        raise NotEstimable("Statement calls a method of the JVM")
    tables: dict[str, None] = {}
    for line in analyzed:
        found = _VIEW.match(line)
        if found:
            tables[_plain(found.group(1))] = None
            continue
        found = _NAMED.match(line)
        if found and found.group(1) not in _FORMATS:
            tables[_plain(found.group(1))] = None
    scanned = 0
    for line in optimized:
        found = _LEAF.match(line)
        if found:
            scanned += round(float(found.group(1)) * 1024 ** _UNITS[found.group(2)])
    return Footprint(scanned, tuple(tables))


def footprint_frame(spark: SparkSession, footprints: Mapping[str, Footprint]) -> DataFrame:
    """Footprints of named statements as rows, with their cost."""
    rows = [
        (name, found.estimated_bytes, list(found.referenced_tables))
        for name, found in footprints.items()
    ]
    return local_frame(spark, _FOOTPRINT, rows).withColumn(
        "estimated_cost_usd", cost_usd(F.col("estimated_bytes"))
    )
