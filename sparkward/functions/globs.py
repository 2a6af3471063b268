"""Glob patterns as Columns.

``*`` is any run of characters (dots included), ``?`` any one character,
``[abc]``, ``[a-c]`` and ``[!abc]`` one character in or out of a set. Matching
is case-sensitive and covers the whole value.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_WILD = "*?["


def _literal(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def _one_of(members: str, negated: bool) -> str:
    """Regex of a bracket set; a range whose ends are reversed is empty."""
    parts = []
    at = 0
    while at < len(members):
        if at + 2 < len(members) and members[at + 1] == "-":
            low, high = members[at], members[at + 2]
            if low <= high:
                parts.append(f"{_literal(low)}-{_literal(high)}")
            at += 3
        else:
            parts.append(_literal(members[at]))
            at += 1
    if not parts:
        return "." if negated else r"(?!)"
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def _runs(pattern: str) -> list[str]:
    """Regexes of the pieces between the stars (one more piece than stars)."""
    runs, current, at = [], "", 0
    while at < len(pattern):
        char = pattern[at]
        at += 1
        if char == "*":
            runs.append(current)
            current = ""
        elif char == "?":
            current += "."
        elif char == "[":
            negated = pattern[at : at + 1] == "!"
            start = at + negated
            end = pattern.find("]", start + 1)
            if end < 0:
                current += _literal("[")
            else:
                current += _one_of(pattern[start:end], negated)
                at = end + 1
        else:
            current += _literal(char)
    return [*runs, current]


def glob_to_regex(pattern: str) -> str:
    """Java regex of a glob, to be matched against the whole value.

    Each inner piece is taken at its first place and never reconsidered, so
    the cost does not explode with the number of stars.
    """
    first, *rest = _runs(pattern)
    if not rest:
        return f"(?s)\\A{first}\\z"
    inner = "".join(f"(?>.*?{run})" for run in rest[:-1] if run)
    return f"(?s)\\A{first}{inner}.*{rest[-1]}\\z"


def matches_any(value: Column, patterns: Iterable[str]) -> Column:
    """True if the value matches a pattern; no pattern, or a null value: false.

    Plain names become one set lookup and ``prefix*`` a prefix test; only the
    other patterns are regexes.
    """
    names, prefixes, others = [], [], []
    for pattern in dict.fromkeys(patterns):
        if not any(c in pattern for c in _WILD):
            names.append(pattern)
        elif pattern.endswith("*") and not any(c in pattern[:-1] for c in _WILD):
            prefixes.append(pattern[:-1])
        else:
            others.append(pattern)
    tests = [value.isin(names)] if names else []
    tests += [F.startswith(value, F.lit(prefix)) for prefix in prefixes]
    tests += [value.rlike(glob_to_regex(pattern)) for pattern in others]
    if not tests:
        return F.lit(False)
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))
