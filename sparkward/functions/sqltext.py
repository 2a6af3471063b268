"""Judging SQL text with Columns: is it read-only, and which tables does it name?

These are lexical rules that err towards refusing. Patterns use possessive
quantifiers, so that a literal of any length needs no deep regex stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading words allowed, words forbidden anywhere.
LEADING_WORDS = ["SELECT", "WITH"]
FORBIDDEN_WORDS = [
    "INSERT", "UPDATE", "DELETE", "MERGE", "DROP", "CREATE", "ALTER",
    "TRUNCATE", "GRANT", "REVOKE", "CALL", "EXEC", "EXECUTE", "REPLACE",
]

# Functions with which a SELECT could reach any static method of the JVM:
# forbidden in statements that this Spark itself is going to run.
JVM_CALL_WORDS = ["REFLECT", "JAVA_METHOD", "TRY_REFLECT"]

# Everything that counts as white space in Unicode text.
_SPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_SINGLE_QUOTED = r"'(?:[^'\\]|\\[^\n])*+'"
_DOUBLE_QUOTED = r'"(?:[^"\\]|\\[^\n])*+"'
_LINE_COMMENT = r"--[^\n]*+"
_BLOCK_COMMENT = r"(?s:/\*.*?\*/)"
_STRING_QUOTES = r"(')(?:[^'\\]|\\[^\n])*+'" + r'|(")(?:[^"\\]|\\[^\n])*+"'
_QUOTED_NAME = r"(`[^`]*+`)"
_TOKEN = r"[A-Z_][A-Z0-9_]*+"
_TABLE = r"(?iu)(?:FROM|JOIN)" + _SPACE_CLASS + r"++`?([A-Za-z0-9_.-]++)`?"


def strip_spaces(text: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.trim(text, F.lit(_SPACES))


def clean_sql(sql: Column, mode: str = "strict") -> Column:
    """Statement without comments and string contents.

    ``strict`` reads strings, quoted names and comments from left to right in
    one pass, so none of them can start inside another. ``compat`` removes
    block comments, then line comments, then strings; there a ``--`` inside a
    string hides whatever follows it on the line, and so a second statement can
    pass unseen.
    """
    if mode == "strict":
        one_pass = f"{_STRING_QUOTES}|{_QUOTED_NAME}|{_LINE_COMMENT}|{_BLOCK_COMMENT}"
        # A string leaves its two quotes, a name stays, a comment becomes a space.
        return strip_spaces(F.regexp_replace(sql, one_pass, "$1$1$2$2$3 "))
    if mode != "compat":
        raise ValueError(f"Unknown mode {mode!r}; expected 'strict' or 'compat'")
    text = F.regexp_replace(sql, _BLOCK_COMMENT, " ")
    text = F.regexp_replace(text, _LINE_COMMENT, " ")
    return strip_spaces(F.regexp_replace(text, f"{_SINGLE_QUOTED}|{_DOUBLE_QUOTED}", "''"))


def sql_words(cleaned: Column) -> Column:
    """Identifiers and key words in upper case, in order."""
    return F.regexp_extract_all(F.upper(cleaned), F.lit(_TOKEN), F.lit(0))


def forbidden_words(words: Column, extra: list[str] | None = None) -> Column:
    """Forbidden words present, distinct and sorted."""
    banned = F.array(*[F.lit(word) for word in FORBIDDEN_WORDS + (extra or [])])
    return F.sort_array(F.array_intersect(words, banned))


def has_more_statements(cleaned: Column) -> Column:
    """A semicolon is left after those at the end."""
    return F.contains(F.rtrim(cleaned, F.lit(";")), F.lit(";"))


def table_references(sql: Column) -> Column:
    """Names after FROM and JOIN, distinct, in first-seen order.

    Reads the raw text: names in comments and strings count, CTE names count,
    and the second table of ``FROM a, b`` is missed.
    """
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(_TABLE), F.lit(1)))
