"""Documents with everything that may go wrong in them."""

from __future__ import annotations

import pytest

ODD = [
    (1, "A cat sat on the mat and looked out", "en", "a", "x"),
    (1, "A cat sat on the mat and looked out", "en", "a", "x"),
    (2, "a  cat\tsat on the mat and looked out", None, None, "x"),
    (3, None, "en", "b", None),
    (4, "", "en", "b", "y"),
    (5, " \n\t ", None, "b", "y"),
    (6, "word", "de", None, None),
    (7, "12 34 !!", "de", "c", "z"),
    (8, "idiot " * 3 + "long " * 60_000, "en", "c", "z"),
    (None, "a text without an identifier", "en", "c", None),
    (9, "A cat sat on the mat and looked out", "en", "a", "x"),
    (2, "another text under the same identifier", "en", "a", "x"),
    (10, "Größe \u3000 <|text|> \U0001f600 <\\|role", "de", "a", "x"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, kept string, row string, size string, id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those of the operators."""
    return spark.createDataFrame([(*r, "row", "size", "id") for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
