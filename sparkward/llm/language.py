"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkward.llm.common import in_chunks, unit_interval

UNDETERMINED = "und"
BUCKETS = 1 << 16
ORDERS = (2, 3)

_LETTER = re.compile(r"[^\W\d_]")
# Everything in ASCII but letters parts words; other bytes belong to letters.
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


@dataclass
class Model:
    """Log-probabilities of buckets per language, and of the languages."""

    languages: list[str]
    grams: np.ndarray  # languages x BUCKETS
    priors: np.ndarray


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of the hashed n-grams of each text.

    Lower-cased words, each between blanks, as bytes; n-grams don't cross words.
    """
    padded = [b" " + b" ".join(text.translate(_SPACED).split()) + b" " for text in texts]
    data = np.frombuffer(b"".join(padded), dtype=np.uint8).astype(np.uint32)
    lengths = np.array([len(p) for p in padded])
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    blank = data == 32
    keys = []
    for order in ORDERS:
        code = np.full(max(0, len(data) - order + 1), order, dtype=np.uint32)
        for i in range(order):
            code = code * np.uint32(0x01000193) ^ data[i : len(data) - order + 1 + i]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
        inside = row[: len(code)] == row[order - 1 :][: len(code)]
        for i in range(1, order - 1):
            inside &= ~blank[i : len(blank) - order + 1 + i]
        if order == 2:
            inside &= ~(blank[:-1] & blank[1:])
        keys.append(row[: len(code)][inside] * BUCKETS + code[inside])
    found, count = np.unique(np.concatenate(keys), return_counts=True)
    return found // BUCKETS, found % BUCKETS, count


def fit(docs: DataFrame, learnable: Column, rows_per_language: int = 20_000, alpha: float = 0.1) -> Model:
    """The model of ``docs (doc_id, text, lang)`` where ``learnable`` holds and ``lang`` is not null.

    Of a language with more than ``rows_per_language`` rows about so many are taken,
    chosen by a hash of the identifier. Counts per language and bucket are summed in
    Spark; what reaches the driver is one matrix of languages by buckets, whatever
    the input. A null text is empty. Without rows the model knows no language.
    """
    rows = docs.where(learnable & F.col("lang").isNotNull())
    per_language = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    counts = {r["lang"]: r["rows"] for r in per_language.collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    sampled = rows.join(F.broadcast(per_language), "lang").where(
        unit_interval(F.col("doc_id")) * F.col("rows") < rows_per_language
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                total = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for _, texts in in_chunks([t.lower() if t else t for t in part["text"]]):
                    _, bucket, n = gram_counts(texts)
                    np.add.at(total, bucket, n)
        for lang, total in sums.items():
            bucket = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": total[bucket]})

    summed = (
        sampled.select("lang", "text").mapInPandas(count, "lang string, bucket bigint, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("grams"))
    )
    matrix = np.zeros((len(languages), BUCKETS))
    for row in summed.toLocalIterator():
        pairs = np.array(row["grams"], dtype=np.int64)
        matrix[languages.index(row["lang"]), pairs[:, 0]] = pairs[:, 1]
    matrix += alpha
    grams = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    rows_seen = np.array([counts[lang] for lang in languages], dtype=float)
    return Model(languages, grams, np.log(rows_seen / rows_seen.sum()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs (doc_id, text)``.

    ``lang_pred`` is the language with the highest posterior (of equal ones the
    first by code point) and ``score`` that posterior; whole texts count. A text that
    is null or has no letter, and any text if the model knows no language, is ``und``
    with score 0. Repeated rows are predicted alike. Other columns are ignored; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, priors = shared.value.languages, shared.value.priors
        by_bucket = np.ascontiguousarray(shared.value.grams.T)
        for batch in batches:
            lang, score = [], []
            for _, texts in in_chunks([t.lower() if t and _LETTER.search(t) else None for t in batch]):
                total = np.tile(priors, (len(texts), 1))
                row, bucket, count = gram_counts(texts)
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                if len(starts) and languages:
                    total[row[starts]] += np.add.reduceat(by_bucket[bucket] * count[:, None], starts)
                for text, sums in zip(texts, total, strict=True):
                    if not text or not languages:
                        lang.append(UNDETERMINED)
                        score.append(0.0)
                        continue
                    best = int(np.argmax(sums))
                    lang.append(languages[best])
                    score.append(float(1 / np.exp(sums - sums[best]).sum()))
            yield pd.DataFrame({"lang": lang, "score": score})

    return docs.select("doc_id", classify("text").alias("p")).select(
        "doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )
