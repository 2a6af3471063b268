"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkward.llm.common import unit_interval

THRESHOLD = 0.3
# Likelihood ratio from which a term is a feature; noise hardly ever reaches it.
TELLING = 12.0

_WORDS = re.compile(r"[^\W\d_]+")

# Voters known beforehand: insults in four languages, and manners of writing.
_LEXICONS = {
    "insults": ["idiot", "stupid", "moron", "fool", "dumb", "imbecile", "jerk"],
    "contempt": ["pathetic", "worthless", "disgusting", "loser", "scum", "trash", "garbage", "clown", "filth", "vermin"],
    "threats": ["kill", "hate", "destroy", "hurt"],
    "german": ["dumm", "trottel", "abschaum", "versager", "widerlich", "dreck"],
    "french": ["imbécile", "crétin", "ordure", "minable", "dégoûtant", "abruti"],
    "spanish": ["estúpido", "imbécil", "basura", "inútil", "asqueroso", "escoria"],
}
_PATTERNS = [
    re.compile(r"!{2,}"),
    re.compile(r"\b[A-Z]{5,}\b(?:\W+[A-Z]{3,}\b){2}"),
    re.compile(r"\b(?:you|du|tu|vous|usted)\b\W+(?:\w+\W+){0,2}(?:are|bist|es|êtes|eres)\b", re.I),
    re.compile(r"\w[*#@$]{2,}\w*"),
]
FIXED = len(_LEXICONS) + len(_PATTERNS)
_FIXED_TERMS = [frozenset(zlib.crc32(w.encode()) for w in words) for words in _LEXICONS.values()]


@dataclass
class Model:
    """Features as sorted hashes with weights, weights of the dense features, and a constant."""

    terms: np.ndarray
    weights: np.ndarray
    lexicon: np.ndarray  # of each term its log odds if it is a voter, else 0
    dense: np.ndarray
    constant: float


def terms_of(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct words of a text and of the openings of its longer words."""
    words = set(_WORDS.findall(text.lower())) if text else set()
    stems = {word[:4] + "*" for word in words if len(word) > 4}
    found = {zlib.crc32(term.encode()) for term in words} | {zlib.crc32(term.encode()) for term in stems}
    return np.sort(np.fromiter(found, np.int64, len(found)))


def fixed_votes(text: str | None, terms: np.ndarray) -> np.ndarray:
    """Which of the voters known beforehand call a text toxic."""
    present = set(terms.tolist())
    lexicons = [not present.isdisjoint(words) for words in _FIXED_TERMS]
    return np.array(lexicons + [bool(text and p.search(text)) for p in _PATTERNS], dtype=np.int8)


def label_model(votes: np.ndarray, gold: np.ndarray, weight: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Posterior probability of the label behind ``votes`` (rows x voters: 1 a vote, 0 an abstention).

    Each voter has a rate of voting under either label, which the votes alone
    estimate (expectation maximisation). Beside the voters given there is one that
    votes where all others abstain, and the given label votes for either side; it may
    err, and is the start. An abstention says nothing. Voters that go together under the
    same label say less than their number: each counts by one over one plus its
    correlations with the others.
    """
    votes = np.column_stack([votes, ~votes.any(axis=1), gold == 1, gold == 0]).astype(float)
    posterior = np.where(gold == 1, 0.95, 0.02)
    # Abstentions say nothing, so votes can't tell how common either label is: the labels do.
    share_of_one = np.clip((weight * gold).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    prior = np.log(share_of_one / (1 - share_of_one))
    for _ in range(rounds):
        sums = np.array([(weight * (1 - posterior)).sum(), (weight * posterior).sum()])
        rates = np.stack([(weight * (1 - posterior)) @ votes, (weight * posterior) @ votes])
        rates = (rates + 0.5 * votes.mean(axis=0)) / (sums[:, None] + 0.5)
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        expected = posterior[:, None] * rates[1] + (1 - posterior[:, None]) * rates[0]
        rest = (votes - expected) * np.sqrt(weight)[:, None]
        spread = np.sqrt((rest**2).sum(axis=0)) + 1e-9
        correlation = (rest.T @ rest) / spread[:, None] / spread[None, :]
        np.fill_diagonal(correlation, 0)
        share = 1 / (1 + np.maximum(correlation - 0.05, 0).sum(axis=1))
        share[-2:] = 1  # its two sides are one voter
        logit = prior + votes @ (np.log(rates[1] / rates[0]) * share)
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior


def _dense(lexicon: np.ndarray, hits: np.ndarray, starts: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Per row: how many lexicon voters fire, whether any and whether several do, and the fixed voters."""
    fired = np.append(lexicon[hits], 0.0) > 0
    count = np.zeros(len(fixed))
    if len(hits):
        sums = np.add.reduceat(fired.astype(float), np.minimum(starts, len(hits)))
        count = np.where(np.diff(np.append(starts, len(hits))) > 0, sums, 0.0)
    return np.column_stack([np.log1p(count), count > 0, count > 1, fixed]).astype(float)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column,
    rows_per_label: int = 5_000,
    voters: int = 300,
    terms: int = 20_000,
) -> Model:
    """The model of ``docs (doc_id, text)`` and ``labels (doc_id, toxic)`` where ``learnable`` holds.

    About ``rows_per_label`` rows of each label are taken by a hash of the identifier and
    weigh for the others; a list of those is small enough to broadcast, so texts are
    not shuffled. What reaches the driver is their hashed terms. Of the terms with at
    least three rows the ``terms`` that tell the labels apart best are features, and of
    those at home in toxic texts ``voters`` become lexicon voters beside the fixed ones. Rows
    of one identifier with different labels count as toxic; a label that is null or
    neither 0 nor 1 is none.

    Without rows of both labels every text scores 0 or, if all are toxic, 1.
    """
    label = F.col("toxic").try_cast("int")
    given = labels.where(label.isin(0, 1) & learnable).groupBy("doc_id").agg(F.max(label).alias("toxic"))
    total = {int(r["toxic"]): r["count"] for r in given.groupBy("toxic").count().collect()}
    if len(total) < 2:
        empty = np.zeros(0)
        return Model(empty.astype(np.int64), empty, empty, np.zeros(3 + FIXED), 40.0 if 1 in total else -40.0)
    rate = F.when(F.col("toxic") == 1, rows_per_label / total[1]).otherwise(rows_per_label / total[0])
    chosen = given.where(unit_interval(F.col("doc_id")) < rate)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [terms_of(text) for text in batch["text"]]
            fixed = [fixed_votes(text, own).tolist() for text, own in zip(batch["text"], found, strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "terms": found, "fixed": fixed})

    identifier = docs.schema["doc_id"].dataType.simpleString()
    table = sample.mapInPandas(
        features, f"doc_id {identifier}, toxic int, terms array<bigint>, fixed array<tinyint>"
    ).orderBy("doc_id").toArrow()
    gold = table["toxic"].to_numpy().astype(int)
    present = np.bincount(gold, minlength=2)
    if min(present) == 0:
        empty = np.zeros(0)
        return Model(empty.astype(np.int64), empty, empty, np.zeros(3 + FIXED), 40.0 if present[1] else -40.0)
    weight = np.array([total[0] / present[0], total[1] / present[1]])[gold]
    weight = weight / weight.mean()
    lists = table["terms"].combine_chunks()
    flat, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    rows = np.repeat(np.arange(len(gold)), np.diff(starts))
    fixed = np.array(table["fixed"].to_pylist(), dtype=np.int8).reshape(len(gold), FIXED)
    return learn(gold, weight, flat, rows, fixed, voters, terms)


def learn(
    gold: np.ndarray, weight: np.ndarray, flat: np.ndarray, rows: np.ndarray, fixed: np.ndarray,
    voters: int, terms: int,
) -> Model:
    """The model of a sample: its labels, their weights, all terms with their rows, and the fixed votes."""
    names, which, count = np.unique(flat, return_inverse=True, return_counts=True)
    # How surprising a term's share of toxic rows is: its likelihood ratio.
    share = gold.mean()
    toxic = np.bincount(which, gold[rows], len(names))
    expected = count * share
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (
            np.where(toxic > 0, toxic * np.log(toxic / expected), 0.0)
            + np.where(toxic < count, (count - toxic) * np.log((count - toxic) / (count - expected)), 0.0)
        )
    told = np.flatnonzero((count >= 3) & (ratio >= TELLING))
    told = np.sort(told[np.argsort(-ratio[told], kind="stable")[:terms]])
    place = np.full(len(names), -1)
    place[told] = np.arange(len(told))
    column = place[which]
    rows, column = rows[column >= 0], column[column >= 0]
    names, toxic, clean, ratio = names[told], toxic[told], (count - toxic)[told], ratio[told]

    all_toxic, all_clean = gold.sum(), (1 - gold).sum()
    odds = np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((clean + 0.5) / (all_clean + 1))
    strong = np.flatnonzero(odds > np.log(5))
    strong = strong[np.argsort(-ratio[strong], kind="stable")[:voters]]
    lexicon = np.zeros(len(names))
    lexicon[strong] = odds[strong]

    at = np.full(len(names), -1)
    at[strong] = np.arange(len(strong))
    votes = np.zeros((len(gold), len(strong)), dtype=np.int8)
    votes[rows[at[column] >= 0], at[column][at[column] >= 0]] = 1
    posterior = label_model(np.column_stack([votes, fixed]), gold, weight)

    first = np.searchsorted(rows, np.arange(len(gold)))
    dense = _dense(lexicon, column, first, fixed)
    return _classifier(names, lexicon, rows, column, dense, posterior, weight)


def _classifier(
    names: np.ndarray, lexicon: np.ndarray, rows: np.ndarray, column: np.ndarray,
    dense: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 150, penalty: float = 1e-4,
) -> Model:
    """Logistic regression on posterior labels by gradient steps scaled per weight."""
    count = len(target)
    sparse, solid, constant = np.zeros(len(names)), np.zeros(dense.shape[1]), np.log(target.mean() / (1 - target.mean()))
    moved = [np.full(len(names), 1e-8), np.full(dense.shape[1], 1e-8), 1e-8]
    share = weight / weight.sum()
    for _ in range(rounds):
        logit = constant + dense @ solid + np.bincount(rows, sparse[column], count)
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) * share
        slopes = [
            np.bincount(column, error[rows], len(names)) + penalty * sparse,
            error @ dense + penalty * solid,
            error.sum(),
        ]
        moved = [m + s**2 for m, s in zip(moved, slopes, strict=True)]
        sparse = sparse - 0.1 * slopes[0] / np.sqrt(moved[0])
        solid = solid - 0.3 * slopes[1] / np.sqrt(moved[1])
        constant = constant - 0.3 * slopes[2] / np.sqrt(moved[2])
    return Model(names, sparse, lexicon, solid, float(constant))


def toxicity(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """A column with the score from 0 to 1 of a text; null and empty texts get the constant's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            scores = []
            for value in batch:
                own = terms_of(value)
                place = np.searchsorted(model.terms, own)
                place = place[place < len(model.terms)] if len(model.terms) else place[:0]
                hits = place[model.terms[place] == own[: len(place)]]
                fixed = fixed_votes(value, own)[None, :]
                dense = _dense(model.lexicon, hits, np.zeros(1, dtype=int), fixed)[0]
                logit = model.constant + dense @ model.dense + model.weights[hits].sum()
                scores.append(1 / (1 + np.exp(-np.clip(logit, -40, 40))))
            yield pd.Series(scores, dtype=float)

    return score(text)


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs (doc_id, text)``.

    Whole texts count. A null or empty text has no votes and no terms. Repeated rows
    score alike. Other columns are ignored; an empty table gives an empty result.
    """
    scored = docs.select("doc_id", toxicity(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
