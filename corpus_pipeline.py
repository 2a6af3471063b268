"""A training corpus from raw documents, as a chain of stages over Parquet tables.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written and read again as the ``docs`` of the next. All but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import exact_dedup, minhash_dedup, mixing, packing, toxicity
from sparkward.llm.common import original, remainder, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Learnt without the held-out labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, remainder("doc_id", 4) != 2)
    packed = docs.select(F.struct("*").alias("row"), toxicity.toxicity(model, docs).alias("score"))
    kept = packed.where(F.col("score") < toxicity.THRESHOLD)
    return kept.select(*original(kept, "row", ()))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest identifier."""
    packed = docs.select("doc_id", "text", F.struct("*").alias("whole"))
    kept = exact_dedup.mark_copies(packed).where("kept")
    return kept.select(*original(kept, "whole", ()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: smallest identifier, null last, then smallest hash of the text.

    Rows are told apart by their place in the table: another text under the identifier of a
    near copy stays. Texts without words are no copies and all stay.
    """
    return minhash_dedup.one_per_component(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, each for itself also where rows share an identifier."""
    return mixing.taken_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in token sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# The first stage is a trained classifier and the last a tokenizer: SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, beginning with the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
