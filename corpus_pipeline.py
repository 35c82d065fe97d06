"""From raw documents to token ids: toxicity, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents; the last returns doc_id,
n_tokens and ids. Nulls, empty texts, repeated rows and empty tables have the results that the operators'
modules define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noteloom.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from noteloom.llm.common import stored, table

SIMILARITY, MATCHES = (80, 100), 4  # fewer than 4 of 32 coordinates collide at similarity 0.8 with probability 7e-7
SMOOTHING = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked at similarity 0.8 or more, the document with the smallest id stays."""
    return near_dedup.drop_near(docs, SIMILARITY, MATCHES)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of scarce domains are repeated, so that domains have their smoothed shares; none goes."""
    return mixing.mixed(docs, mixing.labelled_domains(docs, table(spark, sf_dir, "labels")), SMOOTHING)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

# A trained network and fitted rates are among the stages, so SQL cannot give run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
