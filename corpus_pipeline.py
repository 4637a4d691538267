"""A training-corpus pipeline: five stages over `documents`, each kept as Parquet before the next reads it.

Each stage takes (spark, docs, sf_dir) and returns all that it keeps; all but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, exact_dedup, mixing, near_dedup, quality
from palimpsest.session import materialize, ship, table


#: Rows of an Arrow batch, held by the JVM and by Python at once: a tenth of Spark's own, for whole documents are large rows.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier fitted on the labelled ones among them doesn't reject."""
    small_batches(spark)
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the largest id."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a resemblance of 0.8 on five-word shingles: that with the smallest id."""
    small_batches(spark)
    return near_dedup.keep(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, taken once or taken twice."""
    return mixing.repeat(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    small_batches(spark)
    encoded = bpe.encode(docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")), "byte_bpe_50k.json")
    return encoded.select("doc_id", "source", "n_tokens", "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mix sources", mix_stage),
    ("encode", encode_stage),
]

#: A fitted model, sketches and an encoder: SQL can't express the stages; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
