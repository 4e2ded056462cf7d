"""From raw documents to packed training sequences: five stages, each written to Parquet and read again as the next one's input.

Every stage but the last returns the columns of `documents`.  SQL cannot express the pipeline (a learned model and a
tokenizer take part).  tests/llm/test_pipeline.py holds each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm import mixing, ngram_join, packing, secret_scan, toxicity
from clauselake.llm.common import discard, durable, scratch, table
from clauselake.llm.queries import tokenizer_path

#: A document is rejected from this score on.
TOXIC = 0.7


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a factorization machine, fitted on `labels`, scores below TOXIC; null and empty texts stay unless the bias alone rejects them."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    rows = toxicity.scored(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), machine)
    return rows.where(F.col("score") < TOXIC).select("_doc.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles of similarity 0.8 or more connect."""
    return ngram_join.without_near_copies(docs, 5, 80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_scan.redacted_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1: a document once for each epoch that takes it, the one at the cut in part."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), max_epochs=3)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its sequence of at most 2048 tokens and its offset there."""
    return packing.pack_documents(docs, tokenizer_path(), 2048, 1)


STAGES = [("toxicity", without_toxic), ("ngram_join", without_copies), ("secrets", without_secrets), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(durable(stage(spark, docs, sf_dir)))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
