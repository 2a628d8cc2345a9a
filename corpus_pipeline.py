"""A training corpus from raw documents: quality, near copies, benchmark leaks, secrets, packed sequences.

Every stage works on all rows its predecessor kept; all but the last return the columns of ``documents``.
A stage's result is written to the shared folder and read back, so a lost executor never goes further back
than the stage it worked on. ``ORACLE_SQL`` is None: the learned classifier and the tokenizer have no SQL;
tests/llm hold the pipeline against a plain restatement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from diffgauge.llm import decontaminate, ngram_join, quality, queries, secret_scan
from diffgauge.llm.common import store, table
from diffgauge.session import ship


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model rates as good; it learns from the labels of the documents given."""
    return quality.keep(docs, queries.quality_model(docs, ship(spark), sf_dir))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word n-grams, Jaccard similarity 0.8 or more."""
    ship(spark)
    return ngram_join.keep_one(docs)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, table(ship(spark), sf_dir, "benchmark"))


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    ship(spark)
    return secret_scan.redact(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    ship(spark)
    return queries.packed(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", unseen_documents),
    ("secret scans", redacted_documents),
    ("packing", packed_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
