"""The corpus pipeline: five stages over the documents, each written and read again.

Language identification drops what has no language, near-duplicate removal keeps one
document of each group, decontamination drops documents that hold benchmark items, the
secret scan redacts its findings, and packing assigns what is left to sequences. Each stage
has the docstring of its operator for nulls, empty texts, ties, repeated rows and extra columns. The stages bound the rows that
the session sends to Python at once (``small_batches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefold.llm._text import discard, scratch, small_batches, table
from tracefold.llm.decontaminate import drop_contaminated
from tracefold.llm.lang_id import keep_identified
from tracefold.llm.near_dedup import drop_near_duplicates
from tracefold.llm.packing import pack_documents
from tracefold.llm.secret_scan import redact_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Trained classifiers, signatures and greedy packing are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of the documents that all stages keep.

    Each stage is written to the shared folder; what the next one has read is deleted, and the last with the session's end.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        place = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
        if before:
            discard(spark, before)
        before = place
    return docs
