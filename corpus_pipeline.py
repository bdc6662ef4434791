"""Corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, packing.

Each stage reads what the one before kept, as a written table. Rows with a null text count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doctopics.llm.base import materialise, table
from doctopics.llm.decontaminate import drop_contaminated
from doctopics.llm.minhash_dedup import drop_near_duplicates
from doctopics.llm.packing import pack_documents
from doctopics.llm.q_text import tokenizer_path
from doctopics.llm.quality import keep_good, trusted_documents
from doctopics.llm.substring_dedup import cut_repeats
from doctopics.runtime import ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels")
    return keep_good(docs, trusted_documents(labels), toxic=labels)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents of which nothing is left go."""
    ship_package(spark)
    return cut_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    ship_package(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    ship_package(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Hashing, tokenising and packing have no SQL; tests/llm/test_pipeline.py checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn to ``documents``, each result written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
