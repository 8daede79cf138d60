"""The corpus pipeline: quality, language, exact dedup, near-dedup, packing.

Each stage takes what its predecessor kept, read again from Parquet.  The models of the first two
stages learn from the corpus tables of ``sf_dir`` under the same held-out rule as their queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalens.llm import exact_dedup, language, packing, quality, simhash
from stratalens.llm.common import forget, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted good (score of at least quality.THRESHOLD)."""
    return quality.keep_good(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter go, as do those far from every prototype."""
    return language.keep_known(docs, language.train(table(spark, sf_dir, "documents")), least_score=language.FAR)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the least doc_id."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id."""
    return simhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("language", language_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("packing", packing_stage)]
#: Compression, cosines and tokenisation have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{k}-{name.replace(' ', '-')}")
        if k:
            forget(before)
    return docs
