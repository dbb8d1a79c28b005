"""A training corpus from raw documents: the stages, in order.

The whole run: an empty table, or one of which the rules reject every document, gives no
rows and the same columns.  Null and empty texts have no words and go with the rules.
Repeated rows are one document from the second stage on; the mix then repeats rows by its
targets.  Null ids and sources are values like others.  Further columns of `documents`
pass through, whatever their names, except `shard`, which the last stage sets.  Very long
texts are judged, compared, searched and mixed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratagrade.llm import mixing, rules, sharding, similarity_join, tiling
from stratagrade.llm.cluster import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules reject go; the others lose the lines that fail."""
    return rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (5-word shingles, Jaccard 0.8 or more)."""
    return similarity_join.representatives(docs, words=5, similarity=(80, 100))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a test item go."""
    return tiling.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source is repeated or thinned to its target weight."""
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows get a shard; equal texts share one."""
    return sharding.with_shard(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mix sources", mix_sources),
    ("shard", shard),
]

ORACLE_SQL = None  # greedy tiling and longest-first scheduling have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "pipeline")
    return docs
