"""From raw documents to shards: quality, near-duplicates, decontamination, mixing, sharding.

In every stage columns other than doc_id, source, lang, n_chars and text pass
through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm import mixing, neardup, quality, sharding, templates
from larkspan.llm.common import drop, table

SHARDS = 40


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is at least a half; none without words (null texts), repeated rows alike."""
    return quality.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, a null id before all others; texts without words are one group."""
    return neardup.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or re-parameterised; null and empty texts stay, rows that share an id are judged by their own text."""
    return templates.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; a null source is a source, texts without words are not taken."""
    return mixing.draw(docs)


def kd_tree_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard; null ids, null or empty texts and equal rows are rows like others, no rows give no rows."""
    return sharding.assign(docs, SHARDS, name="shard" if "shard" not in docs.columns else "kd_shard")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", kd_tree_sharding),
]

#: A fitted model and exact set similarities cannot be put in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
