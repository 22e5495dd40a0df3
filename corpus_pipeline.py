"""Training-corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept and returns documents again; the last one deals them to shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelloom.llm import common, decontamination, mixing, neardup, quality, sharding


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality probability reaches the threshold."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return neardup.remove_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontamination.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier and the sketches have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again.

    What a stage wrote on its way goes when its result stands, and so does the
    result before it.
    """
    docs = common.table(spark, sf_dir, "documents")
    first = common.written()
    for name, stage in STAGES:
        docs = common.durable(stage(spark, docs, sf_dir), f"stage-{name}")
        common.release(first, keep=docs)
    return docs
