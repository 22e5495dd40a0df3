"""The opN_<name> queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import decontamination, langid, lm, mixing, neardup, quality, sharding, tokencounts, toxicity, vectorsearch
from voxelloom.llm.common import fold_of, table


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorsearch.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        (fold_of("doc_id", toxicity.FOLDS) == toxicity.HELD).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_texts(table(spark, sf_dir, "documents"))
    return scored.select(
        "doc_id",
        (fold_of("doc_id", lm.FOLDS) == lm.HELD).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.rollup_documents(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=3)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        (fold_of("doc_id", quality.FOLDS) == quality.HELD).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify_languages(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        (fold_of("doc_id", langid.FOLDS) == langid.HELD).alias("held_out"),
        "lang_pred", "score", "rejected",
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_top_k,
        op2_source_mixing,
        op3_toxicity,
        op4_lm_scoring,
        op5_decontamination,
        op6_token_counts,
        op7_minhash_near_dedup,
        op8_sharding,
        op9_quality_classifier,
        op10_language_id,
    )
}
