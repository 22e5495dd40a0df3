"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm import common


def in_order(label: str):
    """Ids of each label by their hash."""
    return Window.partitionBy("label").orderBy(F.xxhash64(F.lit(label), "doc_id"), "doc_id")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int
) -> DataFrame:
    """(doc_id, label, text) of at most ``per_class`` rows for each label.

    Only rows outside the held-out fold take part, those with the smallest
    hash of the id first.  Null ids, labels and texts and labels other than 0
    and 1 are left out; an id that has several labels or texts counts with the
    smallest.
    """
    common.bounded_batches(docs.sparkSession)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(common.fold_of("doc_id", folds) != held)
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
    )
    ids = known.withColumn("at", F.row_number().over(in_order(label))).where(F.col("at") <= per_class)
    ids = common.durable(ids.select("doc_id", "label").coalesce(1), f"sample-{label}")
    # at most 2 * per_class rows of 12 bytes are broadcast
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    found = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return common.durable(found, f"texts-{label}")
