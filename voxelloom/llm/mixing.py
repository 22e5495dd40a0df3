"""Operator 2 - mixing sources to target weights (DataFrame operations only).

Every document gets a hash-random key.  Within a source the keys are range
bucketed, token counts are summed per bucket, prefix sums run over the bucket
totals and then inside each bounded bucket, and the source is cut at its exact
token budget; a budget above the source's size repeats it as further epochs.

Defined results
    * null source: a source of its own, ranked last; null text: size 0.
    * empty table: no rows.  Sources without words: target and taken 0.
    * ties of the key are ordered by id and size, so reruns agree; repeated
      rows are separate documents.
    * other columns of the input are kept by :func:`mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm import common

#: Weights that the sources, in code point order, take in turn.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words.
SHARE = 1.5
#: No source is taken more often than this.
MAX_EPOCHS = 2
SEED = "mix-1"


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("skey"),
        size.alias("size"),
        common.order_key(F.lit(SEED), F.col(id_col)).alias("k"),
    )


def source_targets(
    sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """Targets of (skey, source, source_size): weighted shares below the caps.

    One row for each source is ordered in one task, as the contract's turns of
    weights need; sources are meant to be named parts of a corpus, not hosts.

    Sources in the order of cap / weight are filled up to their caps until the
    common level fits; that is where repeated resharing ends.
    """
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    turn = (F.row_number().over(whole) - 1) % len(weights) + 1
    table = (
        sources.withColumn("rank", F.row_number().over(whole))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn).cast("long"))
        .withColumn("cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every).cast("double") * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double"))
        .withColumn("w_rest", F.sum("weight").over(rest).cast("double"))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("w_rest"))
        .withColumn("pos", F.row_number().over(by_ratio))
        .withColumn("stop", F.min(F.when(F.col("ratio") > F.col("level"), F.col("pos"))).over(every))
        .withColumn("final", F.max(F.when(F.col("pos") == F.col("stop"), F.col("level"))).over(every))
    )
    target = F.when(
        F.col("stop").isNull() | (F.col("pos") < F.col("stop")), F.col("cap").cast("double")
    ).otherwise(F.col("weight") * F.col("final"))
    return table.select("skey", "source_size", target.alias("target"), "cap")


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, copies.

    ``taken`` cuts each source at its exact word budget (the document at the
    cut counts in part); ``copies`` is the number of whole copies, the one at
    the cut being rounded to whole or none.
    """
    base = common.durable(_sized(docs, id_col, text_col, source_col), "mix-sized")
    buckets = common.bucket_count(base.count())
    base = base.withColumn("bucket", common.bucket_of(F.col("k"), buckets))
    cells = base.groupBy("skey", "bucket").agg(
        F.sum("size").alias("cell_total"), F.first("source").alias("cell_source")
    )
    sources = cells.groupBy("skey").agg(
        F.sum("cell_total").alias("source_size"), F.first("cell_source").alias("source")
    )
    targets = source_targets(sources, weights, share, max_epochs)
    cells = cells.drop("cell_source").join(targets, "skey")
    rows = common.with_running(base, cells, "skey", ["k", "doc_id", "size"], "size", "prefix")
    quota = F.least(F.round("target").cast("long"), F.col("cap"))
    epochs = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs).withColumn(
        "part", F.greatest(F.lit(0), F.least("size", quota - F.col("epochs") * F.col("source_size") - F.col("prefix")))
    )
    half = (F.col("part") > 0) & (F.col("part") * 2 >= F.col("size"))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        (F.col("epochs") + half.cast("long")).alias("copies"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed documents: each row of ``docs``, once for each whole copy.

    Rows without words have nothing to weigh and stay once.  A repeated id is
    weighed as one document of the largest of its copies.
    """
    plan = plan_mix(docs, id_col=id_col, **options)
    copies = plan.groupBy(F.col("doc_id").alias("_mix_id")).agg(
        F.max(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).cast("int").alias("_mix_copies")
    )
    joined = docs.join(copies, F.col(id_col).eqNullSafe(F.col("_mix_id")))
    repeated = joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_mix_copies"), F.lit(1)))))
    return repeated.where("_mix_copies > 0").select(*[F.col(f"`{c}`") for c in docs.columns])
