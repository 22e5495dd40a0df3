"""Acquisition files, stage rows and keyframes as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom import functions as V


def index_files(paths: DataFrame) -> DataFrame:
    """path with t, p, c; the first path of each key stays."""
    marks = V.tiff_indices(F.col("path"))
    return paths.select("path", *[m.alias(a) for a, m in marks.items()]).groupBy("t", "p", "c").agg(F.min("path").alias("path"))


def missing_keys(files: DataFrame) -> DataFrame:
    """Combinations of the t, p and c that occur for which no file exists."""
    axes = [files.select(a).distinct() for a in "tpc"]
    grid = axes[0].join(axes[1]).join(axes[2])  # distinct indices only
    return grid.join(files.select("t", "p", "c"), ["t", "p", "c"], "left_anti")


def stage_rows(payload: DataFrame) -> DataFrame:
    """(row, x, y, z, theta, f) from JSON arrays, header row optional.

    Short rows and values that are not finite become 0.
    """
    rows = payload.select(F.posexplode(F.from_json("payload", "array<array<string>>")).alias("at", "cells"))
    head = F.upper(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))) == "X"
    rows = rows.where(~head | (F.col("at") > 0))
    number = F.row_number().over(Window.orderBy("at")) - 1

    def cell(i: int):
        v = F.get("cells", F.lit(i)).try_cast("double")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)

    return rows.select(number.alias("row"), *[cell(i).alias(n) for i, n in enumerate(("x", "y", "z", "theta", "f"))])


def frame_specs(keyframes: DataFrame, hold: int, transition: int) -> DataFrame:
    """Frames of a movie: (frame, start, end, alpha).

    Each keyframe shows once and is held; the gap to the next one has
    ``transition`` frames (or the keyframe's own ``gap``) at (k+1)/(n+1).
    """
    order = Window.orderBy("keyframe")
    gaps = keyframes.withColumn("next", F.lead("keyframe").over(order)).withColumn(
        "n", F.when(F.col("next").isNull(), 0).otherwise(F.greatest(F.lit(0), F.coalesce("gap", F.lit(transition))))
    )
    still = gaps.select("keyframe", F.col("keyframe").alias("end"), F.explode(F.sequence(F.lit(0), F.lit(hold))).alias("k"), F.lit(0.0).alias("alpha"))
    moving = gaps.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    moving = moving.select("keyframe", F.col("next").alias("end"), (F.col("k") + hold + 1).alias("k"), ((F.col("k") + 1) / (F.col("n") + 1)).alias("alpha"))
    frames = still.unionByName(moving)
    return frames.select((F.row_number().over(Window.orderBy("keyframe", "k")) - 1).alias("frame"), F.col("keyframe").alias("start"), "end", "alpha")


def frame_gaps(files: DataFrame) -> DataFrame:
    """Places where frame_%06d files do not count up from 0."""
    n = F.regexp_extract("path", r"frame_(\d{6})\.png$", 1).try_cast("int")
    rows = files.select(n.alias("n")).where("n IS NOT NULL")
    return rows.withColumn("before", F.coalesce(F.lag("n").over(Window.orderBy("n")), F.lit(-1))).where("n <> before + 1")
