"""Flat-field profiles and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-6


def mean_profile(voxels: DataFrame) -> DataFrame:
    """(p, c, y, x, flat, dark): pixel means over the channel's mean, dark 0.

    An approximation of a fitted illumination profile.
    """
    pixel = voxels.groupBy("p", "c", "y", "x").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("p", "c")
    mean = F.sum("s").over(whole) / F.sum("n").over(whole)
    return pixel.select("p", "c", "y", "x", (F.col("s") / F.col("n") / mean).alias("flat"), F.lit(0.0).alias("dark"))


def baseline_profile(voxels: DataFrame) -> DataFrame:
    """(p, c, t, z, baseline): plane means minus the channel's mean."""
    plane = voxels.groupBy("p", "c", "t", "z").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("p", "c")
    mean = F.sum("s").over(whole) / F.sum("n").over(whole)
    return plane.select("p", "c", "t", "z", (F.col("s") / F.col("n") - mean).alias("baseline"))


def apply_flatfield(voxels: DataFrame, profile: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(v - dark) / max(flat, 1e-6), less the baseline where given."""
    joined = voxels.join(profile, ["p", "c", "y", "x"])
    value = (F.col("v") - F.col("dark")) / F.greatest(F.col("flat"), F.lit(FLOOR))
    if baseline is not None:
        joined = joined.join(baseline, ["p", "c", "t", "z"])
        value = value - F.col("baseline")
    return joined.select("t", "p", "c", "z", "y", "x", value.alias("v"))


def feather_weights(length: int, left_core: int, right_core: int) -> list[float]:
    """Ramp weights of one tile axis: linear outside the core, floor 1e-3."""
    left = max(0, left_core)
    right = min(length, max(left, right_core))
    tail = length - right
    out = []
    for i in range(max(1, length)):
        w = 1.0
        if i < left:
            w = (i + 1) / (left + 1)
        if i >= right and tail > 0:
            w = 1.0 - (i - right + 1) / (tail + 1)
        out.append(max(w, 1e-3))
    return out


def blended_profile(tiles: DataFrame) -> DataFrame:
    """Weighted mean of overlapping tile profiles: (p, c, y, x, w, value)."""
    sums = tiles.groupBy("p", "c", "y", "x").agg(F.sum(F.col("value") * F.col("w")).alias("a"), F.sum("w").alias("w"))
    return sums.select("p", "c", "y", "x", (F.col("a") / F.greatest("w", F.lit(FLOOR))).alias("value"), F.col("w").alias("weight"))


def tile_weights(shape_yx: tuple[int, int], core_yx: tuple[tuple[int, int], tuple[int, int]]) -> list[list[float]]:
    """Weights of one tile's pixels: the product of the weights along y and x."""
    rows, columns = (feather_weights(n, *core) for n, core in zip(shape_yx, core_yx, strict=True))
    return [[a * b for b in columns] for a in rows]


def identity_profile(voxels: DataFrame) -> DataFrame:
    """(p, c, y, x, flat, dark): 1 and 0 everywhere, for positions whose fit failed."""
    return voxels.select("p", "c", "y", "x").distinct().select("*", F.lit(1.0).alias("flat"), F.lit(0.0).alias("dark"))


def with_fallback(tiles: DataFrame, failed: DataFrame, fallback: DataFrame) -> DataFrame:
    """Tile profiles (tile, p, c, y, x, w, value) in which every tile of a (p, c)
    that ``failed`` names holds the fallback profile (p, c, y, x, value), so that
    the blended profile equals it."""
    bad = failed.select("p", "c").distinct()
    kept = tiles.join(bad, ["p", "c"], "left_anti")
    replaced = tiles.join(bad, ["p", "c"]).drop("value").join(fallback, ["p", "c", "y", "x"])
    return kept.select("tile", "p", "c", "y", "x", "w", "value").unionByName(replaced.select("tile", "p", "c", "y", "x", "w", "value"))
