"""Blend weights and fusion of overlapping tiles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.operators import regions

MODES = ("average", "feather", "center_weighted", "content_aware", "gain_compensated_feather")
WEIGHT_FLOOR = 1e-6


def blend_profile(size: int, overlap: int, mode: str = "feather", exponent: float = 1.0) -> list[float]:
    """Cosine ramp over min(overlap, size // 2) samples at both ends.

    The outermost weight is 0.  ``average`` is 1 everywhere and
    ``center_weighted`` doubles the exponent.
    """
    if mode not in MODES:
        raise ValueError(f"blend mode {mode!r}")
    profile = [1.0] * size
    width = 0 if mode == "average" else max(0, min(overlap, size // 2))
    for i in range(width):
        w = 0.5 - 0.5 * math.cos(math.pi * i / (width - 1)) if width > 1 else 0.0
        profile[i] = w
        profile[size - 1 - i] = min(profile[size - 1 - i], w)
    power = exponent * (2 if mode == "center_weighted" else 1)
    return [w**power for w in profile]


def profile_table(spark: SparkSession, shape: dict[str, int], overlap: dict[str, int], mode: str, exponent: float = 1.0) -> DataFrame:
    """(axis, i, w) of all axes."""
    rows = [(a, i, float(w)) for a, n in shape.items() for i, w in enumerate(blend_profile(n, overlap.get(a, 0), mode, exponent))]
    return spark.createDataFrame(rows, "axis string, i int, w double")


def profile_weight(shape: dict[str, int], overlap: dict[str, int], mode: str, exponent: float = 1.0) -> Column:
    """Product of the axis profiles at a voxel, as literal lookups."""
    weight = F.lit(1.0)
    for axis, size in shape.items():
        steps = F.array(*[F.lit(float(w)) for w in blend_profile(size, overlap.get(axis, 0), mode, exponent)])
        weight = weight * F.element_at(steps, F.col(axis) + 1)
    return weight


def cast_rounded(value: Column, low: int, high: int) -> Column:
    """Half-even rounding, then clipping to the range of the stored type."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.rint(value).cast("long"))).cast("int")


def fuse_translated(
    voxels: DataFrame, offsets: DataFrame, shape: dict[str, int], overlap: dict[str, int],
    mode: str = "feather", exponent: float = 1.0, limits: tuple[int, int] = (0, 65535), gains: DataFrame | None = None,
) -> DataFrame:
    """Weighted mean of tiles that are moved by whole voxels.

    ``offsets`` (p, oz, oy, ox) is one row per tile.  Where no weight falls
    the result is 0.  ``gains`` (t, p, gain, offset) are applied first.
    """
    rows = voxels.join(offsets, "p")
    value = F.col("v").cast("double")
    if gains is not None:
        rows = rows.join(gains, ["t", "p"])
        value = value * F.col("gain") + F.col("offset")
    placed = rows.select(
        "t", "c", *[(F.col(a) + F.col(f"o{a}")).alias(f"w{a}") for a in "zyx"],
        value.alias("v"), profile_weight(shape, overlap, mode, exponent).alias("w"),
    )
    sums = placed.groupBy("t", "c", "wz", "wy", "wx").agg(F.sum(F.col("v") * F.col("w")).alias("a"), F.sum("w").alias("w"))
    mean = F.when(F.col("w") > 0, F.col("a") / F.greatest("w", F.lit(WEIGHT_FLOOR))).otherwise(0.0)
    return sums.select("t", "c", F.col("wz").alias("z"), F.col("wy").alias("y"), F.col("wx").alias("x"), cast_rounded(mean, *limits).alias("v"))


def apply_gains(voxels: DataFrame, gains: DataFrame) -> DataFrame:
    """v * gain + offset by (t, p)."""
    joined = voxels.join(gains, ["t", "p"])
    return joined.select("t", "p", "c", "z", "y", "x", (F.col("v") * F.col("gain") + F.col("offset")).alias("v"))


def chunk_tile_pairs(chunks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Output chunks with the tiles whose boxes overlap them strictly.

    Both sides are dealt to cells of the size of the largest chunk.
    """
    size = chunks.agg(*[F.max(F.col(f"chunk_max_{a}") - F.col(f"chunk_min_{a}")).alias(a) for a in "xyz"]).first()
    bounds = {a: tuple(F.col(n) for n in (f"chunk_min_{a}", f"chunk_max_{a}", f"min_{a}", f"max_{a}")) for a in "xyz"}
    return regions.box_join(chunks, boxes, bounds, {a: size[a] or 1.0 for a in "xyz"})


def chunk_memory(chunks: DataFrame) -> DataFrame:
    """Bytes that rendering a chunk needs: (2 chunk + 4 source) float32."""
    return chunks.withColumn("bytes", (F.col("chunk_voxels") * 2 + F.col("source_voxels") * 4) * 4)


def stitch_profile(width: int, tile: int, tiles: int, overlap: float, floor: float) -> list[float]:
    """Cosine ramp from 0 to 1 on inner edges only, never below ``floor`` there.

    All ones for a single tile, no overlap or a width of one.  Weights are
    float32 values.
    """
    out = np.ones(width, np.float32)
    if tiles <= 1 or overlap <= 0 or width <= 1:
        return out.tolist()
    n = max(1, min(round(width * overlap), width - 1))
    ramp = np.maximum(0.5 - 0.5 * np.cos(np.linspace(0, np.pi, n, dtype=np.float32)), np.float32(min(max(floor, 0.0), 1.0)))
    if tile > 0:
        out[:n] = ramp
    if tile < tiles - 1:
        out[-n:] = ramp[::-1]
    return out.tolist()
