"""Chunk grids, halos, crops, boxes and strided levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def axis_bounds(size: int, chunk: int) -> Column:
    """Half-open (start, stop) pairs that tile ``size``."""
    starts = F.sequence(F.lit(0), F.lit(max(0, size - 1)), F.lit(chunk))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + chunk, F.lit(size)).alias("stop")))


def chunk_grid(spark: SparkSession, shape: dict[str, int], chunks: dict[str, int]) -> DataFrame:
    """One row per chunk: <axis>_start, <axis>_stop for the axes of ``shape``."""
    grid = spark.range(1).select()
    for axis, size in shape.items():
        grid = grid.select("*", F.explode(axis_bounds(size, chunks.get(axis, size))).alias(f"_{axis}"))
    return grid.select(
        *[F.col(f"_{a}.{side}").cast("int").alias(f"{a}_{side}") for a in shape for side in ("start", "stop")]
    )


def expand_halo(grid: DataFrame, shape: dict[str, int], overlap: dict[str, int]) -> DataFrame:
    """Adds <axis>_read_start and <axis>_read_stop, clipped to the shape."""
    for axis, size in shape.items():
        grow = overlap.get(axis, 0)
        grid = grid.withColumn(f"{axis}_read_start", F.greatest(F.lit(0), F.col(f"{axis}_start") - grow))
        grid = grid.withColumn(f"{axis}_read_stop", F.least(F.lit(size), F.col(f"{axis}_stop") + grow))
    return grid


def core_mask(points: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Points with start <= coordinate < stop on every axis."""
    for axis, (start, stop) in bounds.items():
        points = points.where((F.col(axis) >= start) & (F.col(axis) < stop))
    return points


def replicate_to_chunks(voxels: DataFrame, shape: dict[str, int], chunks: dict[str, int], overlap: dict[str, int]) -> DataFrame:
    """Each voxel once for every chunk whose read region holds it.

    Adds <axis>_chunk.  Per axis a voxel can only lie in its own chunk or in
    neighbours within the overlap, so the copies are generated, not joined.
    """
    for axis, size in shape.items():
        chunk, grow = chunks.get(axis, size), overlap.get(axis, 0)
        last = (size - 1) // chunk
        low = F.greatest(F.lit(0), F.floor((F.col(axis) - grow) / chunk)).cast("int")
        high = F.least(F.lit(last), F.floor((F.col(axis) + grow) / chunk)).cast("int")
        voxels = voxels.withColumn(f"{axis}_chunk", F.explode(F.sequence(low, high)))
    return voxels


def stride_level(voxels: DataFrame, factors: dict[str, int]) -> DataFrame:
    """Nearest sampling: every f-th index of an axis, renumbered."""
    kept = voxels
    for axis, factor in factors.items():
        kept = kept.where(F.pmod(F.col(axis), F.lit(factor)) == 0)
    out = [
        F.floor(F.col(a) / factors[a]).cast("int").alias(a) if a in factors else F.col(a) for a in voxels.columns
    ]
    return kept.select(*out)


def expand_pyramid_factors(per_axis: list[list[int]]) -> list[tuple[int, ...]]:
    """Absolute factors by level; short lists repeat their last value."""
    if any(not f or f[0] != 1 for f in per_axis):
        raise ValueError("the first level must have factor 1 on every axis")
    levels: list[tuple[int, ...]] = []
    for i in range(max(map(len, per_axis))):
        level = tuple(f[min(i, len(f) - 1)] for f in per_axis)
        if not levels or level != levels[-1]:
            levels.append(level)
    return levels


def level_chunks(base: tuple[int, ...], shape: tuple[int, ...], factors: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(s, max(1, c // f)) for c, s, f in zip(base, shape, factors, strict=True))


def merge_boxes(boxes: DataFrame, keys: list[str], axes: str = "zyx") -> DataFrame:
    """Smallest box around the boxes of each key."""
    sides = [F.min(f"{a}_start").alias(f"{a}_start") for a in axes] + [F.max(f"{a}_stop").alias(f"{a}_stop") for a in axes]
    return boxes.groupBy(*keys).agg(*sides)


def grow_box(boxes: DataFrame, shape: dict[str, int], buffer: int) -> DataFrame:
    """Boxes grown by ``buffer``, clamped, at least one voxel wide."""
    for axis, size in shape.items():
        start = F.greatest(F.lit(0), F.least(F.col(f"{axis}_start") - buffer, F.lit(size - 1)))
        boxes = boxes.withColumn(f"{axis}_stop", F.greatest(start + 1, F.least(F.lit(size), F.col(f"{axis}_stop") + buffer)))
        boxes = boxes.withColumn(f"{axis}_start", start)
    return boxes


def crop_to_boxes(voxels: DataFrame, boxes: DataFrame, keys: list[str], axes: str = "zyx") -> DataFrame:
    """Voxels inside the box of their key."""
    joined = voxels.join(boxes, keys)
    for axis in axes:
        joined = joined.where((F.col(axis) >= F.col(f"{axis}_start")) & (F.col(axis) < F.col(f"{axis}_stop")))
    return joined.select(*voxels.columns)


def median_border(voxels: DataFrame, shape: dict[str, int], keys: list[str]) -> DataFrame:
    """The voxels with one more on every side that hold the key's median."""
    medians = voxels.groupBy(*keys).agg(F.percentile("v", F.lit(0.5)).alias("v"))
    padded = medians
    for axis, size in shape.items():
        padded = padded.withColumn(axis, F.explode(F.sequence(F.lit(-1), F.lit(size))))
    inside = F.lit(True)
    for axis, size in shape.items():
        inside = inside & (F.col(axis) >= 0) & (F.col(axis) < size)
    columns = [*keys, *shape, "v"]
    return voxels.select(*keys, *shape, F.col("v").cast("double").alias("v")).unionByName(padded.where(~inside).select(*columns))


def budget_stride(sizes: DataFrame, target: int) -> DataFrame:
    """Strides that bring nz*ny*nx*nt*np below ``target`` voxels.

    First one stride for z, y and x, then one for t and p.
    """
    volume = (F.col("nz") * F.col("ny") * F.col("nx")).cast("double")
    total = volume * F.col("nt") * F.col("np")
    stride = F.greatest(F.lit(1), F.ceil(F.cbrt(total / target) - 1e-9)).cast("int")
    with_s = sizes.withColumn("zyx_stride", F.when(total > target, stride).otherwise(1))
    left = F.lit(1.0)
    for axis in ("nz", "ny", "nx"):
        left = left * F.ceil(F.col(axis) / F.col("zyx_stride"))
    left = left * F.col("nt") * F.col("np")
    tp = F.greatest(F.lit(1), F.ceil(F.sqrt(left / target) - 1e-9)).cast("int")
    return with_s.withColumn("tp_stride", F.when(left > target, tp).otherwise(1))


def display_level(levels: DataFrame, budget: int) -> DataFrame:
    """First level within the voxel budget, else the last one."""
    fits = F.min(F.when(F.col("voxels") <= budget, F.col("level")))
    return levels.agg(F.coalesce(fits, F.max("level")).alias("level"))


def box_join(left: DataFrame, right: DataFrame, bounds: dict[str, tuple[Column, Column, Column, Column]], size: dict[str, float]) -> DataFrame:
    """Pairs of rows whose half-open boxes overlap; touching boxes do not.

    ``bounds`` names for each axis the left box's start and stop and the right
    one's.  Both sides are dealt to cells of ``size``, so this is a join on
    equal keys; a pair is kept in the cell of its overlap's first corner.
    """
    match = F.lit(True)
    for a, (l0, l1, r0, r1) in bounds.items():
        step = F.lit(float(size[a]))
        left = left.select("*", F.explode(F.sequence(F.floor(l0 / step), F.floor(l1 / step))).alias(f"_l{a}"))
        right = right.select("*", F.explode(F.sequence(F.floor(r0 / step), F.floor(r1 / step))).alias(f"_r{a}"))
    for a, (l0, l1, r0, r1) in bounds.items():
        corner = F.floor(F.greatest(l0, r0) / F.lit(float(size[a])))
        match = match & (F.col(f"_l{a}") == F.col(f"_r{a}")) & (F.col(f"_l{a}") == corner) & (l0 < r1) & (l1 > r0)
    return left.join(right, match).drop(*[f"_{side}{a}" for side in "lr" for a in bounds])
