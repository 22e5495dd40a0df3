"""Maximum projections and resampling of their z axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT = {"xy": ("y", "x"), "xz": ("z", "x"), "yz": ("z", "y")}


def max_projection(voxels: DataFrame, projection: str) -> DataFrame:
    """Maximum over the axis that the projection drops; p is kept."""
    a, b = KEPT[projection]
    return voxels.groupBy("t", "p", "c", a, b).agg(F.max("v").alias("v"))


def all_projections(voxels: DataFrame) -> DataFrame:
    """The three projections in one scan: (projection, t, p, c, a, b, v)."""
    faces = F.array(
        *[F.struct(F.lit(n).alias("projection"), F.col(a).alias("a"), F.col(b).alias("b")) for n, (a, b) in KEPT.items()]
    )
    rows = voxels.select("t", "p", "c", "v", F.explode(faces).alias("f"))
    return rows.groupBy("f.projection", "t", "p", "c", "f.a", "f.b").agg(F.max("v").alias("v"))


def export_tasks(voxels: DataFrame, position_mode: str = "multi_position") -> DataFrame:
    """Index combinations that an export writes, one row per output."""
    keys = ["t", "c"] if position_mode == "multi_position" else ["p", "t", "c"]
    names = F.explode(F.array(*[F.lit(n) for n in KEPT])).alias("projection")
    return voxels.select(*keys).distinct().select(*keys, names)


def resampled_length(length: int, source_um: float, target_um: float) -> int:
    """Samples that keep the physical extent; halves round to even."""
    if length <= 1 or source_um <= 0 or target_um <= 0:
        return max(1, length)
    return max(1, round((length - 1) * source_um / target_um) + 1)


def clip_uint16(value: Column) -> Column:
    return F.rint(F.least(F.lit(65535.0), F.greatest(F.lit(0.0), value.cast("double")))).cast("int")


def resample_axis(rows: DataFrame, axis: str, keys: list[str], length: int, target: int) -> DataFrame:
    """Linear resampling of ``axis`` from ``length`` to ``target`` samples.

    Every source sample carries its successor and emits the targets that fall
    between the two, so no join is needed.
    """
    if length <= 1:
        steps = F.explode(F.sequence(F.lit(0), F.lit(target - 1)))
        return rows.select(*keys, steps.alias(axis), clip_uint16(F.col("v")).alias("v"))
    scale = (length - 1) / (target - 1) if target > 1 else 0.0
    follow = F.lead("v").over(Window.partitionBy(*keys).orderBy(axis))
    first = F.ceil(F.col(axis) / F.lit(scale) - 1e-9).cast("int") if scale else F.lit(0)
    last = F.when(F.col(axis) == length - 1, F.lit(target - 1)).otherwise(
        F.ceil((F.col(axis) + 1) / F.lit(scale) - 1e-9).cast("int") - 1 if scale else F.lit(0)
    )
    spread = rows.withColumn("_next", F.coalesce(follow, F.col("v"))).withColumn("_a", first).withColumn("_b", last)
    spread = spread.where("_a <= _b").withColumn("_m", F.explode(F.sequence("_a", "_b")))
    weight = F.col("_m") * F.lit(scale) - F.col(axis)
    return spread.select(
        *keys, F.col("_m").alias(axis), clip_uint16(F.col("v") * (1 - weight) + F.col("_next") * weight).alias("v")
    )
