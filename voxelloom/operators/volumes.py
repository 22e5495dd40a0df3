"""Whole small volumes and chunk pairs: zoom, transforms, crops, chunk registration."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.operators import blocks, grids, kernels, regions, statistics
from voxelloom.sources import sinks
from voxelloom.sources.formats import _read_text


def downsample(volume: np.ndarray, limit: int, voxel_zyx) -> tuple[np.ndarray, tuple]:
    """(volume, voxel size) zoomed linearly by 1 / f, f the least whole factor that meets ``limit``."""
    f = grids.downsample_factor(volume.shape, limit)
    if f == 1:
        return volume, tuple(voxel_zyx)
    shape = tuple(max(1, round(n / f)) for n in volume.shape)
    scale = [(n - 1) / (m - 1) if m > 1 else 0.0 for n, m in zip(volume.shape, shape, strict=True)]
    return kernels.affine_resample(volume, np.diag(scale), np.zeros(3), shape), tuple(v * f for v in voxel_zyx)


def apply_affine(moving: np.ndarray, matrix: np.ndarray, shape: tuple, fill: float = 0.0) -> np.ndarray:
    """Moving image on the fixed grid; ``matrix`` (4 x 4, z y x) takes fixed to moving voxels."""
    return kernels.affine_resample(moving, matrix[:3, :3], matrix[:3, 3], shape, fill)


def apply_transforms(moving: np.ndarray, matrix: np.ndarray, displacement: np.ndarray | None, fill: float = 0.0, shape: tuple | None = None) -> np.ndarray:
    """Affine after displacement (fixed z, y, x, 3 in voxels), in one resampling."""
    shape = displacement.shape[:3] if displacement is not None else shape
    grid = np.indices(shape).reshape(3, -1).astype(float)
    if displacement is not None:
        grid = grid + displacement.reshape(-1, 3).T
    return kernels.sample_linear(moving, matrix[:3, :3] @ grid + matrix[:3, 3:], fill).reshape(shape)


def transform_images(chunks: DataFrame, matrix: np.ndarray, displacement: np.ndarray | None, shape: tuple) -> DataFrame:
    """The same transforms on many volumes, one chunk row each; the results are float32."""

    def one(row, block):
        return row, apply_transforms(block, matrix, displacement, 0.0, shape).astype(np.float32)

    return blocks.map_blocks(chunks, one)


def foreground_crop(spark: SparkSession, voxels: DataFrame, path: str, low: float = 0.1, high: float = 99.9) -> DataFrame:
    """Voxels of an image (z, y, x, v) inside its robust foreground box.

    The box is saved as JSON at ``path`` and used again where it is there.
    """
    text = _read_text(spark, path)
    if text:
        box = json.loads(text)
    else:
        keyed = voxels.withColumn("_k", F.lit(0))
        sides = statistics.robust_box(keyed, statistics.otsu_thresholds(keyed, ["_k"], 4), ["_k"], low, high).collect()
        if not sides:
            raise ValueError("no foreground")
        box = {r["axis"]: [int(r["start"]), int(r["stop"])] for r in sides}
        sinks.put(path, json.dumps(box, sort_keys=True).encode())
    for axis, (start, stop) in box.items():
        voxels = voxels.where((F.col(axis) >= start) & (F.col(axis) < stop))
    return voxels


def register_chunks(fixed: DataFrame, moving: DataFrame, shape_zyx: tuple, chunk: int, overlap: int, upsample: int = 10) -> DataFrame:
    """(chunk, z, y, x, dz, dy, dx): shift of every extended chunk and its centre.

    ``fixed`` and ``moving`` are voxel rows (z, y, x, v) of one image pair; a
    chunk is one task that holds the two extended regions.
    """
    cells = grids.registration_chunks(shape_zyx, chunk, overlap)
    rows = [(i, *[v for pair in c["extended"] for v in pair]) for i, c in enumerate(cells)]
    names = [f"{a}_{s}" for a in "zyx" for s in ("start", "stop")]
    table = fixed.sparkSession.createDataFrame(rows, "chunk int, " + ", ".join(f"{n} int" for n in names))
    both = fixed.select("z", "y", "x", "v", F.lit(0).alias("side")).unionByName(moving.select("z", "y", "x", "v", F.lit(1).alias("side")))
    bounds = {a: (F.col(a), F.col(a) + 1, F.col(f"{a}_start"), F.col(f"{a}_stop")) for a in "zyx"}
    sent = regions.box_join(both, table, bounds, {a: chunk for a in "zyx"})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        start = np.array([first[f"{a}_start"] for a in "zyx"])
        stop = np.array([first[f"{a}_stop"] for a in "zyx"])
        parts = []
        for side in (0, 1):
            own = pdf[pdf["side"] == side]
            part = np.zeros(stop - start)
            part[tuple(own[a].to_numpy() - s for a, s in zip("zyx", start, strict=True))] = own["v"].to_numpy()
            parts.append(part - part.mean())
        shift = kernels.phase_shift(*parts, upsample)
        centre = (start + stop - 1) / 2
        return pd.DataFrame([[int(first["chunk"]), *map(float, centre), *map(float, shift)]], columns=["chunk", "z", "y", "x", "dz", "dy", "dx"])

    return sent.groupBy("chunk").applyInPandas(run, "chunk int, z double, y double, x double, dz double, dy double, dx double")
