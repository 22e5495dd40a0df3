"""Particle detection over chunks with halos."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.operators import kernels, regions

FIELDS = "t double, p double, c double, z double, y double, x double, sigma double, intensity double"
SORT = ["t", "p", "z", "y", "x"]


@dataclass(frozen=True)
class DetectionParams:
    channel: int = 0
    bg_sigma: float = 20.0
    fwhm_px: float = 3.0
    sigma_min_factor: float = 1.0
    sigma_max_factor: float = 3.0
    sigma_ratio: float = 1.2
    threshold: float = 0.1
    overlap: float = 0.5
    border: int = 5
    min_dist: float = 0.0
    halo: int = 8


def detect(voxels: DataFrame, shape: dict[str, int], chunks: dict[str, int], params: DetectionParams) -> DataFrame:
    """Blobs of each plane of the channel, one row each, sorted.

    Each (t, p, c, chunk) is one task with its halo; points of the halo are
    dropped by the half-open core, so none is reported twice.
    """
    own = voxels.where(F.col("c") == params.channel)
    halo = {"y": params.halo, "x": params.halo, "z": 0}
    spread = regions.replicate_to_chunks(own, shape, chunks, halo)
    base = params.fwhm_px / kernels.SIGMA_PER_FWHM
    size = {a: chunks.get(a, shape[a]) for a in "zyx"}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = {a: int(pdf[a].min()) for a in "zyx"}
        block = np.zeros([int(pdf[a].max()) - first[a] + 1 for a in "zyx"])
        block[tuple(pdf[a].to_numpy() - first[a] for a in "zyx")] = pdf["v"].to_numpy()
        core = {a: (int(pdf[f"{a}_chunk"].iloc[0]) * size[a], (int(pdf[f"{a}_chunk"].iloc[0]) + 1) * size[a]) for a in "zyx"}
        rows = []
        for k, plane in enumerate(block):
            found = kernels.blobs(
                kernels.normalize_background(plane, params.bg_sigma), base * params.sigma_min_factor,
                base * params.sigma_max_factor, params.sigma_ratio, params.threshold, params.overlap, params.border,
            )
            for y, x, s in found:
                rows.append((first["z"] + k, first["y"] + y, first["x"] + x, s, plane[round(y), round(x)]))
        points = np.array(rows).reshape(-1, 5)
        if params.min_dist > 0 and len(points):
            points = points[kernels.keep_apart(points[:, :4], points[:, 4], params.min_dist)]
        inside = np.ones(len(points), bool)
        for i, a in enumerate("zyx"):
            inside &= (points[:, i] >= core[a][0]) & (points[:, i] < core[a][1])
        points = points[inside]
        out = pd.DataFrame(points, columns=["z", "y", "x", "sigma", "intensity"])
        for a in ("c", "p", "t"):
            out.insert(0, a, float(pdf[a].iloc[0]))
        return out

    found = spread.groupBy("t", "p", "c", "z_chunk", "y_chunk", "x_chunk").applyInPandas(run, FIELDS)
    return found.orderBy(*SORT)


def compose(*tables: DataFrame) -> DataFrame:
    """Detections of several runs in the order t, p, z, y, x."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out.orderBy(*SORT)


def by_intensity(points: DataFrame) -> DataFrame:
    """Brightest first; ties by coordinates."""
    return points.orderBy(F.desc("intensity"), *SORT, "c")


def read_tracks(spark: SparkSession, path: str, planar: bool = False) -> DataFrame:
    """Tracks of CSV files with a header (track_id, t, z, y, x and more), dummies left out.

    Numbers are doubles; t and the track's id are whole.
    """
    rows = spark.read.option("header", "true").csv(path)
    names = {c: c.strip().lower() for c in rows.columns}
    rows = rows.withColumnsRenamed(names)
    whole = {c: F.col(c).try_cast("double").cast("long") for c in ("track_id", "t") if c in rows.columns}
    numbers = {c: F.col(c).try_cast("double") for c in rows.columns if c not in whole}
    return real_tracks(rows.withColumns(whole | numbers), planar=planar)


def real_tracks(tracks: DataFrame, tolerance: float = 1e-6, planar: bool = False) -> DataFrame:
    """Tracks without the placeholder rows at x = y = -0.5."""
    dummy = (F.abs(F.col("x") + 0.5) < tolerance) & (F.abs(F.col("y") + 0.5) < tolerance)
    kept = tracks.where(~dummy)
    return kept.drop("z") if planar else kept
