"""Affine and shear transforms of whole volumes, tile by tile."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators import kernels, regions
from voxelloom.sources.voxels import CHUNK_FIELDS, block_of, chunk_batch


@dataclass(frozen=True)
class ShearParams:
    shear_xy: float = 0.0
    shear_xz: float = 0.0
    shear_yz: float = 0.0
    rotation_deg_xyz: tuple = (0.0, 0.0, 0.0)
    auto_rotate: bool = False
    fill: float = 0.0
    padding_zyx: tuple = (2, 2, 2)
    order: int = 1


def rotation_matrix(deg_xyz) -> np.ndarray:
    """Rz @ Ry @ Rx."""
    (cx, sx), (cy, sy), (cz, sz) = [(math.cos(math.radians(a)), math.sin(math.radians(a))) for a in deg_xyz]
    rx = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    ry = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])
    rz = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    return rz @ ry @ rx


def linear_matrix(params: ShearParams) -> np.ndarray:
    """Rotation after shear, in x, y, z; auto-rotation undoes the shear's tilt."""
    x, y, z = params.rotation_deg_xyz
    if params.auto_rotate:
        x -= math.degrees(math.atan(params.shear_yz))
        y += math.degrees(math.atan(params.shear_xz))
        z -= math.degrees(math.atan(params.shear_xy))
    shear = np.array([[1, params.shear_xy, params.shear_xz], [0, 1, params.shear_yz], [0, 0, 1]])
    return rotation_matrix((x, y, z)) @ shear


@dataclass(frozen=True)
class Geometry:
    """Output shape and the voxel map source = matrix @ output + offset."""

    shape_zyx: tuple
    origin_xyz: tuple
    matrix_zyx: np.ndarray
    offset_zyx: np.ndarray


def geometry(shape_zyx, voxel_zyx, params: ShearParams) -> Geometry:
    """The affine keeps the volume's centre; the output covers all of it."""
    size = np.array(voxel_zyx[::-1], float)
    extent = (np.array(shape_zyx[::-1], float) - 1) * size
    m, centre = linear_matrix(params), extent / 2
    corners = np.array([[(i >> k & 1) * extent[k] for k in range(3)] for i in range(8)])
    moved = (corners - centre) @ m.T + centre
    low, high = moved.min(0), moved.max(0)
    shape = tuple(int(n) for n in (np.floor((high - low) / size + 1e-9) + 1)[::-1])
    inverse = np.linalg.inv(m)
    to_voxel = (inverse * size[None, :]) / size[:, None]
    shift = (inverse @ (low - centre) + centre) / size
    flip = [2, 1, 0]
    return Geometry(shape, tuple(low), to_voxel[np.ix_(flip, flip)], shift[flip])


def source_bounds(start, stop, geo: Geometry, source_shape, padding) -> list[tuple[int, int]] | None:
    """Half-open source region that an output tile reads; None if empty."""
    corners = np.array([[(stop[k] - 1) if i >> k & 1 else start[k] for k in range(3)] for i in range(8)], float)
    at = corners @ geo.matrix_zyx.T + geo.offset_zyx
    low = np.maximum(np.floor(at.min(0)).astype(int) - padding, 0)
    high = np.minimum(np.ceil(at.max(0)).astype(int) + 1 + np.array(padding), source_shape)
    return None if (high <= low).any() else list(zip(low.tolist(), high.tolist(), strict=True))


def transform(chunks: DataFrame, shape_zyx, voxel_zyx, params: ShearParams, tile_zyx) -> DataFrame:
    """Chunk rows of the transformed volumes.

    Every source chunk is sent to the output tiles that read it, so a tile is
    one task that holds only the region it needs.
    """
    geo = geometry(shape_zyx, voxel_zyx, params)
    tiles = []
    for z in range(0, geo.shape_zyx[0], tile_zyx[0]):
        for y in range(0, geo.shape_zyx[1], tile_zyx[1]):
            for x in range(0, geo.shape_zyx[2], tile_zyx[2]):
                start = (z, y, x)
                stop = tuple(min(s + n, m) for s, n, m in zip(start, tile_zyx, geo.shape_zyx, strict=True))
                read = source_bounds(start, stop, geo, shape_zyx, params.padding_zyx)
                tiles.append((*start, *stop, *(v for pair in (read or [(0, 0)] * 3) for v in pair)))
    names = [f"{s}_{a}" for s in ("a", "b") for a in "zyx"] + [f"{s}{a}" for a in "zyx" for s in ("r", "s")]
    table = chunks.sparkSession.createDataFrame(tiles, ", ".join(f"{n} int" for n in names))
    table = table.where(" AND ".join(f"s{a} > r{a}" for a in "zyx"))
    bounds = {a: (F.col(f"{a}0"), F.col(f"{a}0") + F.col(f"n{a}"), F.col(f"r{a}"), F.col(f"s{a}")) for a in "zyx"}
    sent = regions.box_join(chunks, table, bounds, dict(zip("zyx", tile_zyx, strict=True)))
    # tiles that read nothing hold the fill value
    idle = [t[:6] for t in tiles if any(b <= a for a, b in zip(t[6::2], t[7::2], strict=True))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        low = np.array([first[f"r{a}"] for a in "zyx"])
        high = np.array([first[f"s{a}"] for a in "zyx"])
        region = np.full(high - low, params.fill)
        for _, row in pdf.iterrows():
            block, at = block_of(row), np.array([row[f"{a}0"] for a in "zyx"])
            a, b = np.maximum(at, low), np.minimum(at + block.shape, high)
            region[tuple(slice(*p) for p in zip(a - low, b - low, strict=True))] = block[tuple(slice(*p) for p in zip(a - at, b - at, strict=True))]
        start = np.array([first[f"a_{a}"] for a in "zyx"])
        shape = tuple(int(first[f"b_{a}"] - first[f"a_{a}"]) for a in "zyx")
        offset = geo.matrix_zyx @ start + geo.offset_zyx - low
        out = kernels.affine_resample(region, geo.matrix_zyx, offset, shape, params.fill, params.order, params.order > 0).astype(np.float32)
        row = {k: int(first[k]) for k in "tpc"} | dict(zip(("z0", "y0", "x0"), start.tolist(), strict=True))
        row |= dict(zip(("nz", "ny", "nx"), shape, strict=True))
        return pd.DataFrame([row | {"dtype": "float32", "payload": out.tobytes()}])

    made = sent.groupBy("t", "p", "c", "a_z", "a_y", "a_x").applyInPandas(run, CHUNK_FIELDS)
    if not idle:
        return made

    def blank(batches):
        for batch in batches:
            for key in batch.to_pylist():
                rows = [key | dict(zip(("z0", "y0", "x0"), t[:3], strict=True)) for t in idle]
                yield chunk_batch(rows, [np.full([b - a for a, b in zip(t[:3], t[3:], strict=True)], params.fill, np.float32) for t in idle])

    return made.unionByName(chunks.select("t", "p", "c").distinct().mapInArrow(blank, CHUNK_FIELDS))
