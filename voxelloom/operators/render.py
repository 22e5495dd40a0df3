"""Fusion of tiles under general affine transforms, chunk by chunk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators import fusion, kernels, poses, regions
from voxelloom.sources.voxels import CHUNK_FIELDS, block_of


def output_frame(affines: dict, shape_zyx, voxel_zyx) -> tuple[np.ndarray, tuple]:
    """(origin x, y, z; shape z, y, x) that covers all transformed tiles."""
    extent = np.array(shape_zyx[::-1]) * np.array(voxel_zyx[::-1], float)
    corners = np.array([[(i >> k & 1) * extent[k] for k in range(3)] + [1.0] for i in range(8)])
    points = np.concatenate([corners @ np.asarray(m)[:3].T for m in affines.values()])
    low, high = points.min(0), points.max(0)
    shape = np.ceil((high - low) / np.array(voxel_zyx[::-1]) - 1e-9).astype(int)
    return low, tuple(int(n) for n in shape[::-1])


def fuse(
    chunks: DataFrame, affines: dict, shape_zyx, voxel_zyx, tile_zyx, overlap_zyx=(8, 32, 32), mode: str = "feather",
    exponent: float = 1.0, gains: dict | None = None, limits: tuple = (0, 65535),
) -> DataFrame:
    """Chunk rows of the fused volume of each (t, c).

    ``affines`` maps p to its 4 x 4 local-to-world matrix in micrometres and
    ``gains`` p to (gain, offset).  A source chunk goes to the output chunks
    that read it; an output chunk is one task, which holds of every tile only
    the region that it needs, adds weighted samples in double and divides at
    the end.  Content weights look at whole tiles, which then go whole.
    """
    origin, out_shape = output_frame(affines, shape_zyx, voxel_zyx)
    size = np.array(voxel_zyx[::-1], float)
    profiles = [np.array(fusion.blend_profile(n, o, mode, exponent)) for n, o in zip(shape_zyx, overlap_zyx, strict=True)]
    pairs = []
    for p, m in affines.items():
        extent = np.array(shape_zyx[::-1]) * size
        corners = np.array([[(i >> k & 1) * extent[k] for k in range(3)] + [1.0] for i in range(8)]) @ np.asarray(m)[:3].T
        low, high = (corners.min(0) - origin) / size, (corners.max(0) - origin) / size
        first, last = np.floor(low[::-1] / tile_zyx).astype(int), np.ceil(high[::-1] / tile_zyx).astype(int)
        for z in range(max(0, first[0]), last[0]):
            for y in range(max(0, first[1]), last[1]):
                for x in range(max(0, first[2]), last[2]):
                    start = np.array([z, y, x]) * tile_zyx
                    if not (start < out_shape).all():
                        continue
                    part = np.minimum(start + tile_zyx, out_shape) - start
                    at = origin + start[::-1] * size
                    read = tuple(slice(0, n) for n in shape_zyx) if mode == "content_aware" else poses.source_box(np.asarray(m), at, part, shape_zyx, voxel_zyx, 2)
                    if read is not None:
                        pairs.append((int(p), *start.tolist(), *(int(v) for s in read for v in (s.start, s.stop))))
    table = chunks.sparkSession.createDataFrame(pairs, "rp int, oz int, oy int, ox int, rz int, sz int, ry int, sy int, rx int, sx int")
    bounds = {a: (F.col(f"{a}0"), F.col(f"{a}0") + F.col(f"n{a}"), F.col(f"r{a}"), F.col(f"s{a}")) for a in "zyx"}
    bounds["p"] = (F.col("p"), F.col("p") + 0.5, F.col("rp"), F.col("rp") + 0.5)
    sent = regions.box_join(chunks, table, bounds, dict(zip("zyx", tile_zyx, strict=True)) | {"p": 1})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        start = np.array([first["oz"], first["oy"], first["ox"]])
        shape = tuple(int(n) for n in np.minimum(start + tile_zyx, out_shape) - start)
        grid = np.indices(shape).reshape(3, -1) + start[:, None]
        world = grid[::-1] * size[:, None] + origin[:, None]
        total, weights = np.zeros(grid.shape[1]), np.zeros(grid.shape[1])
        for p, own in pdf.groupby("p"):
            low = np.array([own[f"r{a}"].iloc[0] for a in "zyx"])
            high = np.array([own[f"s{a}"].iloc[0] for a in "zyx"])
            volume = np.zeros(high - low)
            for row in own.to_dict("records"):
                block, at = block_of(row), np.array([row[f"{a}0"] for a in "zyx"])
                a, b = np.maximum(at, low), np.minimum(at + block.shape, high)
                volume[tuple(slice(*k) for k in zip(a - low, b - low, strict=True))] = block[tuple(slice(*k) for k in zip(a - at, b - at, strict=True))]
            inverse = np.linalg.inv(np.asarray(affines[p]))
            local = ((inverse[:3, :3] @ world + inverse[:3, 3:]) / size[:, None])[::-1]
            value, support = kernels.sample_linear(volume, local - low[:, None], 0.0, support=True)
            near = [np.clip(np.rint(local[k]).astype(int), 0, shape_zyx[k] - 1) for k in range(3)]
            w = profiles[0][near[0]] * profiles[1][near[1]] * profiles[2][near[2]] * (support > 1 - 1e-6)
            if mode == "content_aware":
                w = w * kernels.content_weights(volume)[tuple(near)]
            gain, offset = (gains or {}).get(p, (1.0, 0.0))
            total += (value * gain + offset) * w
            weights += w
        mean = np.where(weights > 0, total / np.maximum(weights, fusion.WEIGHT_FLOOR), 0.0)
        fused = np.clip(np.rint(mean), *limits).astype(np.int32).reshape(shape)
        row = {"t": int(first["t"]), "p": 0, "c": int(first["c"])} | dict(zip(("z0", "y0", "x0"), start.tolist(), strict=True))
        row |= dict(zip(("nz", "ny", "nx"), shape, strict=True))
        return pd.DataFrame([row | {"dtype": "int32", "payload": fused.tobytes()}])

    return sent.groupBy("t", "c", "oz", "oy", "ox").applyInPandas(run, CHUNK_FIELDS)
