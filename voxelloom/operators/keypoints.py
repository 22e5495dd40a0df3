"""Binary descriptors of points, their matches, ridges and point filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators import kernels

BITS, PATCH = 256, 31


def descriptor_pattern(bits: int = BITS, patch: int = PATCH, seed: int = 1) -> np.ndarray:
    """Pairs of offsets (bits, 2, 2), normally spread over the patch."""
    rng = np.random.default_rng(seed)
    half = (patch - 2) // 2
    return np.clip(np.rint(rng.normal(0, patch / 5, (bits, 2, 2))), -half, half).astype(int)


def describe(image: np.ndarray, points: np.ndarray, bits: int = BITS, patch: int = PATCH) -> tuple[np.ndarray, np.ndarray]:
    """(kept, descriptors): which (row, column) points lie far enough inside,
    and for each bit whether the first place of its pair is darker."""
    at = np.rint(np.asarray(points, float)).astype(int).reshape(-1, 2)
    half = patch // 2
    kept = ((at >= half) & (at < np.array(image.shape) - half)).all(1)
    smooth = kernels.gaussian(image, 1.0)
    places = at[kept][:, None, None, :] + descriptor_pattern(bits, patch)
    values = smooth[places[..., 0], places[..., 1]]
    return kept, values[..., 0] < values[..., 1]


def match(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Index of the nearest descriptor on the right for every one on the left.

    Nearest is the fewest differing bits, ties to the smaller index; matches
    are neither crossed back nor compared with the second best.
    """
    if not len(left) or not len(right):
        return np.zeros(0, int)
    a, b = np.packbits(left, axis=1), np.packbits(right, axis=1)
    out = np.empty(len(a), int)
    for i in range(0, len(a), 256):
        out[i : i + 256] = np.bitwise_count(a[i : i + 256, None] ^ b).sum(2, dtype=int).argmin(1)
    return out


def match_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, a, b, distance): nearest right descriptor of each left one, by ``key``.

    Both hold (key, id, bits: binary); the points of one image pair are one key.
    """

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        fields = {"key": pa.int64(), "a": pa.int64(), "b": pa.int64(), "distance": pa.int32()}
        if not one.num_rows or not other.num_rows:
            return pa.table({k: pa.array([], t) for k, t in fields.items()})
        one, other = one.sort_by("id"), other.sort_by("id")
        a, b = ([np.frombuffer(v, np.uint8) for v in t.column("bits").to_pylist()] for t in (one, other))
        a, b = np.array(a), np.array(b)
        found = match(np.unpackbits(a, axis=1).astype(bool), np.unpackbits(b, axis=1).astype(bool))
        gap = np.bitwise_count(a ^ b[found]).sum(1, dtype=np.int32)
        return pa.table({"key": one.column("key"), "a": one.column("id"), "b": other.column("id").take(pa.array(found)), "distance": pa.array(gap)})

    return left.groupBy("key").cogroup(right.groupBy("key")).applyInArrow(run, "key long, a long, b long, distance int")


def overlay(detections: DataFrame, position: int, tolerance: float = 0.5) -> DataFrame:
    """(t, c, z, y, x, sigma, intensity) of one position's detections.

    Tables of the older forms without p, or without sigma and intensity, are
    completed: they belong to position 0, sigma is 1 and intensity 0.
    """
    have = set(detections.columns)
    rows = detections.select(
        *[(F.col(a) if a in have else F.lit(0.0)).cast("double").alias(a) for a in ("t", "p", "c", "z", "y", "x")],
        (F.col("sigma") if "sigma" in have else F.lit(1.0)).cast("double").alias("sigma"),
        (F.col("intensity") if "intensity" in have else F.lit(0.0)).cast("double").alias("intensity"),
    )
    return rows.where(F.abs(F.col("p") - position) < tolerance).drop("p")


def keep_apart_until_stable(points: np.ndarray, image: np.ndarray, min_dist: float) -> np.ndarray:
    """(z, y, x, sigma, intensity) rows that stay when close ones go, over and
    over with the intensity read again at the rounded place, until none goes."""
    points = np.asarray(points, float).reshape(-1, 5)
    while len(points):
        at = tuple(np.clip(np.rint(points[:, i]).astype(int), 0, image.shape[i] - 1) for i in range(3))
        points = points.copy()
        points[:, 4] = image[at]
        kept = np.sort(kernels.keep_apart(points[:, :4], points[:, 4], min_dist))
        if len(kept) == len(points):
            break
        points = points[kept]
    return points


def blur_difference(image: np.ndarray, sigma_high: float, sigma_low: float) -> np.ndarray:
    """Low minus high blur of a plane, each within 3 sigmas, edges mirrored."""
    out = []
    for sigma in (sigma_low, sigma_high):
        radius = max(1, int(6 * sigma + 1) // 2)
        x = np.arange(-radius, radius + 1)
        w = np.exp(-(x**2) / (2 * sigma**2))
        plane = np.asarray(image, float)
        for axis in (0, 1):
            plane = kernels.convolve_axis(plane, w / w.sum(), axis, "reflect")
        out.append(plane)
    return out[0] - out[1]


def hessian_values(block: np.ndarray, sigma: float) -> np.ndarray:
    """Eigenvalues of the Hessian of the smoothed block, ascending on the last axis."""
    smooth = kernels.gaussian(block, sigma)
    first = np.gradient(smooth)
    n = block.ndim
    rows = np.empty((*block.shape, n, n))
    for i in range(n):
        second = np.gradient(first[i])
        for j in range(n):
            rows[..., i, j] = second[j]
    return np.linalg.eigvalsh((rows + np.swapaxes(rows, -1, -2)) / 2)


def meijering(plane: np.ndarray, sigmas=(1, 3, 5), dark: bool = True) -> np.ndarray:
    """Neuriteness: the eigenvalue of largest size mixed with the others, best over sigmas, 0 to 1."""
    plane = np.asarray(plane, float) * (1 if dark else -1)
    n, out = plane.ndim, np.zeros(plane.shape)
    for sigma in sigmas:
        values = hessian_values(plane, sigma)
        mixed = values + (values.sum(-1, keepdims=True) - values) / (n + 1)
        strongest = np.take_along_axis(mixed, np.abs(mixed).argmax(-1)[..., None], -1)[..., 0]
        ridge = np.maximum(strongest, 0)
        top = ridge.max()
        out = np.maximum(out, ridge / top if top > 0 else ridge)
    return out


def tubeness(block: np.ndarray, sigmas=(1, 2, 3), bright: bool = True) -> np.ndarray:
    """Sato's filter: second largest negative curvature, scaled with sigma squared."""
    block = np.asarray(block, float) * (1 if bright else -1)
    out = np.zeros(block.shape)
    for sigma in sigmas:
        values = -hessian_values(block, sigma)[..., ::-1]  # ascending again, bright ridges positive
        cross = np.maximum(values[..., 1:], 0)  # all but the weakest
        out = np.maximum(out, sigma**2 * np.prod(cross, axis=-1) ** (1 / max(1, cross.shape[-1])))
    return out
