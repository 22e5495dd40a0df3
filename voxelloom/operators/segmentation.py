"""Threshold segmentation and point sources of whole blocks."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.operators import kernels


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """Threshold of a histogram; one bin per value for integers."""
    flat = values.reshape(-1)
    if np.issubdtype(flat.dtype, np.integer):
        centres, counts = np.unique(flat, return_counts=True)
    else:
        counts, edges = np.histogram(flat, bins)
        centres = (edges[:-1] + edges[1:]) / 2
    w0 = np.cumsum(counts).astype(float)
    w1, s0 = w0[-1] - w0, np.cumsum(counts * centres)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2
    return float(centres[np.nanargmax(between[:-1])]) if len(centres) > 1 else float(centres[0])


def multi_otsu(values: np.ndarray, classes: int = 3, bins: int = 64) -> list[float]:
    """Thresholds between ``classes`` with the largest variance between them."""
    counts, edges = np.histogram(values, bins)
    centres, p = (edges[:-1] + edges[1:]) / 2, counts / max(1, counts.sum())
    w, m = np.concatenate([[0], np.cumsum(p)]), np.concatenate([[0], np.cumsum(p * centres)])

    def gain(a: int, b: int) -> float:
        return (m[b] - m[a]) ** 2 / (w[b] - w[a]) if w[b] > w[a] else 0.0

    best = max(itertools.combinations(range(1, bins), classes - 1), key=lambda c: sum(gain(a, b) for a, b in zip((0, *c), (*c, bins), strict=True)))
    return [float(centres[i - 1]) for i in best]


def dog_mask(block: np.ndarray, sigma_high: float, sigma_low: float, step: int = 4) -> np.ndarray:
    """Difference of Gaussians at or above its highest of three classes."""
    d = kernels.difference_of_gaussians(block, sigma_high, sigma_low)
    return d >= multi_otsu(d[::step, ::step, ::step])[-1]


def _spread(mask: np.ndarray, radius: int, grow: bool) -> np.ndarray:
    out = mask.copy()
    for axis in range(mask.ndim):
        padded = np.pad(out, [(radius, radius) if a == axis else (0, 0) for a in range(mask.ndim)], constant_values=not grow)
        moved = [np.take(padded, range(k, k + mask.shape[axis]), axis=axis) for k in range(2 * radius + 1)]
        out = np.logical_or.reduce(moved) if grow else np.logical_and.reduce(moved)
    return out


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that the border cannot reach becomes foreground."""
    outside = np.zeros(mask.shape, bool)
    for axis in range(mask.ndim):
        for end in (0, -1):
            at = tuple(end if a == axis else slice(None) for a in range(mask.ndim))
            outside[at] = ~mask[at]
    while True:
        grown = outside.copy()
        for axis in range(mask.ndim):
            for step in (1, -1):
                rolled = np.roll(outside, step, axis)
                edge = tuple((0 if step == 1 else -1) if a == axis else slice(None) for a in range(mask.ndim))
                rolled[edge] = False
                grown |= rolled & ~mask
        if (grown == outside).all():
            return ~outside
        outside = grown


def gamma_mask(block: np.ndarray, gamma: float = 0.5, sigma: float = 1.0, step: int = 4, radius: int = 2) -> np.ndarray:
    """Gamma, smoothing, Otsu, closing with filled holes, smoothing."""
    smooth = kernels.gaussian(np.maximum(block, 0).astype(float) ** gamma, sigma)
    mask = smooth > otsu(smooth[tuple(slice(None, None, step) for _ in smooth.shape)])
    mask = _spread(fill_holes(_spread(mask, radius, True)), radius, False)
    return kernels.gaussian(mask.astype(float), sigma)


def point_sources(block: np.ndarray, axial: float, lateral: float, distance: float = 1.0, low: float = 1.5, high: float = 6.0, steps: int = 5, threshold: float = 0.005) -> np.ndarray:
    """(z, y, x, sigma) of significant maxima of the Laplacian of Gaussian.

    The block is made isotropic along z first; z comes back in source voxels.
    """
    ratio = axial / lateral
    n = max(1, int(block.shape[0] * ratio))
    at = np.linspace(0, block.shape[0] - 1, n)
    a = np.floor(at).astype(int)
    b, w = np.minimum(a + 1, block.shape[0] - 1), (at - a)[:, None, None]
    iso = block[a] * (1 - w) + block[b] * w
    cube = []
    for s in np.linspace(low, high, steps):
        g = kernels.gaussian(iso, s)
        second = sum(np.diff(np.pad(g, [(1, 1) if k == axis else (0, 0) for k in range(3)], mode="edge"), 2, axis=axis) for axis in range(3))
        cube.append(-second * s * s)
    cube = np.stack(cube)
    padded = np.pad(cube, 1, constant_values=-np.inf)
    peak = cube > threshold
    for d in itertools.product((0, 1, 2), repeat=4):
        if d != (1, 1, 1, 1):
            peak &= cube >= padded[tuple(slice(k, k + m) for k, m in zip(d, cube.shape, strict=True))]
    s, z, y, x = np.nonzero(peak)
    points = np.column_stack([z, y, x, np.linspace(low, high, steps)[s]]).astype(float)
    bright = iso[z, y, x]
    keep = bright >= iso.mean() + 2 * iso.std()
    points, bright = points[keep], bright[keep]
    points = points[kernels.keep_apart(points, bright, distance)]
    points[:, 0] = np.trunc(points[:, 0] * lateral / axial)
    return points


def mutual_information(pairs: DataFrame, keys: list[str], bins: int = 32) -> DataFrame:
    """Mutual information and correlation of (fixed, moving), by key.

    An approximation of sampled metrics: all pairs are binned and counted.
    """
    whole = Window.partitionBy(*keys)
    scaled = pairs
    for side in ("fixed", "moving"):
        low, high = F.min(side).over(whole), F.max(side).over(whole)
        code = F.when(high > low, F.least(F.lit(bins - 1), F.floor((F.col(side) - low) / (high - low) * bins))).otherwise(0)
        scaled = scaled.withColumn(f"b_{side}", code.cast("int"))
    cells = scaled.groupBy(*keys, "b_fixed", "b_moving").agg(F.count(F.lit(1)).alias("n"))
    both = cells.withColumn("all", F.sum("n").over(whole))
    both = both.withColumn("f", F.sum("n").over(Window.partitionBy(*keys, "b_fixed"))).withColumn("m", F.sum("n").over(Window.partitionBy(*keys, "b_moving")))
    p = F.col("n") / F.col("all")
    info = both.groupBy(*keys).agg(F.sum(p * F.log(F.col("n") * F.col("all") / (F.col("f") * F.col("m")))).alias("mutual_information"))
    return info.join(pairs.groupBy(*keys).agg(F.corr("fixed", "moving").alias("correlation")), keys)


def cross_validated_residual(src: np.ndarray, dst: np.ndarray, splits: int = 20, share: float = 0.2, seed: int = 0) -> float:
    """Pooled RMS of refitted similarities on points left out; NaN below 4."""
    from voxelloom.operators.registration import fit_similarity

    if len(src) < 4:
        return math.nan
    rng, squares = np.random.default_rng(seed), []
    for _ in range(splits):
        order = rng.permutation(len(src))
        out = order[: max(1, int(len(src) * share))]
        rest = np.setdiff1d(order, out)
        if len(rest) >= 2:
            m = fit_similarity(src[rest], dst[rest])
            squares.extend(((src[out] @ m[:, :2].T + m[:, 2] - dst[out]) ** 2).sum(1))
    return float(np.sqrt(np.mean(squares))) if squares else math.nan
