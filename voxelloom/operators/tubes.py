"""Tubular structures: denoise, subtract background, ridge filter, threshold, clean."""

from __future__ import annotations

import itertools

import numpy as np

from voxelloom.operators.keypoints import tubeness


def ball(radius: int) -> np.ndarray:
    """Offsets (n, 3) of a ball's voxels."""
    r = np.arange(-radius, radius + 1)
    grid = np.stack(np.meshgrid(r, r, r, indexing="ij"), -1).reshape(-1, 3)
    return grid[(grid**2).sum(1) <= radius * radius]


def _over(block: np.ndarray, offsets: np.ndarray, join, outside) -> np.ndarray:
    """``join`` of the block moved by every offset; beyond it lies ``outside``."""
    pad = int(np.abs(offsets).max()) if len(offsets) else 0
    padded = np.pad(block, pad, constant_values=outside)
    out = None
    for o in offsets:
        part = padded[tuple(slice(pad + k, pad + k + n) for k, n in zip(o, block.shape, strict=True))]
        out = part.copy() if out is None else join(out, part)
    return out


def white_tophat(block: np.ndarray, radius: int) -> np.ndarray:
    """The block less its opening: structures narrower than the ball."""
    eroded = _over(block, ball(radius), np.minimum, np.inf)
    return block - _over(eroded, ball(radius), np.maximum, -np.inf)


def close_gaps(mask: np.ndarray, radius: int) -> np.ndarray:
    """Dilation, then erosion, with a ball."""
    wide = _over(mask, ball(radius), np.logical_or, False)
    return _over(wide, ball(radius), np.logical_and, True)


def labels_of(mask: np.ndarray, full: bool = False) -> np.ndarray:
    """Connected parts from 1 on, faces (or also edges and corners) touching; 0 elsewhere.

    Every voxel takes the smallest index among its neighbours over and over,
    following indices to their own, until nothing changes.
    """
    index = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    steps = [o for o in itertools.product((-1, 0, 1), repeat=mask.ndim) if any(o) and (full or sum(map(abs, o)) == 1)]
    while True:
        best = index
        padded = np.pad(index, 1, constant_values=mask.size)
        for o in steps:
            best = np.minimum(best, padded[tuple(slice(1 + k, 1 + k + n) for k, n in zip(o, mask.shape, strict=True))])
        best = np.where(mask, best, mask.size)
        flat = np.append(best.reshape(-1), mask.size)
        best = flat[flat[:-1]].reshape(mask.shape)
        if (best == index).all():
            break
        index = best
    out = np.zeros(mask.shape, int)
    out[mask] = np.unique(index[mask], return_inverse=True)[1] + 1
    return out


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    """Parts of at least ``least`` voxels."""
    parts = labels_of(mask)
    return mask & (np.bincount(parts.reshape(-1))[parts] >= least)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with the background that does not reach the border."""
    outside = labels_of(np.pad(~mask, 1, constant_values=True))
    inner = outside[tuple(slice(1, -1) for _ in mask.shape)]
    return mask | (inner != outside[(0,) * mask.ndim])


def noise_of(block: np.ndarray) -> float:
    """Deviation of the noise from the median of its finest diagonal details."""
    detail = np.asarray(block, float)
    for axis in range(detail.ndim):
        n = detail.shape[axis] // 2 * 2
        if n >= 2:
            pairs = np.take(detail, range(n), axis)
            detail = (np.take(pairs, range(0, n, 2), axis) - np.take(pairs, range(1, n, 2), axis)) / np.sqrt(2)
    return float(np.median(np.abs(detail)) / 0.6744897501960817)


def nonlocal_means(block: np.ndarray, h: float, patch: int = 3, distance: int = 5) -> np.ndarray:
    """Mean over the neighbourhood, weighted by how alike the patches are."""
    if h <= 0:
        return np.asarray(block, float)
    block, half = np.asarray(block, float), patch // 2
    pad = distance + half
    padded = np.pad(block, pad, mode="reflect" if min(block.shape) > pad else "edge")
    near = list(itertools.product(range(-half, half + 1), repeat=block.ndim))
    total, weight = np.zeros(block.shape), np.zeros(block.shape)

    def at(offset):
        return padded[tuple(slice(pad + k, pad + k + n) for k, n in zip(offset, block.shape, strict=True))]

    for o in itertools.product(range(-distance, distance + 1), repeat=block.ndim):
        gap = sum((at(q) - at(tuple(a + b for a, b in zip(o, q, strict=True)))) ** 2 for q in near) / len(near)
        w = np.exp(-gap / (h * h))
        total += w * at(o)
        weight += w
    return total / weight


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """Threshold of largest between-class variance over equal bins."""
    counts, edges = np.histogram(values, bins)
    middle = (edges[:-1] + edges[1:]) / 2
    low, high = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    mean_low = np.cumsum(counts * middle) / np.maximum(low, 1)
    mean_high = (np.cumsum((counts * middle)[::-1]) / np.maximum(high[::-1], 1))[::-1]
    return float(middle[(low[:-1] * high[1:] * (mean_low[:-1] - mean_high[1:]) ** 2).argmax()])


def segment(volume: np.ndarray, sigmas=(1, 2, 3), bright: bool = True, least: int = 200, radius: int = 1, distance: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mask, response 0..1) of the tubes in a volume."""
    low, high = np.percentile(volume, (1, 99))
    clean = np.clip((np.asarray(volume, float) - low) / (high - low + 1e-6), 0, 1)
    clean = nonlocal_means(clean, 0.8 * noise_of(clean), distance=distance)
    found = tubeness(white_tophat(clean, 5), sigmas, bright)
    found = (found - found.min()) / (found.max() - found.min() + 1e-6)
    mask = found > max(otsu(found), float(np.percentile(found, 75)))
    return fill_holes(drop_small(close_gaps(mask, radius), least)), found.astype(np.float32)
