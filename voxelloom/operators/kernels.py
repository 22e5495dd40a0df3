"""Numeric kernels in numpy for blocks of voxels."""

from __future__ import annotations

import math

import numpy as np

SIGMA_PER_FWHM = 2.354820045


def gaussian_kernel(sigma: float) -> np.ndarray:
    """Samples within ceil(5 sigma) that sum to 1."""
    return _bell(sigma, math.ceil(5 * sigma))


def _bell(sigma: float, radius: int) -> np.ndarray:
    x = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (x / max(sigma, 1e-12)) ** 2)
    return w / w.sum()


def convolve_axis(block: np.ndarray, kernel: np.ndarray, axis: int, mode: str = "edge") -> np.ndarray:
    radius = len(kernel) // 2
    pad = [(0, 0)] * block.ndim
    pad[axis] = (radius, radius)
    padded = np.pad(block, pad, mode=mode)
    out, n = np.zeros(block.shape, np.float64), block.shape[axis]
    for i, w in enumerate(kernel):
        out += w * np.take(padded, range(i, i + n), axis=axis)
    return out


def gaussian(block: np.ndarray, sigma, mode: str = "edge") -> np.ndarray:
    """Separable smoothing within 4 sigmas; ``sigma`` is one number or one for each axis."""
    sigmas = [sigma] * block.ndim if np.isscalar(sigma) else list(sigma)
    out = block.astype(np.float64)
    for axis, s in enumerate(sigmas):
        if s > 0:
            out = convolve_axis(out, _bell(s, int(4 * s + 0.5)), axis, mode)
    return out


def difference_of_gaussians(block: np.ndarray, sigma_high: float, sigma_low: float) -> np.ndarray:
    return gaussian(block, sigma_high) - gaussian(block, sigma_low)


def second_derivative_kernel(sigma: float) -> np.ndarray:
    """Second derivative of a Gaussian within 5 sigmas, over its own sum."""
    r = math.ceil(5 * sigma)
    x = np.arange(-r, r + 1)
    w = (x**2 / sigma**4 - 1 / sigma**2) * np.exp(-(x**2) / (2 * sigma**2))
    return w / w.sum()


def octant_element(radius: int) -> np.ndarray:
    """The corner octant (i^2 + j^2 + k^2) / r^2 < 1, not a centred ball."""
    i = np.indices((radius, radius, radius)).astype(float)
    return ((i**2).sum(0) / radius**2 < 1).astype(np.uint8)


def normalize_background(plane: np.ndarray, sigma: float = 20.0) -> np.ndarray:
    """Channel mean, smoothed background taken away, scaled to 0..1."""
    image = plane.astype(np.float64)
    if image.ndim == 3:
        image = image.mean(-1)
    image = image - gaussian(image, sigma, "reflect" if min(image.shape) > int(4 * sigma + 0.5) else "edge")
    low, high = image.min(), image.max()
    return (image - low) / (high - low) if high > low else np.zeros_like(image)


def _disc_overlap(r1: float, r2: float, d: float) -> float:
    """Shared area of two discs over that of the smaller one."""
    if d >= r1 + r2:
        return 0.0
    if d <= abs(r1 - r2):
        return 1.0
    a = math.acos(max(-1, min(1, (d * d + r1 * r1 - r2 * r2) / (2 * d * r1))))
    b = math.acos(max(-1, min(1, (d * d + r2 * r2 - r1 * r1) / (2 * d * r2))))
    area = r1 * r1 * (a - math.sin(2 * a) / 2) + r2 * r2 * (b - math.sin(2 * b) / 2)
    return area / (math.pi * min(r1, r2) ** 2)


def blobs(plane: np.ndarray, low: float, high: float, ratio: float, threshold: float, overlap: float, border: int) -> np.ndarray:
    """(y, x, sigma) of maxima in a difference-of-Gaussians scale space.

    Of two blobs that overlap by more than ``overlap`` the larger one stays.
    """
    count = int(math.log(high / low) / math.log(ratio) + 1)
    sigmas = [low * ratio**i for i in range(count + 1)]
    smooth = [gaussian(plane, s) for s in sigmas]
    cube = np.stack([(smooth[i] - smooth[i + 1]) / (ratio - 1) for i in range(count)])
    padded = np.pad(cube, 1, constant_values=-np.inf)
    peak = cube > threshold
    for dz in (0, 1, 2):
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (dz, dy, dx) != (1, 1, 1):
                    peak &= cube >= padded[dz : dz + cube.shape[0], dy : dy + cube.shape[1], dx : dx + cube.shape[2]]
    if border:
        inner = np.zeros_like(peak)
        inner[:, border:-border, border:-border] = True
        peak &= inner
    s, y, x = np.nonzero(peak)
    found = sorted(zip(y.tolist(), x.tolist(), [sigmas[i] for i in s], strict=True), key=lambda b: (-b[2], b[0], b[1]))
    kept: list = []
    for b in found:
        near = (_disc_overlap(b[2] * 2**0.5, k[2] * 2**0.5, math.hypot(b[0] - k[0], b[1] - k[1])) for k in kept)
        if all(o <= overlap for o in near):
            kept.append(b)
    return np.array(sorted(kept)) if kept else np.zeros((0, 3))


def keep_apart(points: np.ndarray, intensity: np.ndarray, min_dist: float) -> np.ndarray:
    """Indices that stay when the brightest are accepted first.

    A point (z, y, x, sigma or three sigmas) goes if an accepted one lies
    within its scaled sigmas; ties in brightness are ordered by coordinates.
    """
    order = np.lexsort((points[:, 2], points[:, 1], points[:, 0], -intensity))
    if min_dist < 1e-10:
        return np.arange(len(points))
    kept: list[int] = []
    for i in order:
        close = False
        for k in kept:
            radii = points[k, 3:] * min_dist
            if (radii == 0).any():
                continue
            if (((points[i, :3] - points[k, :3]) / radii) ** 2).sum() < 1:
                close = True
                break
        if not close:
            kept.append(int(i))
    return np.array(kept, int)


def sample_linear(block: np.ndarray, at: np.ndarray, fill: float = 0.0, support: bool = False):
    """Trilinear samples at (3, n) positions; outside counts as ``fill``.

    With ``support`` the summed weight of inside corners comes back too.
    """
    base = np.floor(at).astype(int)
    part = at - base
    out, seen = np.zeros(at.shape[1]), np.zeros(at.shape[1])
    for corner in range(8):
        bits = np.array([corner >> 2 & 1, corner >> 1 & 1, corner & 1])
        where = base + bits[:, None]
        weight = np.prod(np.where(bits[:, None] == 1, part, 1 - part), axis=0)
        inside = np.all((where >= 0) & (where < np.array(block.shape)[:, None]), axis=0)
        value = np.full(at.shape[1], fill, float)
        value[inside] = block[tuple(where[:, inside])]
        out += weight * value
        seen += weight * inside
    return (out, seen) if support else out


def affine_resample(
    block: np.ndarray, matrix: np.ndarray, offset: np.ndarray, shape: tuple, fill: float = 0.0, order: int = 1, renormalize: bool = False
) -> np.ndarray:
    """Output voxel o takes the source at matrix @ o + offset (z, y, x).

    ``renormalize`` divides by the support that lies in the source.
    """
    grid = np.indices(shape).reshape(3, -1).astype(float)
    at = matrix @ grid + np.asarray(offset, float)[:, None]
    if order == 0:
        near = np.rint(at).astype(int)
        inside = np.all((near >= 0) & (near < np.array(block.shape)[:, None]), axis=0)
        out = np.full(near.shape[1], fill, float)
        out[inside] = block[tuple(near[:, inside])]
        return out.reshape(shape)
    if not renormalize:
        return sample_linear(block, at, fill).reshape(shape)
    out, seen = sample_linear(block, at, 0.0, support=True)
    return np.where(seen > 1e-6, out / np.maximum(seen, 1e-6), fill).reshape(shape)


def phase_shift(fixed: np.ndarray, moving: np.ndarray, upsample: int = 10) -> np.ndarray:
    """Shift (z, y, x) that registers ``moving`` onto ``fixed``.

    Normalised cross power; the peak is refined to 1/upsample voxel by a
    matrix-multiply transform around it.
    """
    product = np.fft.fftn(fixed) * np.fft.fftn(moving).conj()
    product /= np.maximum(np.abs(product), 100 * np.finfo(float).eps)
    peak = np.abs(np.fft.ifftn(product))
    shape = np.array(fixed.shape)
    shift = np.array(np.unravel_index(peak.argmax(), peak.shape), float)
    shift = np.where(shift > shape // 2, shift - shape, shift)
    if upsample <= 1:
        return shift
    half = math.ceil(1.5 * upsample) // 2
    fine = product.conj()
    for axis, n in enumerate(fixed.shape):
        offsets = shift[axis] + (np.arange(math.ceil(1.5 * upsample)) - half) / upsample
        wave = np.exp(-2j * np.pi * offsets[:, None] * np.fft.fftfreq(n)[None, :])
        fine = np.moveaxis(np.tensordot(wave, np.moveaxis(fine, axis, 0), 1), 0, axis)
    best = np.array(np.unravel_index(np.abs(fine).argmax(), fine.shape))
    return shift + (best - half) / upsample * (np.array(fixed.shape) > 1)


def content_weights(block: np.ndarray, floor: float = 0.25) -> np.ndarray:
    """Smoothed gradient size over its 95th percentile, within 0.25..1.5."""
    total = np.zeros(block.shape)
    smooth, slope = np.array([1.0, 2.0, 1.0]), np.array([1.0, 0.0, -1.0])
    for axis in range(block.ndim):
        g = convolve_axis(block.astype(float), slope, axis)
        for other in range(block.ndim):
            if other != axis:
                g = convolve_axis(g, smooth, other)
        total += g * g
    content = gaussian(np.sqrt(total), 1.0)
    top = np.percentile(content, 95)
    return np.clip(content / top, floor, 1.5) if top > 1e-6 else np.ones(block.shape)


def masked_background(block: np.ndarray, sigma: float) -> np.ndarray:
    """Smoothed values over the smoothed mask of non-zero voxels."""
    mask = (block > 0).astype(float)
    low, weight = gaussian(block, sigma), gaussian(mask, sigma)
    return np.where((mask > 0) & (weight > 0.01), low / np.maximum(weight, 0.01), 0.0)


def normalize_psf(psf: np.ndarray) -> np.ndarray:
    """Values not below 0 that sum to 1; all 0 where nothing is above 0."""
    psf = np.maximum(psf, 0)
    return psf / psf.sum() if psf.sum() > 0 else np.zeros_like(psf)


def richardson_lucy(block: np.ndarray, psf: np.ndarray, rounds: int) -> np.ndarray:
    """Classic iteration by FFT; an approximation of a vendor's variant."""
    psf = normalize_psf(psf)
    pad, axes = np.zeros(block.shape), tuple(range(block.ndim))
    pad[tuple(slice(0, n) for n in psf.shape)] = psf
    pad = np.roll(pad, [-(n // 2) for n in psf.shape], range(block.ndim))
    f = np.fft.rfftn(pad)
    out = np.maximum(block.astype(float), 1e-6)
    for _ in range(rounds):
        blurred = np.fft.irfftn(np.fft.rfftn(out) * f, block.shape, axes)
        ratio = block / np.maximum(blurred, 1e-6)
        out *= np.maximum(np.fft.irfftn(np.fft.rfftn(ratio) * f.conj(), block.shape, axes), 0)
    return out


def nearest_labels(labels: np.ndarray, shape: tuple) -> np.ndarray:
    """Labels at another size, each voxel from its nearest source."""
    index = [np.clip(np.rint((np.arange(n) + 0.5) * m / n - 0.5).astype(int), 0, m - 1) for n, m in zip(shape, labels.shape, strict=True)]
    return labels[np.ix_(*index)]


def gaussian_profile_fit(x: np.ndarray, y: np.ndarray, pixel: float, rounds: int = 100) -> dict:
    """Levenberg-Marquardt fit of A exp(-(x - m)^2 / 2 s^2) + b."""
    p = np.array([y.max() - y.min(), x[y.argmax()], max((x[-1] - x[0]) / 6, 1e-3), y.min()], float)
    damp = 1e-2

    def model(q):
        return q[0] * np.exp(-((x - q[1]) ** 2) / (2 * q[2] ** 2)) + q[3]

    error = ((y - model(p)) ** 2).sum()
    for _ in range(rounds):
        e = np.exp(-((x - p[1]) ** 2) / (2 * p[2] ** 2))
        j = np.column_stack([e, p[0] * e * (x - p[1]) / p[2] ** 2, p[0] * e * (x - p[1]) ** 2 / p[2] ** 3, np.ones_like(x)])
        a, g = j.T @ j, j.T @ (y - model(p))
        step = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), g)
        tried = ((y - model(p + step)) ** 2).sum()
        if tried < error:
            p, error, damp = p + step, tried, damp / 3
        else:
            damp *= 4
    return {"amplitude": p[0], "center": p[1], "sigma": abs(p[2]), "offset": p[3], "fwhm": 2 * (2 * math.log(2)) ** 0.5 * abs(p[2]) * pixel}
