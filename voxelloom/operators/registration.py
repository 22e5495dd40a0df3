"""Pairwise tile registration and global solutions.

Edges are few and are solved on the driver; per-edge measurements run as
grouped tasks and are keyed by their edge, never by arrival.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators import kernels

ABSOLUTE_LIMIT, RELATIVE_LIMIT = 3.5, 2.5


def components(positions: list[int], edges: list[tuple[int, int]]) -> list[list[int]]:
    """Connected positions, smallest first."""
    near: dict[int, set[int]] = {p: set() for p in positions}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    left, out = set(positions), []
    for start in sorted(positions):
        if start not in left:
            continue
        seen, todo = {start}, [start]
        while todo:
            for q in near[todo.pop()] - seen:
                seen.add(q)
                todo.append(q)
        left -= seen
        out.append(sorted(seen))
    return out


def solve_translations(positions: list[int], edges: list[dict], anchor: int) -> dict[int, np.ndarray]:
    """Least squares with weights sqrt(overlap); the anchor stays at 0.

    An edge says t_moving - t_fixed = shift.  Components without the anchor
    are held at their smallest position.
    """
    out = {p: np.zeros(3) for p in positions}
    for part in components(positions, [(e["fixed"], e["moving"]) for e in edges]):
        root = anchor if anchor in part else part[0]
        free = [p for p in part if p != root]
        own = [e for e in edges if e["fixed"] in part]
        if not free or not own:
            continue
        a, b = np.zeros((len(own), len(free))), np.zeros((len(own), 3))
        for i, e in enumerate(own):
            w = max(float(e.get("overlap_voxels", 1)), 1.0) ** 0.5
            for p, sign in ((e["moving"], 1.0), (e["fixed"], -1.0)):
                if p != root:
                    a[i, free.index(p)] += sign * w
            b[i] = np.asarray(e["shift"], float) * w
        found = np.linalg.lstsq(a, b, rcond=None)[0]
        out |= dict(zip(free, found, strict=True))
    return out


def residuals(solution: dict[int, np.ndarray], edges: list[dict], voxel: float) -> np.ndarray:
    return np.array(
        [np.linalg.norm(solution[e["moving"]] - solution[e["fixed"]] - np.asarray(e["shift"])) / voxel for e in edges]
    )


def solve_with_pruning(positions: list[int], edges: list[dict], anchor: int, voxel: float = 1.0):
    """(solution, kept edges, residual of each edge; dropped ones NaN).

    The worst edge goes while it exceeds 3.5 voxels and 2.5 times the mean,
    unless that would leave its component without a loop.
    """
    active = list(range(len(edges)))
    while True:
        own = [edges[i] for i in active]
        solution = solve_translations(positions, own, anchor)
        errors = residuals(solution, own, voxel)
        if not len(errors):
            break
        worst = int(errors.argmax())
        part = next(c for c in components(positions, [(e["fixed"], e["moving"]) for e in own]) if own[worst]["fixed"] in c)
        inside = sum(e["fixed"] in part for e in own)
        if errors[worst] <= ABSOLUTE_LIMIT or errors[worst] <= RELATIVE_LIMIT * errors.mean() or inside <= len(part) - 1:
            break
        del active[worst]
    out = np.full(len(edges), np.nan)
    out[active] = residuals(solution, [edges[i] for i in active], voxel)
    return solution, active, out


def solve_log_gains(positions: list[int], edges: list[dict], anchor: int) -> dict[int, float]:
    """Gains whose ratios fit the measured ones best on the log scale."""
    logs = [e | {"shift": [np.log(max(e["gain"], 1e-6)), 0, 0]} for e in edges]
    return {p: float(np.exp(v[0])) for p, v in solve_translations(positions, logs, anchor).items()}


def solve_lattice(nodes: int, samples: list[tuple[int, float, float]], ridge: float = 0.1, limit: float = 20.0) -> np.ndarray:
    """Ridge displacement of each node from (node, weight, value), clamped."""
    out = np.zeros(nodes)
    for node in range(nodes):
        own = [(w, v) for n, w, v in samples if n == node]
        if own:
            w, v = np.array(own).T
            out[node] = np.clip((w * w * v).sum() / ((w * w).sum() + ridge), -limit, limit)
    return out


def pairwise_shifts(crops: DataFrame, upsample: int = 10) -> DataFrame:
    """Phase-correlation shift of each edge.

    ``crops`` hold (edge, z, y, x, fixed, moving); an edge is one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [pdf[a].to_numpy() - int(pdf[a].min()) for a in "zyx"]
        shape = [int(i.max()) + 1 for i in at]
        blocks = []
        for side in ("fixed", "moving"):
            block = np.zeros(shape)
            block[tuple(at)] = pdf[side].to_numpy()
            blocks.append(block)
        shift = kernels.phase_shift(*blocks, upsample)
        return pd.DataFrame({"edge": [pdf["edge"].iloc[0]], "dz": [shift[0]], "dy": [shift[1]], "dx": [shift[2]]})

    return crops.groupBy("edge").applyInPandas(run, "edge long, dz double, dy double, dx double")


def fit_similarity(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """2 x 3 similarity by the closed form of Umeyama."""
    ms, md = src.mean(0), dst.mean(0)
    a, b = src - ms, dst - md
    u, s, vt = np.linalg.svd(b.T @ a / len(src))
    d = np.array([1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    scale = (s * d).sum() / max((a * a).sum() / len(src), 1e-12)
    rot = scale * (u * d) @ vt
    return np.column_stack([rot, md - rot @ ms])


def ransac_similarity(src: np.ndarray, dst: np.ndarray, threshold: float = 2.0, trials: int = 500, seed: int = 0):
    """(2 x 3 matrix, inliers): the model most points agree with, refitted."""
    rng, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    if len(src) < 3:
        return None, best
    for _ in range(trials):
        some = rng.choice(len(src), 3, replace=False)
        m = fit_similarity(src[some], dst[some])
        good = np.linalg.norm(src @ m[:, :2].T + m[:, 2] - dst, axis=1) < threshold
        if good.sum() > best.sum():
            best = good
    return (fit_similarity(src[best], dst[best]), best) if best.sum() >= 3 else (None, best)


def decompose(matrix: np.ndarray) -> dict:
    """Scale, rotation (xyz degrees) and shear of a 3 x 3 matrix."""
    u, s, vt = np.linalg.svd(matrix)
    rot = u @ vt
    stretch = vt.T @ np.diag(s) @ vt
    if np.linalg.det(rot) < 0:
        angles = np.zeros(3)
    else:
        angles = np.degrees([np.arctan2(rot[2, 1], rot[2, 2]), -np.arcsin(np.clip(rot[2, 0], -1, 1)), np.arctan2(rot[1, 0], rot[0, 0])])
    q, r = np.linalg.qr(stretch[::-1].T)
    upper = r.T[::-1, ::-1]
    diagonal = np.diag(upper)
    shear = np.degrees(np.arctan([upper[0, 1] / diagonal[1], upper[0, 2] / diagonal[2], upper[1, 2] / diagonal[2]]))
    return {"scale": np.abs(diagonal), "rotation": angles, "shear": shear}


def envelope_tilt(projection: DataFrame, z_um: float, y_um: float, fraction: float = 0.1) -> DataFrame:
    """Tilt in degrees of the first and last bright z over y.

    ``projection`` holds (z, y, v).  The slope is fitted to the columns whose
    z lies within the 5-95 percentiles; the median of both edges counts.
    """
    limits = projection.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bright = projection.join(F.broadcast(limits)).where(F.col("v") > F.col("lo") + fraction * (F.col("hi") - F.col("lo")))
    edges = bright.groupBy("y").agg(F.min("z").alias("first"), F.max("z").alias("last"))
    sides = edges.select("y", F.explode(F.array(F.struct(F.lit("first").alias("side"), F.col("first").alias("z")), F.struct(F.lit("last").alias("side"), F.col("last").alias("z")))).alias("s")).select("y", "s.side", F.col("s.z").cast("double").alias("z"))
    q = sides.groupBy("side").agg(F.percentile("z", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    kept = sides.join(F.broadcast(q), "side").where((F.col("z") >= F.col("q")[0]) & (F.col("z") <= F.col("q")[1]))
    slope = kept.groupBy("side").agg(F.regr_slope("z", "y").alias("slope"))
    return slope.agg(F.percentile(F.degrees(F.atan(F.col("slope") * z_um / y_um)), F.lit(0.5)).alias("tilt_deg"))


def measure_edges(voxels: DataFrame, edges: DataFrame, transforms: DataFrame, voxel_xyz: tuple, pad: int = 0, upsample: int = 10) -> DataFrame:
    """(t, fixed, moving, dx, dy, dz, overlap_voxels): shift in micrometres
    that brings the moving tile onto the fixed one.

    ``edges`` carry the overlap box; a voxel is sent to the edges of its tile
    whose padded box holds it, so that an edge of a time point is one task.
    """
    sides = edges.withColumn("p", F.explode(F.array("fixed", "moving")))
    world = voxels.join(transforms, "p")
    for i, a in enumerate("xyz"):
        place = sum((F.col(f"m{i}{j}") * F.col(b) * float(voxel_xyz[j]) for j, b in enumerate("xyz")), F.col(f"m{i}3"))
        world = world.withColumn(f"w{a}", place)
    rows = world.select("t", "p", "wx", "wy", "wz", "v").join(sides, "p")  # one row per tile pair and side
    for a, size in zip("xyz", voxel_xyz, strict=True):
        edge = pad * size + 1e-6
        rows = rows.where((F.col(f"w{a}") >= F.col(f"min_{a}") - edge) & (F.col(f"w{a}") < F.col(f"max_{a}") + edge))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        low = [float(first[f"min_{a}"]) - pad * s for a, s in zip("xyz", voxel_xyz, strict=True)]
        at = [np.rint((pdf[f"w{a}"].to_numpy() - o) / s).astype(int) for a, o, s in zip("xyz", low, voxel_xyz, strict=True)]
        at = [np.maximum(i, 0) for i in at]
        shape = [int(i.max()) + 1 for i in at[::-1]]
        blocks = []
        for side in ("fixed", "moving"):
            own = (pdf["p"] == pdf[side]).to_numpy()
            block = np.zeros(shape)
            block[tuple(i[own] for i in at[::-1])] = pdf["v"].to_numpy()[own]
            blocks.append(block - block.mean())
        shift = kernels.phase_shift(*blocks, upsample)[::-1] * np.array(voxel_xyz)
        keys = {k: int(first[k]) for k in ("t", "fixed", "moving", "overlap_voxels")}
        return pd.DataFrame([keys | dict(zip(("dx", "dy", "dz"), shift.tolist(), strict=True))])

    schema = "t int, fixed int, moving int, overlap_voxels long, dx double, dy double, dz double"
    return rows.groupBy("t", "fixed", "moving").applyInPandas(run, schema)


def register_tiles(voxels: DataFrame, edges: DataFrame, transforms: DataFrame, voxel_xyz: tuple, anchor: int, **options) -> DataFrame:
    """(t, p, dx, dy, dz, residual): corrections of all tiles by time point.

    Measured edges (one row per tile pair and time point) are solved on the
    driver, the worst ones pruned; the anchor stays.
    """
    rows = measure_edges(voxels, edges, transforms, voxel_xyz, **options).collect()
    positions = sorted(r["p"] for r in transforms.select("p").collect())
    out = []
    for t in sorted({r["t"] for r in rows}):
        own = sorted((r for r in rows if r["t"] == t), key=lambda r: (r["fixed"], r["moving"]))
        found = [
            {"fixed": r["fixed"], "moving": r["moving"], "overlap_voxels": r["overlap_voxels"], "shift": [r["dx"], r["dy"], r["dz"]]} for r in own
        ]
        solution, _, errors = solve_with_pruning(positions, found, anchor, float(np.mean(voxel_xyz)))
        for p, v in solution.items():
            near = [e for e, r in zip(errors, own, strict=True) if p in (r["fixed"], r["moving"]) and not np.isnan(e)]
            out.append((t, p, *[float(x) for x in v], float(max(near)) if near else float("nan")))
    return voxels.sparkSession.createDataFrame(out, "t int, p int, dx double, dy double, dz double, residual double")


def deconvolve(chunks: DataFrame, psf: np.ndarray, rounds: int = 2, background: float = 110.0) -> DataFrame:
    """Richardson-Lucy of each (t, p, c) volume; approximates a vendor method."""
    from voxelloom.sources.voxels import CHUNK_FIELDS, block_of

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = [int((pdf[f"{a}0"] + pdf[f"n{a}"]).max()) for a in "zyx"]
        volume = np.zeros(shape)
        for _, row in pdf.iterrows():
            volume[tuple(slice(int(row[f"{a}0"]), int(row[f"{a}0"] + row[f"n{a}"])) for a in "zyx")] = block_of(row)
        out = kernels.richardson_lucy(np.maximum(volume - background, 0), psf, rounds).astype(np.float32)
        key = {k: int(pdf[k].iloc[0]) for k in "tpc"} | {"z0": 0, "y0": 0, "x0": 0}
        return pd.DataFrame([key | dict(zip(("nz", "ny", "nx"), shape, strict=True)) | {"dtype": "float32", "payload": out.tobytes()}])

    return chunks.groupBy("t", "p", "c").applyInPandas(run, CHUNK_FIELDS)
