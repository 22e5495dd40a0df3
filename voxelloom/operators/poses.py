"""Poses, affine parts and solves over the tile graph, all in x, y, z order.

Graphs have one row per tile pair, so they are solved on the driver.
"""

from __future__ import annotations

import math

import numpy as np

from voxelloom.operators.registration import components

#: Evaluations that a non-linear solve may take.
MAX_EVALUATIONS = 200


def rotation_of(vector: np.ndarray) -> np.ndarray:
    """Rotation matrix of a rotation vector (axis times radians)."""
    angle = float(np.linalg.norm(vector))
    if angle < 1e-12:
        return np.eye(3)
    x, y, z = np.asarray(vector) / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def vector_of(rotation: np.ndarray) -> np.ndarray:
    """Rotation vector of a rotation matrix."""
    angle = math.acos(min(1.0, max(-1.0, (np.trace(rotation) - 1) / 2)))
    if angle < 1e-9:
        return np.zeros(3)
    if math.pi - angle < 1e-6:  # the antisymmetric part vanishes
        axis = np.sqrt(np.maximum((np.diag(rotation) + 1) / 2, 0))
        k = int(axis.argmax())
        signs = np.sign(rotation[k] + (np.arange(3) == k))
        return angle * axis * np.where(signs == 0, 1, signs)
    skew = np.array([rotation[2, 1] - rotation[1, 2], rotation[0, 2] - rotation[2, 0], rotation[1, 0] - rotation[0, 1]])
    return angle * skew / (2 * math.sin(angle))


def pose_to_matrix(pose: np.ndarray, kind: str = "rigid") -> np.ndarray:
    """4 x 4 matrix of (rotation vector, translation[, log scale])."""
    out = np.eye(4)
    out[:3, :3] = rotation_of(pose[:3]) * (math.exp(pose[6]) if kind == "similarity" else 1.0)
    out[:3, 3] = pose[3:6]
    return out


def matrix_to_pose(matrix: np.ndarray, kind: str = "rigid") -> np.ndarray:
    """The pose whose matrix is nearest."""
    u, s, vt = np.linalg.svd(matrix[:3, :3])
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    pose = np.concatenate([vector_of(u @ flip @ vt), matrix[:3, 3]])
    return np.append(pose, math.log(max(s.mean(), 1e-12))) if kind == "similarity" else pose


def quaternion(rotation: np.ndarray) -> np.ndarray:
    """(w, x, y, z) of a rotation matrix, w not negative."""
    vector = vector_of(rotation)
    angle = float(np.linalg.norm(vector))
    if angle < 1e-12:
        return np.array([1.0, 0, 0, 0])
    return np.concatenate([[math.cos(angle / 2)], vector / angle * math.sin(angle / 2)])


def _euler_yzx(angles: np.ndarray) -> np.ndarray:
    """Rotation of extrinsic turns around y, then z, then x, in degrees."""
    y, z, x = np.radians(angles)
    ry, rz, rx = rotation_of([0, y, 0]), rotation_of([0, 0, z]), rotation_of([x, 0, 0])
    return rx @ rz @ ry


def _angles_yzx(m: np.ndarray) -> np.ndarray:
    """The angles of :func:`_euler_yzx`; the last one is 0 where they are not unique."""
    z = -math.asin(min(1.0, max(-1.0, m[0, 1])))
    if abs(math.cos(z)) < 1e-9:
        return np.degrees([math.atan2(-m[2, 0], m[2, 2]), z, 0.0])
    return np.degrees([math.atan2(m[0, 2], m[0, 0]), z, math.atan2(m[2, 1], m[1, 1])])


def slerp_angles(start, end, fractions) -> list[np.ndarray]:
    """Camera angles (y, z, x degrees) on the shortest turn from ``start`` to ``end``."""
    a, b = _euler_yzx(np.asarray(start, float)), _euler_yzx(np.asarray(end, float))
    turn = vector_of(a.T @ b)
    return [_angles_yzx(a @ rotation_of(turn * float(f))) for f in fractions]


def position_affine(dx: float, dy: float, dz: float, theta_deg: float) -> np.ndarray:
    """6 x 6 homogeneous matrix over t, c, z, y, x of a stage position.

    The turn lies in the z, y plane; the last column moves by the stage's
    shift in world units, which no layer scale changes.
    """
    out = np.eye(6)
    c, s = math.cos(math.radians(theta_deg)), math.sin(math.radians(theta_deg))
    out[2:4, 2:4] = [[c, s], [-s, c]]
    out[2:5, 5] = dz, dy, dx
    return out


def position_affines(stage: list[dict], selected: list[int]) -> dict[int, np.ndarray]:
    """Position affines of the selected stage rows (p, x, y, z, theta) against the first of them."""
    rows = {int(r["p"]): r for r in stage}
    known = [p for p in selected if p in rows]
    if not known:
        return {p: np.eye(6) for p in selected}
    ref = rows[known[0]]
    out = {}
    for p in selected:
        r = rows.get(p, ref)
        dx, dy, dz, turn = (float(r[k]) - float(ref[k]) for k in ("x", "y", "z", "theta"))
        out[p] = position_affine(dx, dy, dz, turn)
    return out


def translation_of(matrix: np.ndarray, centre=(0.0, 0.0, 0.0)) -> np.ndarray:
    """Translation of an affine that turns about ``centre``."""
    centre = np.asarray(centre, float)
    return matrix[:3, 3] + centre - matrix[:3, :3] @ centre


def swap_columns(rows_columns: np.ndarray) -> np.ndarray:
    """(row, column) points as (x, y)."""
    return np.asarray(rows_columns)[:, ::-1]


def tile_extent(shape_zyx, voxel_zyx) -> np.ndarray:
    """World size (x, y, z) of a tile."""
    return (np.asarray(shape_zyx, float) * np.asarray(voxel_zyx, float))[::-1]


def oblique_voxel(voxel_zyx, matrix: np.ndarray, geometry: dict | None) -> tuple[float, float, float]:
    """Voxel size whose z follows from a stage scan along z with the stage on y.

    z is the scan step over the absolute entry by which the affine (x, y, z
    order) moves y with z; any other geometry leaves the size as it is.
    """
    z, y, x = map(float, voxel_zyx)
    text = lambda k: str((geometry or {}).get(k, "")).strip().lower()
    slant = abs(float(matrix[1, 2]))
    try:
        step = float((geometry or {}).get("scan_step_um"))
    except (TypeError, ValueError):
        return z, y, x
    if (text("mode"), text("scan_axis"), text("stage_axis")) != ("stage_scan", "z", "y") or slant <= 1e-8 or not (math.isfinite(step) and step > 0):
        return z, y, x
    return step / slant, y, x


def lattice(low_xyz, high_xyz, spacing_zyx) -> tuple[np.ndarray, np.ndarray]:
    """(origin, nodes along z, y, x) of a lattice that covers a box."""
    low, high = np.asarray(low_xyz, float), np.asarray(high_xyz, float)
    return low, np.ceil((high - low)[::-1] / np.asarray(spacing_zyx, float)).astype(int) + 1


def lattice_displacement(points_zyx: np.ndarray, nodes: np.ndarray, origin_zyx, spacing_zyx) -> np.ndarray:
    """Trilinear displacement at world points; beyond the lattice its edge counts."""
    shape = np.array(nodes.shape[:3])
    at = (np.asarray(points_zyx, float) - np.asarray(origin_zyx, float)) / np.asarray(spacing_zyx, float)
    at = np.clip(at, 0, shape - 1)
    base = np.minimum(at.astype(int), np.maximum(shape - 2, 0))
    part, out = at - base, np.zeros((len(at), nodes.shape[3]))
    for corner in range(8):
        bits = np.array([corner >> 2 & 1, corner >> 1 & 1, corner & 1])
        where = np.minimum(base + bits, shape - 1)
        out += np.prod(np.where(bits, part, 1 - part), axis=1)[:, None] * nodes[tuple(where.T)]
    return out


def source_box(to_world: np.ndarray, origin_xyz, shape_zyx, source_shape_zyx, voxel_zyx, padding: int = 1, margin_um: float = 0.0):
    """Half-open source region (z, y, x) that a reference grid needs, or None.

    ``to_world`` takes local world units to world; ``margin_um`` widens the
    grid for displacements.
    """
    voxel = np.asarray(voxel_zyx, float)[::-1]
    low = np.asarray(origin_xyz, float) - margin_um
    high = np.asarray(origin_xyz, float) + (np.asarray(shape_zyx, float)[::-1] - 1) * voxel + margin_um
    corners = np.array([[(low, high)[i >> k & 1][k] for k in range(3)] + [1.0] for i in range(8)])
    local = (np.linalg.inv(to_world) @ corners.T)[:3].T / voxel
    shape = np.asarray(source_shape_zyx)[::-1]
    start = np.clip(np.floor(local.min(0)).astype(int) - padding, 0, shape)
    stop = np.clip(np.ceil(local.max(0)).astype(int) + 1 + padding, 0, shape)
    if (stop <= start).any():
        return None
    return tuple(slice(int(a), int(b)) for a, b in zip(start[::-1], stop[::-1], strict=True))


def least_squares(function, start: np.ndarray, evaluations: int = MAX_EVALUATIONS) -> np.ndarray:
    """Damped Gauss-Newton with differences; stops when steps no longer help."""
    x, damping = np.asarray(start, float), 1e-3
    value, used = function(x), 1
    while used < evaluations:
        step = 1e-6
        jacobian = np.array([(function(x + step * e) - value) / step for e in np.eye(len(x))]).T
        used += 1
        while used < evaluations:
            normal = jacobian.T @ jacobian
            move = np.linalg.solve(normal + damping * np.diag(np.maximum(np.diag(normal), 1e-12)), -jacobian.T @ value)
            tried = function(x + move)
            used += 1
            if tried @ tried < value @ value:
                gain = value @ value - tried @ tried
                x, value, damping = x + move, tried, max(damping / 5, 1e-12)
                if gain < 1e-14 * max(1.0, value @ value) or np.linalg.norm(move) < 1e-10:
                    return x
                break
            damping *= 4
            if damping > 1e9:
                return x
    return x


def solve_poses(positions: list[int], edges: list[dict], anchor: int, kind: str = "rigid", lever: float = 1.0) -> dict[int, np.ndarray]:
    """Rigid or similarity pose matrices of all tiles.

    An edge says inv(fixed pose) @ moving pose = its ``matrix``; residuals are
    weighted with sqrt(overlap), turns (and log scales) count ``lever`` world
    units a radian.  The anchor, or the smallest position of a component
    without it, stays at the identity.
    """
    width = 7 if kind == "similarity" else 6
    out = {p: np.eye(4) for p in positions}
    for part in components(positions, [(e["fixed"], e["moving"]) for e in edges]):
        root = anchor if anchor in part else part[0]
        free, own = [p for p in part if p != root], [e for e in edges if e["fixed"] in part]
        if not free or not own:
            continue
        first = {root: np.eye(4)}
        while len(first) < len(part):  # along the edges from the root
            for e in own:
                a, b, m = e["fixed"], e["moving"], np.asarray(e["matrix"], float)
                if a in first and b not in first:
                    first[b] = first[a] @ m
                elif b in first and a not in first:
                    first[a] = first[b] @ np.linalg.inv(m)

        def matrices(x, free=free, root=root):
            return {root: np.eye(4)} | {p: pose_to_matrix(x[i * width : (i + 1) * width], kind) for i, p in enumerate(free)}

        def errors(x, own=own):
            at, rows = matrices(x), []
            for e in own:
                gap = matrix_to_pose(np.linalg.inv(np.asarray(e["matrix"], float)) @ np.linalg.inv(at[e["fixed"]]) @ at[e["moving"]], kind)
                gap[:3] *= lever
                gap[6:] *= lever
                rows.append(gap * max(float(e.get("overlap_voxels", 1)), 1.0) ** 0.5)
            return np.concatenate(rows)

        found = least_squares(errors, np.concatenate([matrix_to_pose(first[p], kind) for p in free]))
        out |= {p: m for p, m in matrices(found).items() if p != root}
    return out


def solve_offsets(positions: list[int], edges: list[dict], anchor: int, gains: dict[int, float]) -> dict[int, float]:
    """Offsets after the gains are known: least squares, the anchor's is 0.

    An edge's measured ``offset`` is what the moving tile lacks in the fixed
    tile's units, so gain_fixed * offset = offset_moving - offset_fixed.
    """
    out = {p: 0.0 for p in positions}
    for part in components(positions, [(e["fixed"], e["moving"]) for e in edges]):
        root = anchor if anchor in part else part[0]
        free, own = [p for p in part if p != root], [e for e in edges if e["fixed"] in part]
        if not free or not own:
            continue
        a, b = np.zeros((len(own), len(free))), np.zeros(len(own))
        for i, e in enumerate(own):
            w = max(float(e.get("overlap_voxels", 1)), 1.0) ** 0.5
            for p, sign in ((e["moving"], 1.0), (e["fixed"], -1.0)):
                if p != root:
                    a[i, free.index(p)] += sign * w
            b[i] = gains.get(e["fixed"], 1.0) * float(e["offset"]) * w
        out |= dict(zip(free, map(float, np.linalg.lstsq(a, b, rcond=None)[0]), strict=True))
    return out
