"""Stage rows, tile transforms, boxes and the tile-overlap graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.session import ensure_checkpoint_dir

STAGE_AXES = ("x", "y", "z")
#: Tables of up to this many tiles are joined by broadcast; above it by cells.
BROADCAST_TILES = 10_000


def axis_delta(binding: str, own: str = "", ref: str = "ref_") -> Column:
    """Signed difference of a stage axis, e.g. ``+x``; ``none`` gives 0."""
    if binding == "none":
        return F.lit(0.0)
    axis = binding[1:]
    delta = F.col(f"{own}{axis}") - F.col(f"{ref}{axis}")
    return -delta if binding[0] == "-" else delta


def stage_translations(positions: DataFrame, stage: DataFrame, calibration: dict[str, str]) -> DataFrame:
    """World z, y, x of each position relative to stage row 0.

    Positions without a row take row 0.
    """
    first = stage.where("row = 0").select(*[F.col(a).alias(f"ref_{a}") for a in STAGE_AXES])
    rows = positions.join(stage, positions["p"] == stage["row"], "left").join(F.broadcast(first), F.lit(True), "left")
    filled = [F.coalesce(F.col(a), F.col(f"ref_{a}")).alias(a) for a in STAGE_AXES]
    rows = rows.select("p", *filled, *[F.col(f"ref_{a}") for a in STAGE_AXES])
    return rows.select("p", *[axis_delta(calibration[w]).alias(f"world_{w}") for w in "zyx"])


def anchor_position(stage: DataFrame) -> DataFrame:
    """The position nearest to the mean stage point; ties to the smallest."""
    mean = stage.agg(*[F.avg(a).alias(f"m_{a}") for a in STAGE_AXES])
    gap = sum(((F.col(a) - F.col(f"m_{a}")) ** 2 for a in STAGE_AXES), F.lit(0.0))
    return stage.join(F.broadcast(mean)).agg(F.min_by("row", F.struct(F.round(gap, 9), "row")).alias("anchor"))


def nominal_transforms(stage: DataFrame, anchor: int, calibration: dict[str, str]) -> DataFrame:
    """Per position the 3 x 4 matrix m00..m23: rotation about x by the
    difference of theta, translation by the signed stage axes."""
    ref = stage.where(F.col("row") == anchor).select(*[F.col(a).alias(f"ref_{a}") for a in (*STAGE_AXES, "theta")])
    rows = stage.join(F.broadcast(ref))
    angle = F.radians(F.col("theta") - F.col("ref_theta"))
    one, zero, c, s = F.lit(1.0), F.lit(0.0), F.cos(angle), F.sin(angle)
    turn = [[one, zero, zero], [zero, c, -s], [zero, s, c]]
    move = [axis_delta(calibration[w]) for w in "xyz"]
    cells = [turn[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)]
    return rows.select(F.col("row").alias("p"), *cells, *[move[i].alias(f"m{i}3") for i in range(3)])


def transform_point(x: Column, y: Column, z: Column) -> list[Column]:
    """Affine image of a point under the columns m00..m23."""
    return [F.col(f"m{i}0") * x + F.col(f"m{i}1") * y + F.col(f"m{i}2") * z + F.col(f"m{i}3") for i in range(3)]


def tile_boxes(transforms: DataFrame, extent_xyz: tuple[float, float, float]) -> DataFrame:
    """Axis-aligned box of the eight transformed corners of each tile.

    The extreme of an affine form over a box is taken coefficient by
    coefficient, which equals the extreme over its corners.
    """
    out = []
    for i, axis in enumerate("xyz"):
        terms = [F.col(f"m{i}{j}") * F.lit(float(e)) for j, e in enumerate(extent_xyz)]
        low = sum((F.least(F.lit(0.0), t) for t in terms), F.col(f"m{i}3"))
        high = sum((F.greatest(F.lit(0.0), t) for t in terms), F.col(f"m{i}3"))
        out += [low.alias(f"min_{axis}"), high.alias(f"max_{axis}")]
    return transforms.select("p", *out)


def overlap_edges(boxes: DataFrame, voxel_xyz: tuple[float, float, float], cell_um: float | None = None) -> DataFrame:
    """Pairs of tiles whose boxes overlap with positive volume on every axis.

    Boxes are dealt to grid cells and joined on equal cells, so the pairs that
    are tried grow with the overlaps, not with the square of the tiles.  The
    cell defaults to the largest box side.
    """
    if cell_um is None:
        side = F.greatest(*[F.max(F.col(f"max_{a}") - F.col(f"min_{a}")) for a in "xyz"])
        cell_um = max(float(boxes.agg(side.alias("s")).first()["s"] or 1.0), 1e-6)
    dealt = boxes
    for a in "xy":
        cells = F.sequence(F.floor(F.col(f"min_{a}") / cell_um), F.floor(F.col(f"max_{a}") / cell_um))
        dealt = dealt.withColumn(f"cell_{a}", F.explode(cells))
    names = ["p", *[f"{s}_{a}" for a in "xyz" for s in ("min", "max")]]
    left = dealt.select("cell_x", "cell_y", *[F.col(n).alias(f"l_{n}") for n in names])
    right = dealt.select("cell_x", "cell_y", *[F.col(n).alias(f"r_{n}") for n in names])
    pairs = left.join(right, ["cell_x", "cell_y"]).where("l_p < r_p")
    bounds, voxels = [], F.lit(1).cast("long")
    for a, size in zip("xyz", voxel_xyz, strict=True):
        low, high = F.greatest(f"l_min_{a}", f"r_min_{a}"), F.least(f"l_max_{a}", f"r_max_{a}")
        pairs = pairs.where(low < high)
        bounds += [low.alias(f"min_{a}"), high.alias(f"max_{a}")]
        voxels = voxels * F.greatest(F.lit(1), F.floor((high - low) / size + 1e-9).cast("long"))
    out = pairs.select(F.col("l_p").alias("fixed"), F.col("r_p").alias("moving"), *bounds, voxels.alias("overlap_voxels"))
    return out.dropDuplicates(["fixed", "moving"])


def crop_regions(edges: DataFrame, voxel_xyz: tuple[float, float, float], pad: tuple[int, int, int]) -> DataFrame:
    """Overlap boxes padded by voxels, with their size in voxels."""
    out = ["fixed", "moving"]
    for a, size, n in zip("xyz", voxel_xyz, pad, strict=True):
        low, high = F.col(f"min_{a}") - n * size, F.col(f"max_{a}") + n * size
        out += [low.alias(f"min_{a}"), F.greatest(F.lit(1), F.ceil((high - low) / size - 1e-9)).cast("int").alias(f"size_{a}")]
    return edges.select(*out)


def budget_factor(shape: tuple[int, int, int], budget: int) -> int:
    """Smallest integer stride that meets the voxel budget; <= 0 is no limit."""
    factor = 1
    while budget > 0 and (-(-shape[0] // factor)) * (-(-shape[1] // factor)) * (-(-shape[2] // factor)) > budget:
        factor += 1
    return factor


def rotation_xyz(x_deg: Column, y_deg: Column, z_deg: Column) -> list[list[Column]]:
    """Rz @ Ry @ Rx for degrees."""
    (cx, sx), (cy, sy), (cz, sz) = [(F.cos(F.radians(a)), F.sin(F.radians(a))) for a in (x_deg, y_deg, z_deg)]
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def shear_rotation(rotation: list[list[Column]], xy: Column, xz: Column, yz: Column) -> list[list[Column]]:
    """R @ [[1, xy, xz], [0, 1, yz], [0, 0, 1]]."""
    return [[r[0], r[0] * xy + r[1], r[0] * xz + r[1] * yz + r[2]] for r in rotation]


def connected_positions(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """(p, component): smallest position reachable over the edges.

    Labels spread by grouped minima; every round halves paths by jumping to
    the label of the label.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select(F.col("fixed").alias("p"), F.col("moving").alias("q"))
    both = both.unionByName(both.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
    labels = positions.select("p", F.col("p").alias("component"))
    changed = 1
    while changed:
        near = both.join(labels.select(F.col("p").alias("q"), F.col("component").alias("other")), "q")
        least = near.groupBy("p").agg(F.min("other").alias("other"))
        moved = labels.join(least, "p", "left").select("p", "component", F.least("component", F.coalesce("other", "component")).alias("next"))
        jump = moved.select(F.col("p").alias("next"), F.col("next").alias("far"))
        stepped = moved.join(jump, "next", "left").select("p", "component", F.least("next", F.coalesce("far", "next")).alias("new"))
        stepped = stepped.checkpoint()
        changed = stepped.where("component <> new").count()
        labels = stepped.select("p", F.col("new").alias("component"))
    return labels
