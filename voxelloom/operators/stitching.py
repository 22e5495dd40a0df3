"""Stitching of projection tiles along x."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators import fusion

#: Names of projection tiles: projection, position, time and channel.
TILE_NAME = r"(?i)mip_(xy|xz|yz)_p(\d+)_t(\d+)_c(\d+)\.tiff?$"


@dataclass(frozen=True)
class Canvas:
    height: int
    width: int
    step: int
    margin: int

    def origin(self, tile: int) -> int:
        """First column of a tile."""
        return self.margin + tile * self.step


def discover(paths: DataFrame) -> DataFrame:
    """(path, projection, p, t, c) of the paths that are projection tiles."""
    part = lambda i: F.regexp_extract("path", TILE_NAME, i)
    rows = paths.where(F.col("path").rlike(TILE_NAME))
    return rows.select("path", F.lower(part(1)).alias("projection"), *[part(i).cast("int").alias(n) for i, n in ((2, "p"), (3, "t"), (4, "c"))])


def grouped(tiles: DataFrame) -> DataFrame:
    """One row per projection, time and channel with the number of tiles."""
    return tiles.groupBy("projection", "t", "c").agg(F.countDistinct("p").alias("tiles"), F.min("p").alias("first"), F.max("p").alias("last"))


def canvas(shape_yx: tuple[int, int], tiles: int, overlap: float, margin: float) -> Canvas:
    """Canvas of tiles side by side with shared strips and a margin around."""
    height, width = shape_yx
    step, pad = max(1, round(width * (1 - overlap))), round(width * margin)
    return Canvas(height + 2 * pad, step * (tiles - 1) + width + 2 * pad, step, pad)


def overlap_strip(layout: Canvas, width: int, fixed: int, moving: int) -> tuple[int, int]:
    """Half-open canvas columns that two tiles share; empty if they do not."""
    low = max(layout.origin(fixed), layout.origin(moving))
    high = min(layout.origin(fixed), layout.origin(moving)) + width
    return low, max(low, high)


def stitch(pixels: DataFrame, offsets: DataFrame, shape_yx: tuple[int, int], tiles: int, overlap: float, floor: float = 1e-3, limits: tuple = (0, 65535)) -> DataFrame:
    """Weighted mean of tiles on the canvas: (t, c, y, x, v).

    ``pixels`` hold (t, p, c, y, x, v), ``offsets`` one row per tile (p, oy,
    ox).  Pixels without weight do not appear.
    """
    profiles = F.create_map(
        *[x for p in range(tiles) for x in (F.lit(p), F.array(*[F.lit(float(w)) for w in fusion.stitch_profile(shape_yx[1], p, tiles, overlap, floor)]))]
    )
    rows = pixels.join(offsets, "p").withColumn("w", F.element_at(F.element_at(profiles, F.col("p")), F.col("x") + 1))
    sums = rows.groupBy("t", "c", (F.col("y") + F.col("oy")).alias("wy"), (F.col("x") + F.col("ox")).alias("wx")).agg(
        F.sum(F.col("v") * F.col("w")).alias("a"), F.sum("w").alias("w")
    )
    value = fusion.cast_rounded(F.col("a") / F.col("w"), *limits)
    return sums.where("w > 0").select("t", "c", F.col("wy").alias("y"), F.col("wx").alias("x"), value.alias("v"))


def crop_box(stitched: DataFrame) -> DataFrame:
    """Tight half-open box of the pixels that have a value, per (t, c)."""
    return stitched.groupBy("t", "c").agg(
        F.min("y").alias("y_start"), (F.max("y") + 1).alias("y_stop"), F.min("x").alias("x_start"), (F.max("x") + 1).alias("x_stop")
    )


def register_positions(pixels: DataFrame, layout: Canvas, shape_yx: tuple[int, int], tiles: int, anchor: int | None = None, upsample: int = 10) -> DataFrame:
    """(p, dy, dx): shift of every tile of a row of tiles against the anchor.

    ``pixels`` (p, y, x, v) are one projection of one time and channel.  Each
    neighbouring pair is registered on the strip that it shares, by phase
    correlation, and the shifts add up from the anchor (by default the middle
    tile) outwards.  A pair is one task that holds two strips.
    """
    import numpy as np
    import pandas as pd

    from voxelloom.operators import kernels

    width = shape_yx[1]
    strips = []
    for a in range(tiles - 1):
        low, high = overlap_strip(layout, width, a, a + 1)
        strips += [(a, p, low - layout.origin(p), high - layout.origin(p)) for p in (a, a + 1)]
    table = pixels.sparkSession.createDataFrame(strips, "pair int, p int, low int, high int")
    rows = pixels.join(table, "p").where("x >= low AND x < high")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pair, parts = int(pdf["pair"].iloc[0]), []
        for p in (pair, pair + 1):
            own = pdf[pdf["p"] == p]
            part = np.zeros((1, shape_yx[0], int(pdf["high"].iloc[0] - pdf["low"].iloc[0])))
            part[0, own["y"].to_numpy(), (own["x"] - own["low"]).to_numpy()] = own["v"].to_numpy()
            parts.append(part - part.mean())
        shift = kernels.phase_shift(*parts, upsample)
        return pd.DataFrame([(pair, float(shift[1]), float(shift[2]))], columns=["pair", "dy", "dx"])

    found = {r["pair"]: (r["dy"], r["dx"]) for r in rows.groupBy("pair").applyInPandas(run, "pair int, dy double, dx double").collect()}  # one row for each pair of tiles
    anchor = tiles // 2 if anchor is None else anchor
    at = {anchor: (0.0, 0.0)}
    for p in range(anchor + 1, tiles):
        at[p] = tuple(a + b for a, b in zip(at[p - 1], found.get(p - 1, (0.0, 0.0)), strict=True))
    for p in range(anchor - 1, -1, -1):
        at[p] = tuple(a - b for a, b in zip(at[p + 1], found.get(p, (0.0, 0.0)), strict=True))
    return pixels.sparkSession.createDataFrame([(p, *at[p]) for p in sorted(at)], "p int, dy double, dx double")


def process(planes: DataFrame, shape_yx: tuple[int, int], tiles: int, overlap: float, margin: float, channel: int) -> DataFrame:
    """(t, c, y, x, v): every time point stitched with the shifts of one channel.

    ``planes`` are (t, p, c, y, x, v) of one projection; shifts are rounded to
    whole pixels and hold for all channels of their time point.
    """
    layout, out = canvas(shape_yx, tiles, overlap, margin), None
    for row in planes.select("t").distinct().orderBy("t").collect():  # one row for each time point
        own = planes.where(F.col("t") == row["t"])
        shifts = register_positions(own.where(F.col("c") == channel), layout, shape_yx, tiles)
        places = [(r["p"], layout.margin + round(r["dy"]), layout.origin(r["p"]) + round(r["dx"])) for r in shifts.collect()]
        offsets = planes.sparkSession.createDataFrame(places, "p int, oy int, ox int")
        made = stitch(own, offsets, shape_yx, tiles, overlap)
        out = made if out is None else out.unionByName(made)
    return out
