"""Index arithmetic on arrays: slices, tiles, task specs and read budgets.

Plain numbers in and out; the counts are those of chunks or tiles, never of
voxels.  ``tile_table`` and ``transform_table`` give the same specs as rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of a batch of whole planes.
MIN_BATCH_BYTES, MAX_PLANES = 512 << 20, 128
WORKER_SHARE, WORKER_CAP, RAM_SHARE, RAM_CAP = 0.3, 12 << 30, 1 / 16, 8 << 30


def core_crop(read: tuple, core: tuple) -> tuple:
    """Slices of the core inside a read region; both are (start, stop) by axis."""
    return tuple(slice(c0 - r0, c1 - r0) for (r0, _), (c0, c1) in zip(read, core, strict=True))


def strided(slices: tuple, factor: int) -> tuple:
    """Every ``factor``-th index of the slices."""
    return tuple(slice(s.start, s.stop, max(1, int(factor))) for s in slices)


def is_empty(slices: tuple) -> bool:
    """Whether any axis has no length."""
    return any(int(s.stop) - int(s.start) <= 0 for s in slices)


def normalize_index(item, shape: tuple) -> tuple[tuple, tuple]:
    """(slices, axes to squeeze) of a basic index; steps other than 1 are refused."""
    item = item if isinstance(item, tuple) else (item,)
    if Ellipsis in item:
        at = item.index(Ellipsis)
        item = item[:at] + (slice(None),) * (len(shape) - len(item) + 1) + item[at + 1 :]
    if len(item) > len(shape):
        raise IndexError("too many indices")
    out, squeeze = [], []
    for axis, (one, n) in enumerate(itertools.zip_longest(item, shape, fillvalue=slice(None))):
        if isinstance(one, slice):
            start, stop, step = one.indices(n)
            if step != 1:
                raise ValueError("only steps of 1 can be read")
            out.append(slice(start, max(start, stop)))
            continue
        i = int(one) + n if int(one) < 0 else int(one)
        if not 0 <= i < n:
            raise IndexError(f"index {one} on an axis of {n}")
        out.append(slice(i, i + 1))
        squeeze.append(axis)
    return tuple(out), tuple(squeeze)


def centred_box(shape: tuple, size: int) -> tuple:
    """Slices of size // 2 to either side of the centre."""
    if size > min(shape):
        raise ValueError(f"a box of {size} does not fit {shape}")
    return tuple(slice(n // 2 - size // 2, n // 2 + size // 2) for n in shape)


def centre_crop(shape: tuple, target: tuple) -> tuple:
    """Slices of ``target`` voxels from (size - target) // 2 on."""
    starts = [max(0, (n - t) // 2) for n, t in zip(shape, target, strict=True)]
    return tuple(slice(s, s + min(n, t)) for s, n, t in zip(starts, shape, target, strict=True))


def tile_slices(shape: tuple, tile: tuple) -> list[tuple]:
    """Slices of the tiles of an array, last axis fastest."""
    parts = [[slice(i, min(i + t, n)) for i in range(0, n, t)] for n, t in zip(shape, tile, strict=True)]
    return list(itertools.product(*parts))


def tile_table(spark: SparkSession, shape: dict[str, int], tile: dict[str, int]) -> DataFrame:
    """The tiles as rows: start and stop of each axis."""
    rows = spark.range(1)
    for a, n in shape.items():
        starts = F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(tile[a])))
        rows = rows.select("*", starts.alias(f"{a}_start")).withColumn(f"{a}_stop", F.least(F.col(f"{a}_start") + tile[a], F.lit(n)))
    return rows.drop("id")


def halo_tiles(spark: SparkSession, shape: dict[str, int], tile: dict[str, int], overlap: dict[str, int], keys: dict[str, int]) -> DataFrame:
    """Core and read bounds of the y, x tiles that profiles are fitted on, for every key."""
    rows = tile_table(spark, shape, tile)
    for a, n in shape.items():
        rows = rows.withColumn(f"{a}_read_start", F.greatest(F.col(f"{a}_start") - overlap.get(a, 0), F.lit(0)))
        rows = rows.withColumn(f"{a}_read_stop", F.least(F.col(f"{a}_stop") + overlap.get(a, 0), F.lit(n)))
    for k, n in keys.items():
        rows = rows.withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows


def transform_table(keys: DataFrame, shape: dict[str, int], tile: dict[str, int]) -> DataFrame:
    """One row for each (t, p, c) of ``keys`` and y, x tile, with the whole depth.

    Only volumes that exist have tiles: the last time point of an acquisition
    may hold fewer positions than the others.
    """
    tiles = tile_table(keys.sparkSession, {a: shape[a] for a in "yx"}, tile)
    rows = keys.select("t", "p", "c").distinct().crossJoin(tiles)
    return rows.select("t", "p", "c", F.lit(0).alias("z_start"), F.lit(shape["z"]).alias("z_stop"), "y_start", "y_stop", "x_start", "x_stop")


def chunk_starts(size: int, chunk: int, overlap: int) -> list[int]:
    """Starts chunk - overlap apart; the last chunk ends with the axis."""
    step = max(1, chunk - overlap)
    out = list(range(0, max(1, size - chunk + 1), step))
    if out[-1] + chunk < size:
        out.append(size - chunk)
    return out


def registration_chunks(shape: tuple, chunk: int, overlap: int) -> list[dict]:
    """Chunks of a volume with bounds and bounds widened by half the overlap."""
    out = []
    for at in itertools.product(*[chunk_starts(n, min(chunk, n), overlap) for n in shape]):
        core = tuple((s, min(s + chunk, n)) for s, n in zip(at, shape, strict=True))
        wide = tuple((max(0, a - overlap // 2), min(n, b + overlap // 2)) for (a, b), n in zip(core, shape, strict=True))
        out.append({"core": core, "extended": wide})
    return out


def plane_batch(chunk_z: int, plane_bytes: int, worker_memory: int | None, ram: int) -> int:
    """Planes that are written at once: a multiple of the chunk's depth, 128 at most."""
    budget = min(worker_memory * WORKER_SHARE, WORKER_CAP) if worker_memory else min(ram * RAM_SHARE, RAM_CAP)
    planes = min(MAX_PLANES, int(max(budget, MIN_BATCH_BYTES) // max(1, plane_bytes)))
    return max(chunk_z, planes // chunk_z * chunk_z)


def preserved_tile(preserved: tuple, reduced_bytes: int, limit: int = 128 << 20) -> tuple:
    """Tile of the axes a projection keeps, halved on its longest side until reads fit."""
    tile = list(preserved)
    while math.prod(tile) * reduced_bytes > limit and max(tile) > 1:
        k = int(np.argmax(tile))
        tile[k] = -(-tile[k] // 2)
    return tuple(tile)


def downsample_factor(shape: tuple, limit: int) -> int:
    """Smallest whole zoom factor that brings a volume to ``limit`` voxels."""
    total = math.prod(shape)
    return 1 if total <= limit else max(1, math.ceil((total / limit) ** (1 / 3) - 1e-9))


def extend_factors(factors: list[tuple], level: int) -> list[tuple]:
    """(t, p, c, z, y, x) factors, doubled on z, y and x until ``level`` exists."""
    out = [tuple(f) for f in factors]
    while len(out) <= level:
        out.append(out[-1][:3] + tuple(2 * v for v in out[-1][3:]))
    return out


def level_factor(attributes: dict, level: int) -> tuple[int, int, int]:
    """z, y, x factor of a level from a component's attributes."""
    if level == 0:
        return 1, 1, 1
    found = (attributes.get("pyramid_factors_tpczyx") or attributes.get("data_pyramid_factors_tpczyx") or [])
    if level >= len(found):
        raise KeyError(f"no factor for level {level}")
    return tuple(int(v) for v in found[level][3:])


def level_component(component: str, level: int, exists) -> str:
    """Where a level of a component lies: beside it or in a pyramid next to its source."""
    if level == 0:
        return component
    base = component.rsplit("/", 1)[0] + "/" if "/" in component else ""
    for candidate in (f"{component}_pyramid/level_{level}", f"{base}data_pyramid/level_{level}"):
        if exists(candidate):
            return candidate
    raise FileNotFoundError(f"{component} has no level {level}")


def default_contrast(dtype: str) -> tuple[float, float]:
    """The range of an integer type, 0 to 1 for all others."""
    kind = np.dtype(dtype)
    if kind.kind in "iu":
        return float(np.iinfo(kind).min), float(np.iinfo(kind).max)
    return 0.0, 1.0


def recommend_workers(shape: tuple | None, chunks: tuple, itemsize: int, cpus: int, memory: int, most: int = 64) -> dict:
    """Workers, threads and memory of a local session without GPUs.

    A reserve of max(2 GiB, a tenth), but not above max(1 GiB, a sixth), stays
    with the system; a worker needs three chunks and at least 1 GiB.
    """
    gib, chunk = 1 << 30, math.prod(chunks) * itemsize
    usable = max(gib, memory - min(max(2 * gib, memory // 10), max(gib, memory // 6)))
    threads, need = (2 if cpus >= 32 and chunk < (16 << 20) else 1), max(gib, 3 * chunk)
    workers = min(max(1, cpus // threads), max(1, usable // need), most)
    if shape is not None:
        workers = min(workers, math.prod(max(1, -(-n // c)) for n, c in zip(shape, chunks, strict=True)))
    workers = max(1, workers)
    if workers == 1:
        threads = max(1, min(cpus, 2 if chunk >= (512 << 20) else 6))
    if workers * threads > cpus:
        threads = max(1, cpus // workers)
    return {"workers": workers, "threads": threads, "memory": max(need, usable // workers)}


def position_count(shapes: list[tuple | None], pyramid_shapes: list[tuple], fallback: int) -> int:
    """Positions of a store: of the first component that has six axes, else of
    the first level listed, else ``fallback``."""
    for shape in [*shapes, *pyramid_shapes[:1]]:
        if shape is not None and len(shape) == 6:
            return max(1, int(shape[1]))
    return max(1, int(fallback))
