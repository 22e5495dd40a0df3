"""Operators on chunk rows: numpy inside the chunk, then a merge of small parts.

The voxel forms of the same operators serve relational queries and tests; these
are for volumes of which no one wants a row for each voxel.  Tasks merge their
own parts before the shuffle and hand them on when HELD of them are waiting.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.sources.voxels import CHUNK_FIELDS, blocks_in, chunk_batch

HELD = 64
PLACE = ["t", "p", "c", "z0", "y0", "x0"]


def map_blocks(chunks: DataFrame, fn: Callable) -> DataFrame:
    """Chunk rows of ``fn(row, block)``, which gives (row, block) or None."""

    def run(batches):
        for batch in batches:
            made = [m for m in (fn(row, block) for row, block in blocks_in(batch)) if m is not None]
            if made:
                yield chunk_batch([m[0] for m in made], [m[1] for m in made])

    return chunks.mapInArrow(run, CHUNK_FIELDS)


def _merged(chunks: DataFrame, pieces: Callable, join: Callable, finish: Callable | None = None) -> DataFrame:
    """Chunk rows of the pieces (row, block) of all chunks, joined where they lie alike."""

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def out():
            keys = list(held)
            made = chunk_batch([dict(zip(PLACE, k[:6], strict=True)) for k in keys], [held[k] for k in keys])
            held.clear()
            return made

        for batch in batches:
            for row, block in blocks_in(batch):
                for place, piece in pieces(row, block):
                    key = tuple(int(place[k]) for k in PLACE)
                    held[key] = join(held[key], piece) if key in held else piece
                    if len(held) >= HELD:
                        yield out()
        if held:
            yield out()

    def merge(group: pa.Table) -> pa.Table:
        total, place = None, None
        for batch in group.to_batches():
            for row, block in blocks_in(batch):
                place = place or row
                total = block if total is None else join(total, block)
        return pa.Table.from_batches([chunk_batch([place], [finish(total) if finish else total])])

    return chunks.mapInArrow(run, CHUNK_FIELDS).groupBy(*PLACE).applyInArrow(merge, CHUNK_FIELDS)


def max_planes(chunks: DataFrame, axis: str) -> DataFrame:
    """Maximum over ``axis``: chunk rows of length 1 along it."""
    at = "zyx".index(axis)

    def pieces(row, block):
        yield row | {f"{axis}0": 0}, block.max(axis=at, keepdims=True)

    return _merged(chunks, pieces, np.maximum)


def stride(chunks: DataFrame, step: dict[str, int]) -> DataFrame:
    """Every ``step``-th voxel of the whole array along z, y and x."""

    def one(row, block):
        skip = [(-row[f"{a}0"]) % step.get(a, 1) for a in "zyx"]
        kept = block[tuple(slice(s, None, step.get(a, 1)) for s, a in zip(skip, "zyx", strict=True))]
        if not kept.size:
            return None
        return row | {f"{a}0": (row[f"{a}0"] + s) // step.get(a, 1) for s, a in zip(skip, "zyx", strict=True)}, kept

    return map_blocks(chunks, one)


def histogram(chunks: DataFrame, low: float, high: float, bins: int, keys: tuple[str, ...] = ("t", "p", "c")) -> DataFrame:
    """(keys, bin, n): counts of equal bins over low..high, the last one closed."""
    names = list(keys)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row, block in blocks_in(batch):
                key = tuple(row[k] for k in names)
                counts = np.histogram(block, bins, (low, high))[0]
                held[key] = held[key] + counts if key in held else counts
        for key, counts in held.items():
            at = np.flatnonzero(counts)
            columns = [pa.array(np.full(len(at), k, np.int32)) for k in key]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=[*names, "bin", "n"])

    parts = chunks.mapInArrow(run, ", ".join(f"{k} int" for k in names) + ", bin int, n long")
    return parts.groupBy(*names, "bin").agg(F.sum("n").alias("n"))


def correct(chunks: DataFrame, profiles: DataFrame, floor: float = 1e-6) -> DataFrame:
    """(v - dark) / max(flat, floor) as float32.

    ``profiles`` (p, c, y0, x0, flat, dark: float64 payloads) hold one row for
    each column of chunks; both lie on the same y, x grid.
    """
    joined = chunks.join(profiles, ["p", "c", "y0", "x0"])
    names = [f.split()[0] for f in CHUNK_FIELDS.split(", ")]

    def run(batches):
        for batch in batches:
            rows, blocks = [], []
            for i, (row, block) in enumerate(blocks_in(batch)):
                flat, dark = (np.frombuffer(batch.column(k)[i].as_buffer(), np.float64).reshape(block.shape[1:]) for k in ("flat", "dark"))
                rows.append(row)
                blocks.append(((block - dark) / np.maximum(flat, floor)).astype(np.float32))
            if rows:
                yield chunk_batch(rows, blocks)

    return joined.select(*names, "flat", "dark").mapInArrow(run, CHUNK_FIELDS)


def fuse(
    chunks: DataFrame, offsets: dict[int, tuple[int, int, int]], tile_zyx: tuple[int, int, int], out_chunk: tuple[int, int, int],
    profiles: tuple[np.ndarray, np.ndarray, np.ndarray], limits: tuple[int, int] = (0, 65535), floor: float = 1e-6,
) -> DataFrame:
    """Weighted mean of tiles that are moved by whole voxels, as chunks of p = 0.

    ``offsets`` is one entry for each tile, ``profiles`` are the weights along
    z, y and x of a tile.  Each chunk goes to the output chunks that it
    touches; without weight a voxel is 0.
    """

    def pieces(row, block):
        at = [row[f"{a}0"] for a in "zyx"]
        weight = np.ones(block.shape)
        for i, (w, a) in enumerate(zip(profiles, at, strict=True)):
            weight = weight * np.asarray(w)[a : a + block.shape[i]].reshape([-1 if k == i else 1 for k in range(3)])
        low = [a + o for a, o in zip(at, offsets[row["p"]], strict=True)]
        ranges = [range(a // n, -(-(a + s) // n)) for a, s, n in zip(low, block.shape, out_chunk, strict=True)]
        for key in ((z, y, x) for z in ranges[0] for y in ranges[1] for x in ranges[2]):
            first = [k * n for k, n in zip(key, out_chunk, strict=True)]
            src = tuple(slice(max(0, f - a), min(s, f + n - a)) for f, a, s, n in zip(first, low, block.shape, out_chunk, strict=True))
            dst = tuple(slice(s.start + a - f, s.stop + a - f) for s, a, f in zip(src, low, first, strict=True))
            both = np.zeros((2 * out_chunk[0], *out_chunk[1:]))  # sums above, weights below
            both[: out_chunk[0]][dst], both[out_chunk[0] :][dst] = block[src] * weight[src], weight[src]
            yield row | {"p": 0} | {f"{a}0": f for a, f in zip("zyx", first, strict=True)}, both

    size = tuple(max(o[i] for o in offsets.values()) + tile_zyx[i] for i in range(3))

    def finish(both):
        sums, weight = both[: out_chunk[0]], both[out_chunk[0] :]
        mean = np.where(weight > 0, sums / np.maximum(weight, floor), 0.0)
        return np.clip(np.rint(mean), *limits).astype(np.uint16)

    def crop(row, block):
        inside = tuple(slice(0, min(n, s - row[f"{a}0"])) for n, s, a in zip(block.shape, size, "zyx", strict=True))
        return row, block[inside]

    return map_blocks(_merged(chunks, pieces, np.add, finish), crop)

