"""Files out of Spark: tables of (path, content), Zarr arrays, plates, TIFF.

Tasks write whole files through Arrow's file systems, each under a name of its
own that is moved into place, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelloom.sources.formats import encode_tiff
from voxelloom.sources.voxels import blocks_in

#: Detections in one chunk of rows at most.
DETECTION_CHUNK = 16384
DETECTION_COLUMNS = ["t", "p", "c", "z", "y", "x", "sigma", "intensity"]


def put(path: str, content: bytes) -> None:
    """Write one file, made anew beside its place and then moved there."""
    system, place = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    draft = f"{place}.{np.random.default_rng().integers(1 << 62):x}.part"
    with system.open_output_stream(draft) as out:
        out.write(content)
    system.move(draft, place)


def write_files(files: DataFrame) -> DataFrame:
    """Writes (path, content) rows; gives (path, bytes) of each when run."""

    def run(batches):
        for batch in batches:
            paths, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for path, content in zip(paths, contents, strict=True):
                put(path, content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in contents], pa.int64())], names=["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long")


def zarr_files(chunks: DataFrame, root: str, chunk_zyx: tuple, dtype: str, axes: str = "tpczyx", position: int | None = None) -> DataFrame:
    """(path, content) of the Zarr chunks of chunk rows.

    Rows must lie on the grid of ``chunk_zyx``; the last ones are padded.
    With ``position`` the p axis is left out.
    """
    lead = [a for a in axes if a not in "zyx"]

    def run(batches):
        for batch in batches:
            paths, contents = [], []
            for row, block in blocks_in(batch):
                whole = np.zeros(chunk_zyx, dtype)
                values = block
                if np.dtype(dtype).kind in "iu":
                    info = np.iinfo(dtype)
                    values = np.clip(np.rint(block.astype(float)), info.min, info.max)
                whole[tuple(slice(0, n) for n in block.shape)] = values
                key = [row[a] for a in lead] + [row[f"{a}0"] // n for a, n in zip("zyx", chunk_zyx, strict=True)]
                paths.append(f"{root}/{'/'.join(map(str, key))}")
                contents.append(zlib.compress(whole.astype(np.dtype(dtype).newbyteorder("<")).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    rows = chunks if position is None else chunks.where(F.col("p") == position)
    return rows.mapInArrow(run, "path string, content binary")


def zarr_array(root: str, shape: tuple, chunks: tuple, dtype: str, axes: str, fill=0) -> None:
    """Metadata of an empty Zarr array whose chunks are in nested folders."""
    meta = {
        "zarr_format": 2, "shape": list(map(int, shape)), "chunks": list(map(int, chunks)), "dtype": np.dtype(dtype).newbyteorder("<").str,
        "compressor": {"id": "zlib", "level": 1}, "fill_value": fill, "order": "C", "filters": None, "dimension_separator": "/",
    }
    put(f"{root}/.zarray", json.dumps(meta).encode())
    put(f"{root}/.zattrs", json.dumps({"axes": list(axes), "_ARRAY_DIMENSIONS": list(axes)}).encode())


def multiscales(axes: str, levels: list[tuple[str, list[float]]], origin: list[float] | None = None) -> dict:
    """OME metadata of an image: path and scale of each level, and one translation."""
    kinds = {"t": "time", "c": "channel"}
    units = {"t": "second", "z": "micrometer", "y": "micrometer", "x": "micrometer"}
    named = [{"name": a, "type": kinds.get(a, "space")} | ({"unit": units[a]} if a in units else {}) for a in axes]
    sets = []
    for path, scale in levels:
        moves = [{"type": "scale", "scale": scale}] + ([{"type": "translation", "translation": origin}] if origin else [])
        sets.append({"path": path, "coordinateTransformations": moves})
    return {"multiscales": [{"version": "0.4", "axes": named, "datasets": sets}]}


def publish_plate(
    levels: list[DataFrame], root: str, shape: dict[str, int], chunk_zyx: tuple, voxel_zyx: tuple, factors: list[int],
    dtype: str = "uint16", origins: dict[int, tuple] | None = None,
) -> int:
    """An HCS plate of one well, A/1, with a field of (t, c, z, y, x) levels for each position.

    ``levels`` are chunk rows of every level, ``factors`` their strides,
    ``origins`` the world z, y, x of a position.  Gives the files written.
    """
    written = 0
    put(f"{root}/.zgroup", b'{"zarr_format": 2}')
    plate = {"rows": [{"name": "A"}], "columns": [{"name": "1"}], "wells": [{"path": "A/1", "rowIndex": 0, "columnIndex": 0}], "version": "0.4"}
    put(f"{root}/.zattrs", json.dumps({"plate": plate}).encode())
    put(f"{root}/A/1/.zgroup", b'{"zarr_format": 2}')
    put(f"{root}/A/1/.zattrs", json.dumps({"well": {"images": [{"path": str(p)} for p in range(shape["p"])], "version": "0.4"}}).encode())
    for p in range(shape["p"]):
        image = f"{root}/A/1/{p}"
        put(f"{image}/.zgroup", b'{"zarr_format": 2}')
        at = (origins or {}).get(p)
        scales = [(str(i), [1.0, 1.0, *[v * f for v in voxel_zyx]]) for i, f in enumerate(factors)]
        put(f"{image}/.zattrs", json.dumps(multiscales("tczyx", scales, [0.0, 0.0, *map(float, at)] if at else None)).encode())
        for i, f in enumerate(factors):
            size = [shape["t"], shape["c"], *[-(-shape[a] // f) for a in "zyx"]]
            zarr_array(f"{image}/{i}", size, (1, 1, *chunk_zyx), dtype, "tczyx")
    for i, rows in enumerate(levels):
        for p in range(shape["p"]):
            files = zarr_files(rows, f"{root}/A/1/{p}/{i}", chunk_zyx, dtype, "tczyx", p)
            written += write_files(files).count()
    return written


def projection_files(planes: DataFrame, root: str, shape_yx: tuple[int, int]) -> DataFrame:
    """(path, content): one uint16 TIFF for each (projection, p, t, c) of rows (..., y, x, v).

    A plane is one group of at most its own pixels.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        plane = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.uint16)
        plane[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = np.clip(np.rint(pdf["v"].to_numpy()), 0, 65535)
        name = f"mip_{first['projection']}_p{int(first['p']):04d}_t{int(first['t']):04d}_c{int(first['c']):04d}.tif"
        return pd.DataFrame([{"path": f"{root}/{name}", "content": encode_tiff(plane[None])}])

    return planes.groupBy("projection", "p", "t", "c").applyInPandas(run, "path string, content binary")


def tiff_to_zarr(chunks: DataFrame, root: str, chunk_zyx: tuple, dtype: str) -> int:
    """Writes chunk rows (as the TIFF readers give them, dealt anew) as one Zarr array."""
    size = chunks.agg(*[(F.max(a) + 1).alias(a) for a in "tpc"], *[F.max(F.col(f"{a}0") + F.col(f"n{a}")).alias(a) for a in "zyx"]).first()
    zarr_array(root, tuple(size[a] for a in "tpczyx"), (1, 1, 1, *chunk_zyx), dtype, "tpczyx")
    from voxelloom.sources.voxels import to_chunks, to_voxels

    return write_files(zarr_files(to_chunks(to_voxels(chunks), chunk_zyx, dtype), root, chunk_zyx, dtype)).count()


def detection_chunks(detections: DataFrame) -> DataFrame:
    """Detections in their order with row and chunk numbers, chunks of DETECTION_CHUNK rows.

    Numbers come from counts of (t, p) groups and places inside a group, so no
    task sorts all rows.
    """
    counts = detections.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("t", "p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each time and position
    starts = counts.select("t", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("t", "p").orderBy("z", "y", "x", "c", "sigma", "intensity")
    rows = detections.join(starts, ["t", "p"]).withColumn("row", F.col("start") + F.row_number().over(inside) - 1)
    return rows.select("row", F.floor(F.col("row") / DETECTION_CHUNK).cast("long").alias("chunk"), *DETECTION_COLUMNS)


def save_detections(detections: DataFrame, root: str, parameters: dict, run_id: str | None = None) -> int:
    """The float32 (n, 8) table and (n, 4) t, z, y, x points as Zarr arrays; gives n."""
    rows = detection_chunks(detections)
    n = rows.count()
    names = {"detections": DETECTION_COLUMNS, "points_tzyx": ["t", "z", "y", "x"]}
    for name, columns in names.items():
        zarr_array(f"{root}/{name}", (n, len(columns)), (min(max(n, 1), DETECTION_CHUNK), len(columns)), "float32", "rc")
    put(f"{root}/detections/.zattrs", json.dumps({"columns": DETECTION_COLUMNS, "parameters": parameters, "run_id": run_id}, sort_keys=True).encode())
    size = min(max(n, 1), DETECTION_CHUNK)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        at = group.column("chunk")[0].as_py()
        paths, contents = [], []
        for name, columns in names.items():
            block = np.zeros((size, len(columns)), "<f4")
            block[: group.num_rows] = np.column_stack([group.column(c).to_numpy() for c in columns])
            paths.append(f"{root}/{name}/{at}/0")
            contents.append(zlib.compress(block.tobytes(), 1))
        return pa.table({"path": paths, "content": pa.array(contents, pa.binary())})

    write_files(rows.groupBy("chunk").applyInArrow(run, "path string, content binary")).count()
    return n


def affine_mat(matrix: np.ndarray, centre=(0.0, 0.0, 0.0)) -> bytes:
    """An affine as a level 4 MATLAB file: twelve parameters and the fixed centre."""
    import struct

    out = b""
    for name, values in (("AffineTransform_double_3_3", np.concatenate([matrix[:3, :3].reshape(-1), matrix[:3, 3]])), ("fixed", np.asarray(centre, float))):
        text = name.encode() + b"\0"
        out += struct.pack("<5i", 0, len(values), 1, 0, len(text)) + text + np.asarray(values, "<f8").tobytes()
    return out


def read_affine_mat(content: bytes) -> dict[str, np.ndarray]:
    """Column vectors of a level 4 MATLAB file by name."""
    import struct

    out, at = {}, 0
    while at < len(content):
        kind, rows, columns, _, n = struct.unpack_from("<5i", content, at)
        if kind != 0:
            raise ValueError("only double matrices are read")
        name = content[at + 20 : at + 20 + n - 1].decode()
        out[name] = np.frombuffer(content, "<f8", rows * columns, at + 20 + n)
        at += 20 + n + 8 * rows * columns
    return out


def _system(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def reset_folder(spark: SparkSession, path: str) -> None:
    """An empty folder in place of whatever was there."""
    found, system = _system(spark, path)
    system.delete(found, True)
    system.mkdirs(found)


def _matching(spark: SparkSession, root: str, suffix: str, recursive: bool) -> list:
    found, system = _system(spark, root)
    out, todo = [], [found]
    while todo:
        for status in system.listStatus(todo.pop()):
            if status.isDirectory():
                todo += [status.getPath()] if recursive else []
            elif status.getPath().getName().lower().endswith(suffix.lower()):
                out.append(status.getPath())
    return sorted(out, key=lambda p: p.toString())


def rename_suffix(spark: SparkSession, root: str, old: str = ".tiff", new: str = ".tif", recursive: bool = True) -> int:
    """Renames files of one suffix; names that are taken stay.  Gives how many."""
    _, system = _system(spark, root)
    done = 0
    for path in _matching(spark, root, old, recursive):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.toString()[: -len(old)] + new)
        done += bool(not system.exists(target) and system.rename(path, target))
    return done


def delete_suffix(spark: SparkSession, root: str, suffix: str) -> int:
    """Removes the files of one suffix in a folder; gives how many."""
    _, system = _system(spark, root)
    return sum(bool(system.delete(p, False)) for p in _matching(spark, root, suffix if suffix.startswith(".") else f".{suffix}", False))


def moving_images(spark: SparkSession, root: str, index: int) -> list[str]:
    """``Round<index>_*.tif`` of a folder, or ``.tiff`` where there are none."""
    found, system = _system(spark, root)
    names = sorted(s.getPath().toString() for s in system.listStatus(found) if s.isFile() and s.getPath().getName().startswith(f"Round{index}_"))
    return [n for n in names if n.endswith(".tif")] or [n for n in names if n.endswith(".tiff")]
