"""Image sources read through Spark: NumPy, TIFF, Zarr and N5 as chunk rows.

Files are listed and read by Spark's ``binaryFile`` source, so any file system
Spark knows will do; one file becomes the chunk rows of one task.  Formats
that need a library which is absent raise :class:`UnavailableFormat`.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.sources.voxels import AXES, CHUNK_FIELDS


class UnavailableFormat(RuntimeError):
    """Reading the format needs a library that is not installed."""


#: Axis names by rank where a source names none.
DEFAULT_AXES = {2: "yx", 3: "zyx", 4: "tzyx", 5: "tczyx", 6: "tpczyx"}
#: TIFF field sizes and sample formats.
TIFF_FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 12: "d", 16: "Q"}
TIFF_SAMPLE = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def infer_axes(shape: tuple[int, ...], z_count: int | None = None, c_count: int | None = None) -> str:
    """Axes by rank; of four, z and c are told apart by their known sizes."""
    if len(shape) == 4:
        if shape[0] == c_count and shape[1] == z_count:
            return "czyx"
        if shape[0] == z_count and shape[1] == c_count:
            return "zcyx"
    if len(shape) not in DEFAULT_AXES:
        raise ValueError(f"arrays of rank {len(shape)} are not images")
    return DEFAULT_AXES[len(shape)]


def to_six(array: np.ndarray, axes: str) -> np.ndarray:
    """The array with axes t, p, c, z, y, x; absent ones have length 1."""
    present = [a for a in AXES if a in axes]
    moved = array.transpose([axes.index(a) for a in present])
    return moved.reshape([array.shape[axes.index(a)] if a in axes else 1 for a in AXES])


def chunk_rows(array: np.ndarray, axes: str, origin: dict | None = None, chunk_z: int = 64) -> pd.DataFrame:
    """Chunk rows of one array; ``origin`` shifts its indices."""
    six, at = to_six(array, axes), origin or {}
    rows = []
    for t, p, c in np.ndindex(six.shape[:3]):
        for z in range(0, six.shape[3], chunk_z):
            block = np.ascontiguousarray(six[t, p, c, z : z + chunk_z])
            rows.append(
                {
                    "t": t + at.get("t", 0), "p": p + at.get("p", 0), "c": c + at.get("c", 0), "z0": z + at.get("z", 0),
                    "y0": at.get("y", 0), "x0": at.get("x", 0), "nz": block.shape[0], "ny": block.shape[1], "nx": block.shape[2],
                    "dtype": block.dtype.name, "payload": block.tobytes(),
                }
            )
    return pd.DataFrame(rows)


def decode_npy(content: bytes) -> np.ndarray:
    return np.load(io.BytesIO(content), allow_pickle=False)


def decode_npz(content: bytes) -> np.ndarray:
    """The array of the first key in sorted order."""
    with np.load(io.BytesIO(content), allow_pickle=False) as files:
        return files[sorted(files.files)[0]]


def unpack_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, the most significant bit first, as TIFF has it."""
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            bits -= width
            code, held = held >> bits, held & ((1 << bits) - 1)
            if code == 256:  # clear
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            if code == 257:  # end
                return bytes(out)
            if not table:
                raise ValueError("LZW data does not begin with a clear code")
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last is not None:
                table.append(last + entry[:1])
            last = entry
            # the writer widens its codes one entry early
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def _unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


#: TIFF compression schemes.
TIFF_UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_bits}


def _tiff_part(raw: bytes, dtype: np.dtype, height: int, width: int, samples: int, predictor: int) -> np.ndarray:
    """Rows of one strip or tile as (rows, width, samples)."""
    rows = np.frombuffer(raw, dtype)
    rows = rows[: len(rows) // (width * samples) * width * samples].reshape(-1, width, samples)[:height]
    rows = rows.astype(dtype.newbyteorder("="))
    if predictor == 2:
        rows = np.cumsum(rows, axis=1, dtype=rows.dtype)
    elif predictor != 1:
        raise UnavailableFormat(f"TIFF predictor {predictor}")
    return rows


def ome_axes(description: bytes | str | None) -> tuple[str, tuple[int, ...]] | None:
    """(axes, shape) that an OME-XML image description gives its pages, slowest first."""
    text = description.decode("utf-8", "replace").rstrip("\0") if isinstance(description, bytes) else description or ""
    found = re.search(r"<(?:\w+:)?Pixels\b([^>]*)>", text)
    if not found:
        return None
    values = dict(re.findall(r'(\w+)="([^"]*)"', found.group(1)))
    order = values.get("DimensionOrder", "XYCZT")[:1:-1].lower()
    try:
        return order + "yx", tuple(int(values[f"Size{a.upper()}"]) for a in order + "yx")
    except KeyError:
        return None


def decode_tiff_image(content: bytes) -> tuple[np.ndarray, str | None]:
    """(array, axes): pages in the shape of their OME description, if there is
    one, else (pages, y, x) with axes unknown."""
    pages, description = _tiff_pages(content)
    named = ome_axes(description)
    stack = np.stack(pages)
    if named and int(np.prod(named[1])) == stack.size:
        return stack.reshape(named[1]), named[0]
    return stack, None


def decode_tiff(content: bytes) -> np.ndarray:
    """Pages of a TIFF as (pages, y, x)."""
    return np.stack(_tiff_pages(content)[0])


def _tiff_pages(content: bytes) -> tuple[list[np.ndarray], bytes | None]:
    """Pages in strips or tiles, plain or packed, and the first description."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    magic = struct.unpack_from(order + "H", content, 2)[0]
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), content, 8 if big else 4)[0]
    pages, description = [], None
    while at:
        count = struct.unpack_from(order + ("Q" if big else "H"), content, at)[0]
        step, start = (20, at + 8) if big else (12, at + 2)
        tags = {}
        for i in range(count):
            entry = start + i * step
            tag, kind = struct.unpack_from(order + "HH", content, entry)
            n = struct.unpack_from(order + ("Q" if big else "I"), content, entry + 4)[0]
            code = TIFF_FIELD.get(kind, "B")
            size = struct.calcsize("<" + code) * n
            value = entry + (12 if big else 8)
            if size > (8 if big else 4):
                value = struct.unpack_from(order + ("Q" if big else "I"), content, value)[0]
            tags[tag] = content[value : value + n] if kind == 2 else struct.unpack_from(order + code * n, content, value)
        width, height, packing = tags[256][0], tags[257][0], tags.get(259, (1,))[0]
        if packing not in TIFF_UNPACK:
            raise UnavailableFormat(f"TIFF compression {packing}")
        if tags.get(277, (1,))[0] != 1:
            raise UnavailableFormat("TIFF pages of several samples")
        description = description or tags.get(270)
        dtype = np.dtype(TIFF_SAMPLE[(tags.get(339, (1,))[0], tags[258][0])]).newbyteorder(order)
        predictor, tiled = tags.get(317, (1,))[0], 322 in tags
        part_w, part_h = (tags[322][0], tags[323][0]) if tiled else (width, min(height, tags.get(278, (height,))[0]))
        page, across = np.zeros((height, width), dtype.newbyteorder("=")), -(-width // part_w)
        for i, (o, n) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
            y, x = i // across * part_h, i % across * part_w
            part = _tiff_part(TIFF_UNPACK[packing](content[o : o + n]), dtype, part_h, part_w, 1, predictor)[..., 0]
            page[y : y + part_h, x : x + part_w] = part[: height - y, : width - x]
        pages.append(page)
        at = struct.unpack_from(order + ("Q" if big else "I"), content, start + count * step)[0]
    return pages, description


def encode_tiff(planes: np.ndarray) -> bytes:
    """Little-endian strip TIFF, one page per plane."""
    codes = {v: k for k, v in TIFF_SAMPLE.items()}
    kind, bits = codes[planes.dtype.str[1:]]
    out, at = [], 8
    for plane in planes:
        raw = np.ascontiguousarray(plane.astype(plane.dtype.newbyteorder("<"))).tobytes()
        tags = [(256, 4, plane.shape[1]), (257, 4, plane.shape[0]), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 4, at),
                (277, 3, 1), (278, 4, plane.shape[0]), (279, 4, len(raw)), (339, 3, kind)]
        ifd = at + len(raw) + len(raw) % 2
        after = ifd + 2 + 12 * len(tags) + 4
        body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
        out.append((ifd, raw + b"\0" * (len(raw) % 2) + body + struct.pack("<I", 0)))
        at = after
    stream = bytearray(struct.pack("<2sHI", b"II", 42, out[0][0]))
    for i, (_, page) in enumerate(out):
        page = page[:-4] + struct.pack("<I", out[i + 1][0] if i + 1 < len(out) else 0)
        stream += page
    return bytes(stream)


def decode_block(content: bytes, codec: str | None) -> bytes:
    """Bytes of a stored chunk."""
    if codec in (None, "raw", "null"):
        return content
    if codec == "gzip":
        return gzip.decompress(content)
    if codec == "zlib":
        return zlib.decompress(content)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(content)
    raise UnavailableFormat(f"codec {codec}")


DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {
    ".tif": decode_tiff, ".tiff": decode_tiff, ".npy": decode_npy, ".npz": decode_npz,
}


def _read_text(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(found) or fs.getFileStatus(found).isDirectory():
        return None
    stream = fs.open(found)  # Spark's readers skip files whose names begin with a dot
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def read_files(spark: SparkSession, path: str, suffix: str, axes: str | None = None, index_names: bool = False) -> DataFrame:
    """Chunk rows of the files of one suffix below ``path``.

    With ``index_names`` t, p and c come from the file names.
    """
    decode = DECODERS[suffix]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    from voxelloom.functions import tiff_indices

    marks = tiff_indices(F.col("path"))
    named = files.select("content", *[(m if index_names else F.lit(0)).alias(a) for a, m in marks.items()])

    def run(parts):
        for pdf in parts:
            for content, *at in zip(pdf["content"], *[pdf[a] for a in "tpc"], strict=True):
                named = None
                if suffix.startswith(".tif"):
                    array, named = decode_tiff_image(content)
                    if named is None and array.shape[0] == 1:
                        array = array[0]
                else:
                    array = decode(content)
                yield chunk_rows(array, axes or named or infer_axes(array.shape), {a: int(i) for a, i in zip("tpc", at, strict=True)})

    return named.mapInPandas(run, CHUNK_FIELDS)


def zarr_metadata(spark: SparkSession, path: str) -> dict:
    """shape, chunks, dtype, codec, separator and axes of a Zarr array."""
    text = _read_text(spark, f"{path}/.zarray")
    if text:
        meta = json.loads(text)
        attrs = json.loads(_read_text(spark, f"{path}/.zattrs") or "{}")
        codec = (meta.get("compressor") or {}).get("id")
        if meta.get("filters"):
            raise UnavailableFormat(f"filters {meta['filters']}")
        return {"shape": meta["shape"], "chunks": meta["chunks"], "dtype": meta["dtype"], "codec": codec, "prefix": "", "order": meta.get("order", "C"),
                "separator": meta.get("dimension_separator", "."), "axes": attrs.get("axes") or attrs.get("_ARRAY_DIMENSIONS"), "fill": meta.get("fill_value")}
    text = _read_text(spark, f"{path}/zarr.json")
    if not text:
        raise FileNotFoundError(path)
    meta = json.loads(text)
    codecs = [c["name"] for c in meta["codecs"] if c["name"] != "bytes"]
    if len(codecs) > 1:
        raise UnavailableFormat(f"codecs {codecs}")
    grid = meta["chunk_grid"]["configuration"]["chunk_shape"]
    separator = meta["chunk_key_encoding"].get("configuration", {}).get("separator", "/")
    endian = next((c.get("configuration", {}).get("endian", "little") for c in meta["codecs"] if c["name"] == "bytes"), "little")
    dtype = np.dtype(meta["data_type"]).newbyteorder("<" if endian == "little" else ">")
    return {"shape": meta["shape"], "chunks": grid, "dtype": dtype.str, "codec": codecs[0] if codecs else None, "order": "C",
            "prefix": "c" + separator, "separator": separator, "axes": meta.get("dimension_names"), "fill": meta.get("fill_value")}


def _with_unstored(files: DataFrame, pattern: str, counts: list[int], stored: Callable, unstored: Callable) -> DataFrame:
    """Chunk rows of all chunks of a grid: of the files, and of the chunks no file holds.

    Only the names are compared; the chunks' bytes are read where they are
    decoded and never shuffled.
    """
    spark, total = files.sparkSession, int(np.prod(counts))
    place = F.lit(0).cast("long")
    for i, n in enumerate(counts):
        place = place * n + F.regexp_extract("path", pattern, i + 1).cast("long")
    named = files.select(place.alias("place"))
    missing = spark.range(total).withColumnRenamed("id", "place").join(named, "place", "left_anti")

    def fill(parts):
        for pdf in parts:
            for i in pdf["place"]:
                yield unstored([int(k) for k in np.unravel_index(int(i), counts)])

    rows = files.select("path", "content").mapInPandas(stored, CHUNK_FIELDS)
    return rows.unionByName(missing.mapInPandas(fill, CHUNK_FIELDS))


def _fill_value(value, dtype: np.dtype):
    """A fill value as metadata write it: null, a number, or NaN and infinities as text."""
    if value is None:
        return dtype.type(0)
    return dtype.type(float(value)) if isinstance(value, str) and dtype.kind == "f" else dtype.type(value)


def read_zarr(spark: SparkSession, path: str, axes: str | None = None) -> DataFrame:
    """Chunk rows of a Zarr v2 or v3 array; chunks that are not stored hold the fill value."""
    meta = zarr_metadata(spark, path)
    names = axes or ("".join(meta["axes"]) if meta["axes"] else infer_axes(tuple(meta["shape"])))
    rank, sep = len(meta["shape"]), re.escape(meta["separator"])
    pattern = "/" + re.escape(meta["prefix"]) + sep.join([r"(\d+)"] * rank) + "$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(pattern))
    dtype = np.dtype(meta["dtype"])
    native, fill = dtype.newbyteorder("="), _fill_value(meta["fill"], dtype.newbyteorder("="))

    def placed(key: list[int], block: np.ndarray) -> pd.DataFrame:
        start = [k * c for k, c in zip(key, meta["chunks"], strict=True)]
        inside = tuple(slice(0, min(c, s - a)) for c, s, a in zip(meta["chunks"], meta["shape"], start, strict=True))
        return chunk_rows(block[inside].astype(native, copy=False), names, dict(zip(names, start, strict=True)))

    def run(parts):
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                block = np.frombuffer(decode_block(content, meta["codec"]), dtype).reshape(meta["chunks"], order=meta["order"])
                yield placed([int(i) for i in re.search(pattern, name).groups()], block)

    counts = [-(-s // c) for s, c in zip(meta["shape"], meta["chunks"], strict=True)]
    return _with_unstored(files, pattern, counts, run, lambda key: placed(key, np.full(meta["chunks"], fill, native)))


def read_n5(spark: SparkSession, path: str, axes: str = "zyx") -> DataFrame:
    """Chunk rows of an N5 dataset; blocks store x first and big-endian.

    Blocks whose trailing axes of length 1 were left out are completed; blocks
    that are not stored hold 0.
    """
    meta = json.loads(_read_text(spark, f"{path}/attributes.json") or "null")
    if not meta or "dimensions" not in meta:
        raise FileNotFoundError(path)
    kind = meta.get("compression", {}).get("type", "raw") if isinstance(meta.get("compression"), dict) else meta.get("compressionType", "raw")
    shape, sizes = meta["dimensions"], meta["blockSize"]
    pattern = "/" + "/".join([r"(\d+)"] * len(shape)) + "$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(pattern))

    def run(parts):
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                key = [int(i) for i in re.search(pattern, name).groups()]
                mode, rank = struct.unpack_from(">HH", content)
                dims = list(struct.unpack_from(f">{rank}I", content, 4))
                head = 4 + 4 * rank + (4 if mode == 1 else 0)
                dims += [1] * (len(shape) - rank)
                raw = decode_block(content[head:], kind)
                block = np.frombuffer(raw, np.dtype(meta["dataType"]).newbyteorder(">")).reshape(dims[::-1])
                start = [k * c for k, c in zip(key, sizes, strict=True)][::-1]
                native = block.astype(block.dtype.newbyteorder("="))
                yield chunk_rows(native, axes, dict(zip(axes, start, strict=True)))

    def empty(key: list[int]) -> pd.DataFrame:
        start = [k * c for k, c in zip(key, sizes, strict=True)]
        block = np.zeros([min(c, s - a) for c, s, a in zip(sizes, shape, start, strict=True)][::-1], meta["dataType"])
        return chunk_rows(block, axes, dict(zip(axes, start[::-1], strict=True)))

    counts = [-(-s // c) for s, c in zip(shape, sizes, strict=True)]
    return _with_unstored(files, pattern, counts, run, empty)


def n5_datasets(spark: SparkSession, root: str) -> list[dict]:
    """Setup, timepoint and attributes of every setupN/timepointM/s0 that has attributes."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root}/setup*/timepoint*/s0/attributes.json")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    out = []
    for status in found:  # one small file for each dataset
        name = status.getPath().toString()
        setup, t = re.search(r"/setup(\d+)/timepoint(\d+)/", name).groups()
        out.append({"setup": int(setup), "timepoint": int(t), **json.loads(_read_text(spark, name))})
    return sorted(out, key=lambda d: (d["setup"], d["timepoint"]))


def n5_summary(datasets: list[dict], setups: dict[int, tuple[int, int]]) -> dict[str, int]:
    """Canonical shape of a collection; volumes that differ in size or type are refused."""
    known = [d for d in datasets if d["setup"] in setups]
    if not known:
        raise ValueError("no dataset belongs to a known setup")
    kinds = {(tuple(d["dimensions"]), d["dataType"]) for d in known}
    if len(kinds) != 1:
        raise ValueError(f"datasets differ: {sorted(kinds)}")
    x, y, z = (list(next(iter(kinds))[0]) + [1, 1])[:3]
    places = {setups[d["setup"]] for d in known}
    times = {d["timepoint"] for d in known}
    if len({(d["setup"], d["timepoint"]) for d in known}) != len(places) * len(times):
        raise ValueError("some setups lack some time points")
    return {"t": len(times), "p": len({p for p, _ in places}), "c": len({c for _, c in places}), "z": z, "y": y, "x": x}


def read_n5_collection(spark: SparkSession, root: str, setups: dict[int, tuple[int, int]]) -> DataFrame:
    """Chunk rows of setupN/timepointM/s0 datasets; setups give (p, c), ranks of time points t.

    One scan reads the blocks of all datasets; blocks that are not stored hold 0.
    """
    datasets = n5_datasets(spark, root)
    n5_summary(datasets, setups)
    known = {(d["setup"], d["timepoint"]): d for d in datasets if d["setup"] in setups}
    rank = {t: i for i, t in enumerate(sorted({t for _, t in known}))}
    one = next(iter(known.values()))
    shape, sizes = (list(one["dimensions"]) + [1, 1])[:3], (list(one["blockSize"]) + [1, 1])[:3]
    depth = len(one["dimensions"])
    compression = one.get("compression")
    kind = compression.get("type", "raw") if isinstance(compression, dict) else one.get("compressionType", "raw")
    dtype = np.dtype(one["dataType"])
    pattern = r"/setup(\d+)/timepoint(\d+)/s0/" + "/".join([r"(\d+)"] * depth) + "$"

    def placed(setup: int, t: int, key: list[int], block: np.ndarray) -> pd.DataFrame:
        start = [k * n for k, n in zip(key + [0] * (3 - depth), sizes, strict=True)]
        p, c = setups[setup]
        return chunk_rows(block, "zyx", {"t": rank[t], "p": p, "c": c, "x": start[0], "y": start[1], "z": start[2]})

    def stored(parts):
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                setup, t, *key = map(int, re.search(pattern, name).groups())
                if (setup, t) not in known:
                    continue
                mode, n = struct.unpack_from(">HH", content)
                dims = (list(struct.unpack_from(f">{n}I", content, 4)) + [1, 1])[:3]
                raw = decode_block(content[4 + 4 * n + (4 if mode == 1 else 0) :], kind)
                yield placed(setup, t, key, np.frombuffer(raw, dtype.newbyteorder(">")).reshape(dims[::-1]).astype(dtype))

    def empty(parts):
        for pdf in parts:
            for setup, t, place in zip(pdf["setup"], pdf["timepoint"], pdf["place"], strict=True):
                key = [int(k) for k in np.unravel_index(int(place), counts)]
                dims = [min(n, s - k * n) for n, s, k in zip(sizes, shape, key + [0] * (3 - depth), strict=True)]
                yield placed(int(setup), int(t), key, np.zeros(dims[::-1], dtype))

    counts = [-(-s // n) for s, n in zip(shape[:depth], sizes[:depth], strict=True)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").rlike(pattern))
    part = lambda i: F.regexp_extract("path", pattern, i).cast("long")
    place = F.lit(0).cast("long")
    for i, n in enumerate(counts):
        place = place * n + part(i + 3)
    have = files.select(part(1).alias("setup"), part(2).alias("timepoint"), place.alias("place"))
    wanted = spark.createDataFrame([(s, t) for s, t in known], "setup long, timepoint long")
    wanted = wanted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(np.prod(counts)) - 1).cast("long"))).alias("place"))
    missing = wanted.join(have, ["setup", "timepoint", "place"], "left_anti")
    return files.select("path", "content").mapInPandas(stored, CHUNK_FIELDS).unionByName(missing.mapInPandas(empty, CHUNK_FIELDS))


def array_paths(spark: SparkSession, root: str) -> list[tuple[str, tuple]]:
    """(path, shape) of every Zarr array below a group, by path."""
    jvm = spark.sparkContext._jvm
    out, todo = [], [jvm.org.apache.hadoop.fs.Path(root)]
    system = todo[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while todo:
        folder = todo.pop()
        path = folder.toString()
        try:
            out.append((path, tuple(zarr_metadata(spark, path)["shape"])))
        except (FileNotFoundError, KeyError):
            todo += [s.getPath() for s in system.listStatus(folder) if s.isDirectory()]
    return sorted(out)


def open_zarr_group(spark: SparkSession, root: str) -> DataFrame:
    """An OME image or plate, or else the largest array below the group (ties by path)."""
    if multiscale_levels(spark, root) or collection_images(spark, root) != [root]:
        return read_ome_zarr(spark, root)
    found = [(p, s) for p, s in array_paths(spark, root) if len(s) in DEFAULT_AXES]
    if not found:
        raise ValueError(f"no image array below {root}")
    return read_zarr(spark, max(found, key=lambda f: int(np.prod(f[1])))[0])


def probe(spark: SparkSession, path: str) -> dict:
    """Shape, type and axes of a source without its pixels."""
    low = path.lower()
    if low.endswith((".tif", ".tiff", ".npy", ".npz")):
        row = spark.read.format("binaryFile").load(path).select("content").first()
        suffix = next(s for s in DECODERS if low.endswith(s))
        array, named = decode_tiff_image(bytes(row["content"])) if suffix.startswith(".tif") else (DECODERS[suffix](bytes(row["content"])), None)
        return {"shape": tuple(array.shape), "dtype": array.dtype.name, "axes": named or infer_axes(array.shape)}
    levels = multiscale_levels(spark, path)
    meta = zarr_metadata(spark, levels[0]["path"] if levels else path)
    named = (levels[0]["axes"] if levels else None) or ("".join(meta["axes"]) if meta["axes"] else infer_axes(tuple(meta["shape"])))
    return {"shape": tuple(meta["shape"]), "dtype": np.dtype(meta["dtype"]).name, "axes": named}


def multiscale_levels(spark: SparkSession, path: str) -> list[dict]:
    """path, axes and scale of every level that a group's OME metadata name."""
    attrs = json.loads(_read_text(spark, f"{path}/.zattrs") or "{}")
    if not attrs:
        attrs = json.loads(_read_text(spark, f"{path}/zarr.json") or "{}").get("attributes", {})
    attrs = attrs.get("ome", attrs)
    out = []
    for image in attrs.get("multiscales", []):
        names = "".join(a["name"] if isinstance(a, dict) else a for a in image.get("axes", []))
        for level in image.get("datasets", []):
            scale = next((t["scale"] for t in level.get("coordinateTransformations", []) if t.get("type") == "scale"), None)
            out.append({"path": f"{path}/{level['path']}", "axes": names or None, "scale": scale})
    return out


def collection_images(spark: SparkSession, path: str) -> list[str]:
    """Image groups of a plate (row / column / field, in their order), or the group itself."""
    attrs = json.loads(_read_text(spark, f"{path}/.zattrs") or "{}")
    if not attrs:
        attrs = json.loads(_read_text(spark, f"{path}/zarr.json") or "{}").get("attributes", {})
    attrs = attrs.get("ome", attrs)
    if "plate" not in attrs:
        return [path]
    out = []
    for well in attrs["plate"].get("wells", []):
        inner = json.loads(_read_text(spark, f"{path}/{well['path']}/.zattrs") or "{}")
        if not inner:
            inner = json.loads(_read_text(spark, f"{path}/{well['path']}/zarr.json") or "{}").get("attributes", {})
        out += [f"{path}/{well['path']}/{f['path']}" for f in inner.get("ome", inner).get("well", {}).get("images", [])]
    return out


def read_ome_zarr(spark: SparkSession, path: str, level: int = 0) -> DataFrame:
    """Chunk rows of a level of an OME-Zarr image or plate; fields of a plate become positions."""
    images = collection_images(spark, path)
    parts = []
    for p, image in enumerate(images):
        levels = multiscale_levels(spark, image)
        if not levels:
            raise ValueError(f"no multiscales in {image}")
        chosen = levels[min(level, len(levels) - 1)]
        rows = read_zarr(spark, chosen["path"], chosen["axes"])
        parts.append(rows.withColumn("p", F.lit(p)) if len(images) > 1 else rows)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def open_image(spark: SparkSession, path: str, axes: str | None = None) -> DataFrame:
    """Chunk rows of any known source, told by its suffix or its metadata."""
    low = path.lower().rstrip("/")
    for suffix in DECODERS:
        if low.endswith(suffix):
            return read_files(spark, path, suffix, axes)
    if low.endswith((".h5", ".hdf5")):
        raise UnavailableFormat("HDF5 needs h5py, which is not installed")
    # every reader in turn; one that does not know the source leaves it to the next
    tried = []
    for reader in (read_zarr, lambda s, p, a: open_zarr_group(s, p), read_n5):
        try:
            return reader(spark, path, axes) if reader is not read_n5 else read_n5(spark, path, axes or "zyx")
        except (FileNotFoundError, KeyError, ValueError) as e:
            tried.append(str(e))
    if low.endswith(".n5"):
        raise ValueError("name a dataset inside the N5 container")
    raise ValueError(f"no reader for {path}: {'; '.join(tried)}")
