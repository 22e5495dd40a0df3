import json

import numpy as np
import pytest

from voxelloom.sources import formats, stores
from voxelloom.sources.voxels import embedding_voxels, to_chunks, to_voxels


def _total(chunks):
    return sorted((r["z"], r["y"], r["x"], r["v"]) for r in to_voxels(chunks).collect())


def _truth(a):
    return sorted((z, y, x, float(a[z, y, x])) for z, y, x in np.ndindex(a.shape))


CUBE = np.arange(60, dtype=np.uint16).reshape(3, 4, 5)


def test_round_trip(spark, sf):
    v = embedding_voxels(spark, sf).where("t = 0 AND p = 0 AND c = 0")
    back = to_voxels(to_chunks(v, (4, 3, 5)))
    key = lambda rows: sorted((r["z"], r["y"], r["x"], float(r["v"])) for r in rows)
    assert key(back.collect()) == key(v.collect())


def test_numpy_and_tiff(spark, tmp_path):
    np.save(tmp_path / "a.npy", CUBE)
    np.savez(tmp_path / "b.npz", z=CUBE[:1], a=CUBE)
    (tmp_path / "c.tif").write_bytes(formats.encode_tiff(CUBE))
    for name in ("a.npy", "b.npz", "c.tif"):
        assert _total(formats.open_image(spark, f"file://{tmp_path}/{name}")) == _truth(CUBE)


@pytest.mark.parametrize("codec", [None, "zlib", "gzip"])
def test_zarr(spark, tmp_path, codec):
    import gzip
    import zlib

    root = tmp_path / f"z{codec}"
    root.mkdir()
    chunks = [2, 4, 3]
    meta = {"zarr_format": 2, "shape": CUBE.shape, "chunks": chunks, "dtype": "<u2", "compressor": codec and {"id": codec}, "fill_value": 0, "order": "C"}
    (root / ".zarray").write_text(json.dumps(meta))
    for i in range(2):
        for k in range(2):
            block = np.zeros(chunks, "<u2")
            part = CUBE[2 * i : 2 * i + 2, :, 3 * k : 3 * k + 3]
            block[: part.shape[0], :, : part.shape[2]] = part
            raw = block.tobytes()
            raw = zlib.compress(raw) if codec == "zlib" else gzip.compress(raw) if codec == "gzip" else raw
            (root / f"{i}.0.{k}").write_bytes(raw)
    assert _total(formats.open_image(spark, f"file://{root}")) == _truth(CUBE)


def test_n5_with_missing_trailing_axis(spark, tmp_path):
    import struct

    root = tmp_path / "n5"
    (root / "0" / "0").mkdir(parents=True)
    (root / "attributes.json").write_text(json.dumps({"dimensions": [5, 4, 1], "blockSize": [5, 4, 1], "dataType": "uint16", "compression": {"type": "raw"}}))
    plane = CUBE[0]
    (root / "0" / "0" / "0").write_bytes(struct.pack(">HH2I", 0, 2, 5, 4) + plane.astype(">u2").tobytes())
    assert _total(formats.open_image(spark, f"file://{root}")) == _truth(CUBE[:1])


def test_zarr_chunks_that_are_not_stored_hold_the_fill_value(spark, tmp_path):
    root = tmp_path / "z.zarr"
    (root / "img" / "0").mkdir(parents=True)
    meta = {"zarr_format": 2, "shape": CUBE.shape, "chunks": [2, 4, 3], "dtype": ">f4", "compressor": None, "fill_value": "NaN", "order": "F", "filters": None}
    (root / "img" / "0" / ".zarray").write_text(json.dumps(meta))
    (root / "img" / "0" / "0.0.0").write_bytes(CUBE[:2, :, :3].astype(">f4").tobytes(order="F"))
    scales = [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [2.0, 1.0, 1.0]}]}]
    (root / "img" / ".zattrs").write_text(json.dumps({"multiscales": [{"axes": [{"name": a} for a in "zyx"], "datasets": scales}]}))
    got = {(r["z"], r["y"], r["x"]): r["v"] for r in to_voxels(formats.open_image(spark, f"file://{root}/img")).collect()}
    assert len(got) == CUBE.size
    for at in np.ndindex(CUBE.shape):
        assert got[at] == CUBE[at] if at[0] < 2 and at[2] < 3 else np.isnan(got[at])
    assert formats.multiscale_levels(spark, f"file://{root}/img")[0]["scale"] == [2.0, 1.0, 1.0]


def test_zarr_3_and_plates(spark, tmp_path):
    import zstandard

    plate = tmp_path / "plate.zarr"
    for field in (0, 1):
        image = plate / "A" / "1" / str(field)
        (image / "s0" / "c" / "0" / "0").mkdir(parents=True)
        ome = {"version": "0.5", "multiscales": [{"axes": ["z", "y", "x"], "datasets": [{"path": "s0"}]}]}
        (image / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"ome": ome}}))
        array = {"zarr_format": 3, "node_type": "array", "shape": [3, 4, 5], "data_type": "uint16", "fill_value": 9,
                 "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [3, 4, 3]}}, "chunk_key_encoding": {"name": "default"},
                 "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd"}]}
        (image / "s0" / "zarr.json").write_text(json.dumps(array))
        raw = (CUBE[:, :, :3] + field).astype("<u2").tobytes()
        (image / "s0" / "c" / "0" / "0" / "0").write_bytes(zstandard.compress(raw))
    (plate / "zarr.json").write_text(json.dumps({"attributes": {"ome": {"plate": {"wells": [{"path": "A/1"}]}}}}))
    (plate / "A" / "1" / "zarr.json").write_text(json.dumps({"attributes": {"ome": {"well": {"images": [{"path": "0"}, {"path": "1"}]}}}}))
    rows = to_voxels(formats.read_ome_zarr(spark, f"file://{plate}")).collect()
    assert len(rows) == 2 * CUBE.size
    for r in rows:
        assert r["v"] == (CUBE[r["z"], r["y"], r["x"]] + r["p"] if r["x"] < 3 else 9)


def test_n5_blocks_that_are_not_stored_hold_0(spark, tmp_path):
    import struct

    root = tmp_path / "n5"
    (root / "1" / "0").mkdir(parents=True)
    (root / "attributes.json").write_text(json.dumps({"dimensions": [5, 4, 3], "blockSize": [3, 4, 2], "dataType": "uint16", "compression": {"type": "raw"}}))
    (root / "1" / "0" / "0").write_bytes(struct.pack(">HH3I", 0, 3, 2, 4, 2) + CUBE[:2, :, 3:].astype(">u2").tobytes())
    want = np.zeros_like(CUBE)
    want[:2, :, 3:] = CUBE[:2, :, 3:]
    assert _total(formats.open_image(spark, f"file://{root}")) == _truth(want)


def _lzw(data: bytes) -> bytes:
    table, width, bits, word = {bytes([i]): i for i in range(256)}, 9, [], b""
    put = lambda code: bits.extend((code >> i) & 1 for i in range(width - 1, -1, -1))
    put(256)
    size = 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word])
        table[word + bytes([b])] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        word = bytes([b])
        if size == 4094:
            put(table[word])
            put(256)
            table, width, size, word = {bytes([i]): i for i in range(256)}, 9, 258, b""
    if word:
        put(table[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    bits += [0] * (-len(bits) % 8)
    return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("size", [0, 10, 3000, 40000])
def test_lzw(size):
    rng = np.random.default_rng(size)
    data = (rng.integers(0, 4, size) * rng.integers(0, 60, size)).astype(np.uint8).tobytes()
    assert formats.unpack_lzw(_lzw(data)) == data


def _tiled_tiff(planes: np.ndarray, tile: int, packing: int, description: bytes) -> bytes:
    import struct
    import zlib

    out, links = bytearray(struct.pack("<2sHI", b"II", 42, 0)), [4]
    for plane in planes:
        starts, counts = [], []
        for y in range(0, plane.shape[0], tile):
            for x in range(0, plane.shape[1], tile):
                block = np.zeros((tile, tile), "<u2")
                part = plane[y : y + tile, x : x + tile]
                block[: part.shape[0], : part.shape[1]] = part
                block = np.diff(block.astype(np.int64), axis=1, prepend=0).astype("<u2")
                raw = {1: bytes, 5: _lzw, 8: zlib.compress}[packing](block.tobytes())
                starts.append(len(out))
                counts.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        places = {}
        for name, values in (("starts", starts), ("counts", counts)):
            places[name] = len(out)
            out += struct.pack(f"<{len(values)}I", *values)
        places["text"] = len(out)
        out += description + b"\0" * (2 - len(description) % 2)
        tags = [(256, 4, 1, plane.shape[1]), (257, 4, 1, plane.shape[0]), (258, 3, 1, 16), (259, 3, 1, packing), (270, 2, len(description) + 1, places["text"]),
                (277, 3, 1, 1), (317, 3, 1, 2), (322, 4, 1, tile), (323, 4, 1, tile),
                (324, 4, len(starts), places["starts"] if len(starts) > 1 else starts[0]), (325, 4, len(counts), places["counts"] if len(counts) > 1 else counts[0]), (339, 3, 1, 1)]
        struct.pack_into("<I", out, links[-1], len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        links.append(len(out))
        out += struct.pack("<I", 0)
    return bytes(out)


@pytest.mark.parametrize("packing", [1, 5, 8])
def test_tiled_tiff_with_ome_axes(spark, tmp_path, packing):
    planes = np.arange(6 * 20 * 23, dtype=np.uint16).reshape(6, 20, 23) * 7
    text = b'<OME><Image><Pixels DimensionOrder="XYZCT" SizeX="23" SizeY="20" SizeZ="3" SizeC="2" SizeT="1" Type="uint16"/></Image></OME>'
    raw = _tiled_tiff(planes, 16, packing, text)
    assert (formats.decode_tiff(raw) == planes).all()
    array, axes = formats.decode_tiff_image(raw)
    assert axes == "tczyx" and array.shape == (1, 2, 3, 20, 23)
    (tmp_path / "a.ome.tif").write_bytes(raw)
    rows = to_voxels(formats.open_image(spark, f"file://{tmp_path}/a.ome.tif")).collect()
    assert len(rows) == planes.size and all(r["v"] == planes[3 * r["c"] + r["z"], r["y"], r["x"]] for r in rows)


def test_unknown_and_unavailable(spark, tmp_path):
    with pytest.raises(formats.UnavailableFormat):
        formats.open_image(spark, f"file://{tmp_path}/a.h5")
    with pytest.raises(ValueError):
        formats.open_image(spark, f"file://{tmp_path}")
    assert formats.infer_axes((2, 9, 4, 4), z_count=9, c_count=2) == "czyx"


def test_store(spark, sf, tmp_path):
    store = stores.Store(spark, f"file://{tmp_path}/store")
    v = embedding_voxels(spark, sf).where("t = 0")
    names = store.ingest(v, (1, 2, 4))
    assert [store.read(n).count() for n in names] == [v.count(), v.count() // 8, v.where("z % 4 = 0 AND y % 4 = 0 AND x % 4 = 0").count()]
    assert store.ingest(v, (1, 2, 4)) == names and store.complete("data")
    store.put_metadata("calibration", {"z": "+x"})
    assert store.metadata("calibration") == {"z": "+x"}
    store.write_block("data", v.where("p = 0 AND c = 0").withColumn("v", v["v"] * 0))
    assert store.read("data").where("v = 0").count() == 640 and store.read("data").count() == v.count()
    files = stores.export_volumes(to_chunks(v.where("p = 0 AND c = 0"), (10, 8, 8))).collect()
    assert formats.decode_tiff(bytes(files[0]["content"])).shape == (10, 8, 8)
