"""Poses, grids, key points, sinks, run ledger, chunk operators: values worked out by hand or brute force."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.functions import parsing
from voxelloom.operators import blocks, fusion, grids, keypoints, poses, projection, regions
from voxelloom.plans import run_ledger
from voxelloom.sources import formats, sinks
from voxelloom.sources.voxels import embedding_voxels, to_chunks, to_voxels


def _key(rows):
    return sorted((r["t"], r["p"], r["c"], r["z"], r["y"], r["x"], float(r["v"])) for r in rows)


def test_rotations_and_poses():
    quarter = poses.rotation_of([0, 0, np.pi / 2])
    assert np.allclose(quarter @ [1, 0, 0], [0, 1, 0])
    rng = np.random.default_rng(0)
    for _ in range(20):
        v = rng.normal(size=3)
        v *= rng.uniform(0, 3.1) / np.linalg.norm(v)
        assert np.allclose(poses.vector_of(poses.rotation_of(v)), v, atol=1e-6)
        pose = np.concatenate([v, rng.normal(size=3), [0.3]])
        assert np.allclose(poses.matrix_to_pose(poses.pose_to_matrix(pose, "similarity"), "similarity"), pose, atol=1e-6)
    half = poses.rotation_of([np.pi, 0, 0])
    assert np.allclose(poses.rotation_of(poses.vector_of(half)), half, atol=1e-6)


def test_slerp():
    steps = poses.slerp_angles((0, 0, 0), (90, 0, 0), (0, 0.5, 1))
    assert np.allclose(steps, [[0, 0, 0], [45, 0, 0], [90, 0, 0]])
    start, end = (10, 20, 30), (-40, 5, 60)
    first, last = poses.slerp_angles(start, end, (0, 1))
    assert np.allclose(first, start) and np.allclose(last, end)
    assert poses.slerp_angles(start, end, ()) == []


def test_affines_and_boxes():
    m = poses.position_affine(1, 2, 3, 90)
    assert np.allclose(m[2:4, 2:4], [[0, 1], [-1, 0]]) and m[2:5, 5].tolist() == [3, 2, 1]
    a = np.eye(4)
    a[:3, :3], a[:3, 3] = np.diag([2, 1, 1]), [1, 0, 0]
    assert poses.translation_of(a, (3, 0, 0)).tolist() == [-2, 0, 0]
    assert poses.tile_extent((2, 3, 4), (5, 1, 0.5)).tolist() == [2, 3, 10]
    assert poses.swap_columns(np.array([[1, 2]])).tolist() == [[2, 1]]
    slanted = np.eye(3)
    slanted[1, 2] = -0.5
    scan = {"mode": "stage_scan", "scan_axis": "z", "stage_axis": "y", "scan_step_um": 2}
    assert poses.oblique_voxel((1, 1, 1), slanted, scan) == (4, 1, 1)
    assert poses.oblique_voxel((1, 1, 1), slanted, scan | {"stage_axis": "x"}) == poses.oblique_voxel((1, 1, 1), slanted, None) == (1, 1, 1)
    low, nodes = poses.lattice((0, 0, 0), (10, 4, 3), (2, 2, 5))
    assert low.tolist() == [0, 0, 0] and nodes.tolist() == [3, 3, 3]
    moved = np.eye(4)
    moved[:3, 3] = [4, 0, 0]
    assert poses.source_box(moved, (4, 0, 0), (2, 2, 2), (8, 8, 8), (1, 1, 1), 0) == (slice(0, 2), slice(0, 2), slice(0, 2))
    assert poses.source_box(moved, (40, 0, 0), (2, 2, 2), (8, 8, 8), (1, 1, 1), 0) is None
    grid = np.zeros((2, 2, 2, 3))
    grid[1] = 1.0
    assert np.allclose(poses.lattice_displacement(np.array([[0.5, 0, 0], [9, 9, 9], [-1, 0, 0]]), grid, (0, 0, 0), (1, 1, 1))[:, 0], [0.5, 1, 0])


@pytest.mark.parametrize("kind", ["rigid", "similarity"])
def test_pose_solve(kind):
    rng = np.random.default_rng(1)
    true = {0: np.eye(4)}
    for p in range(1, 5):
        true[p] = poses.pose_to_matrix(np.concatenate([0.2 * rng.normal(size=3), rng.normal(size=3), [0.1 * rng.normal()]]), kind)
    edges = [{"fixed": a, "moving": b, "matrix": np.linalg.inv(true[a]) @ true[b], "overlap_voxels": 100 + a} for a, b in ((0, 1), (1, 2), (2, 3), (0, 3), (1, 3))]
    got = poses.solve_poses([0, 1, 2, 3, 4], edges, 0, kind)
    for p in range(4):
        assert np.allclose(got[p], true[p], atol=1e-5), p
    assert np.allclose(got[4], np.eye(4))


def test_offsets():
    edges = [{"fixed": 0, "moving": 1, "offset": 2.0}, {"fixed": 1, "moving": 2, "offset": 1.0}]
    assert poses.solve_offsets([0, 1, 2, 3], edges, 0, {0: 1.0, 1: 3.0}) == pytest.approx({0: 0.0, 1: 2.0, 2: 5.0, 3: 0.0})


def test_grids(spark):
    assert grids.core_crop(((2, 10),), ((4, 8),)) == (slice(2, 6),)
    assert grids.strided((slice(0, 9),), 3) == (slice(0, 9, 3),)
    assert grids.is_empty((slice(0, 2), slice(3, 3))) and not grids.is_empty((slice(0, 1),))
    assert grids.normalize_index((1, slice(1, 3)), (4, 5, 6)) == ((slice(1, 2), slice(1, 3), slice(0, 6)), (0,))
    assert grids.normalize_index((Ellipsis, -1), (4, 5)) == ((slice(0, 4), slice(4, 5)), (1,))
    with pytest.raises(ValueError):
        grids.normalize_index(slice(0, 4, 2), (4,))
    assert grids.centred_box((10, 12), 4) == (slice(3, 7), slice(4, 8))
    with pytest.raises(ValueError):
        grids.centred_box((10, 3), 4)
    assert grids.centre_crop((9, 4), (4, 8)) == (slice(2, 6), slice(0, 4))
    assert len(grids.tile_slices((5, 4), (2, 4))) == 3
    rows = grids.halo_tiles(spark, {"y": 5, "x": 4}, {"y": 2, "x": 4}, {"y": 1, "x": 1}, {"p": 2}).where("p = 1").orderBy("y_start").collect()
    assert [(r["y_start"], r["y_stop"], r["y_read_start"], r["y_read_stop"], r["x_read_stop"]) for r in rows] == [(0, 2, 0, 3, 4), (2, 4, 1, 5, 4), (4, 5, 3, 5, 4)]
    assert grids.chunk_starts(10, 4, 1) == [0, 3, 6] and grids.chunk_starts(11, 4, 1) == [0, 3, 6, 7] and grids.chunk_starts(3, 4, 1) == [0]
    found = grids.registration_chunks((10,), 4, 2)
    assert found[1] == {"core": ((2, 6),), "extended": ((1, 7),)}
    assert grids.plane_batch(64, 1 << 20, 8 << 30, 0) == 128 and grids.plane_batch(16, 64 << 20, 1 << 30, 0) == 16
    assert grids.preserved_tile((1024, 512), 1 << 12, 128 << 20) == (256, 128) or np.prod(grids.preserved_tile((1024, 512), 1 << 12)) <= 1 << 15
    assert grids.downsample_factor((100, 100, 100), 500_000) == 2 and grids.downsample_factor((10, 10, 10), 1000) == 1
    assert grids.extend_factors([(1, 1, 1, 1, 1, 1)], 2)[-1] == (1, 1, 1, 4, 4, 4)
    assert grids.level_factor({"pyramid_factors_tpczyx": [[1] * 6, [1, 1, 1, 2, 4, 4]]}, 1) == (2, 4, 4)
    assert grids.level_component("data", 1, lambda c: c == "data_pyramid/level_1") == "data_pyramid/level_1"
    with pytest.raises(FileNotFoundError):
        grids.level_component("results/a/data", 1, lambda c: False)
    assert grids.default_contrast("uint16") == (0, 65535) and grids.default_contrast("float32") == (0, 1)
    gib = 1 << 30
    assert grids.recommend_workers(None, (1, 1, 1, 256, 256, 256), 2, 8, 32 * gib) == {"workers": 8, "threads": 1, "memory": (32 * gib - 32 * gib // 10) // 8}
    assert grids.recommend_workers((1, 1, 1, 256, 256, 512), (1, 1, 1, 256, 256, 256), 2, 8, 32 * gib)["workers"] == 2
    assert grids.position_count([None, (2, 7, 1, 1, 1, 1)], [], 3) == 7 and grids.position_count([], [(1, 4, 1, 1, 1, 1)], 3) == 4 and grids.position_count([], [], 0) == 1


def test_settings():
    assert parsing.parse_chunks("256") == 256 and parsing.parse_chunks(" 1, 2 ,3") == (1, 2, 3) and parsing.parse_chunks("") is None
    for bad in ("0", "a", "1,,2", "-3"):
        with pytest.raises(ValueError):
            parsing.parse_chunks(bad)
    assert parsing.parse_calibration("z=+x, y=none, x=-Y") == {"z": "+x", "y": "none", "x": "-y"}
    assert parsing.normalize_calibration(None) == {"z": "+z", "y": "+y", "x": "+x"} == parsing.normalize_calibration("")
    assert parsing.format_calibration(parsing.normalize_calibration({"z": "f", "y": "none", "x": "none"})) == "z=+f,y=none,x=none"
    for bad in ("z=+x,y=+x,x=none", "z=+x,y=none", "z=+x,z=+y,x=none", "z=+q,y=none,x=none"):
        with pytest.raises(ValueError):
            parsing.parse_calibration(bad)
    assert parsing.int_triplet("1,2,3", "a", (0, 0, 0)) == (1, 2, 3) and parsing.int_triplet(None, "a", (4, 5, 6)) == (4, 5, 6) and parsing.int_triplet(7, "a", (0, 0, 0)) == (7, 7, 7)
    with pytest.raises(ValueError):
        parsing.int_triplet((1, 2), "a", (0, 0, 0))


def test_descriptors(spark):
    rng = np.random.default_rng(3)
    image = rng.normal(size=(90, 90))
    points = np.array([[20, 20], [40, 50], [60, 30], [2, 2], [70, 70]])
    kept, bits = keypoints.describe(image, points)
    assert kept.tolist() == [True, True, True, False, True] and bits.shape == (4, 256)
    moved = np.roll(image, (3, 4), (0, 1))
    _, other = keypoints.describe(moved, (points[kept] + [3, 4])[::-1])
    assert keypoints.match(bits, other).tolist() == [3, 2, 1, 0]
    pack = lambda b, key: [(key, i, bytearray(np.packbits(r).tobytes())) for i, r in enumerate(b)]
    left, right = (spark.createDataFrame(pack(a, 1) + pack(b, 2), "key long, id long, bits binary") for a, b in ((bits, other), (other, other)))
    got = {(r["key"], r["a"]): (r["b"], r["distance"]) for r in keypoints.match_rows(left, right).collect()}
    assert [got[1, i][0] for i in range(4)] == [3, 2, 1, 0] and all(got[2, i] == (i, 0) for i in range(4))


def test_point_filters(spark):
    image = np.zeros((4, 20, 20))
    image[1, 5, 5], image[1, 6, 5], image[1, 15, 15] = 9, 8, 7
    points = [[1, 5, 5, 2, 1], [1, 6, 5, 2, 50], [1, 15, 15, 2, 1]]
    kept = keypoints.keep_apart_until_stable(points, image, 1.5)
    assert kept[:, :3].tolist() == [[1, 5, 5], [1, 15, 15]] and kept[:, 4].tolist() == [9, 7]
    old = spark.createDataFrame([(0.0, 1.0, 2.0, 3.0, 4.0)], "t double, c double, z double, y double, x double")
    assert keypoints.overlay(old, 0).first()["sigma"] == 1.0 and keypoints.overlay(old, 1).count() == 0
    new = old.withColumn("p", F.lit(1.2)).withColumn("sigma", F.lit(3.0)).withColumn("intensity", F.lit(8.0))
    assert tuple(keypoints.overlay(new, 1).first()) == (0.0, 1.0, 2.0, 3.0, 4.0, 3.0, 8.0)


def test_ridges():
    plane = np.full((40, 40), 10.0)
    plane[:, 20] = 0.0
    dark = keypoints.meijering(plane, (1, 2))
    assert dark.max() == 1.0 and dark[20].argmax() == 20 and dark[20, 5] < 0.05
    assert keypoints.meijering(-plane, (1, 2), dark=False)[20].argmax() == 20
    tube = np.zeros((16, 16, 16))
    tube[:, 8, 8] = 5.0
    found = keypoints.tubeness(tube, (1, 2))
    assert np.unravel_index(found[8].argmax(), (16, 16)) == (8, 8) and found[8, 2, 2] < 0.1 * found[8, 8, 8]
    flat = keypoints.blur_difference(np.full((9, 9), 3.0), 2.0, 1.0)
    assert np.allclose(flat, 0)
    spot = np.zeros((21, 21))
    spot[10, 10] = 1
    assert keypoints.blur_difference(spot, 3.0, 1.0)[10, 10] > 0


def test_chunk_operators_equal_voxel_operators(spark, sf):
    v = embedding_voxels(spark, sf).where("t < 2")
    chunks = to_chunks(v, (4, 5, 3), "uint16")
    for axis, name in (("z", "xy"), ("y", "xz"), ("x", "yz")):
        got = sorted((r["t"], r["p"], r["c"], r["z"], r["y"], r["x"], int(r["v"])) for r in to_voxels(blocks.max_planes(chunks, axis)).collect())
        rest = [a for a in "zyx" if a != axis]
        plane = v.groupBy("t", "p", "c", *rest).agg(F.max("v").alias("v")).withColumn(axis, F.lit(0))
        assert got == sorted(tuple(int(r[a]) for a in ("t", "p", "c", "z", "y", "x", "v")) for r in plane.collect()), name
    assert projection.max_projection(v, "xy").count() == to_voxels(blocks.max_planes(chunks, "z")).count()
    step = {"z": 3, "y": 2, "x": 4}
    assert _key(to_voxels(blocks.stride(chunks, step)).collect()) == _key(regions.stride_level(v, step).collect())
    counted = {(r["c"], r["bin"]): r["n"] for r in blocks.histogram(chunks, 1000, 3000, 20, ("c",)).collect()}
    want = v.groupBy("c", F.floor((F.col("v") - 1000) / 100).cast("int").alias("bin")).count().collect()
    assert counted == {(r["c"], r["bin"]): r["count"] for r in want}


def test_chunk_fusion_equals_voxel_fusion(spark, sf):
    v = embedding_voxels(spark, sf).where("t = 0")
    offsets = {p: (0, p % 2, 6 * p) for p in range(5)}
    shape, overlap = {"z": 10, "y": 8, "x": 8}, {"z": 0, "y": 2, "x": 2}
    w = [np.array(fusion.blend_profile(shape[a], overlap[a])) if hasattr(fusion, "blend_profile") else np.ones(shape[a]) for a in "zyx"]
    mode = "feather" if hasattr(fusion, "blend_profile") else "average"
    table = spark.createDataFrame([(p, *o) for p, o in offsets.items()], "p int, oz int, oy int, ox int")
    want = {(r["t"], r["c"], r["z"], r["y"], r["x"]): r["v"] for r in fusion.fuse_translated(v, table, shape, overlap, mode).collect()}
    got = blocks.fuse(to_chunks(v, (4, 8, 5), "uint16"), offsets, (10, 8, 8), (4, 4, 16), tuple(w))
    rows = {(r["t"], r["c"], r["z"], r["y"], r["x"]): int(r["v"]) for r in to_voxels(got).collect()}
    assert {k: n for k, n in rows.items() if k in want} == want and all(n == 0 for k, n in rows.items() if k not in want)


def test_chunk_correction(spark):
    block = np.arange(24, dtype=np.uint16).reshape(2, 3, 4)
    rows = formats.chunk_rows(block, "zyx")
    chunks = spark.createDataFrame(rows, formats.CHUNK_FIELDS)
    flat, dark = np.full((3, 4), 2.0), np.full((3, 4), 0.5)
    table = spark.createDataFrame([(0, 0, 0, 0, bytearray(flat.tobytes()), bytearray(dark.tobytes()))], "p int, c int, y0 int, x0 int, flat binary, dark binary")
    got = {(r["z"], r["y"], r["x"]): r["v"] for r in to_voxels(blocks.correct(chunks, table)).collect()}
    assert got == {at: (float(block[at]) - 0.5) / 2 for at in np.ndindex(block.shape)}


def test_plate_round_trip(spark, sf, tmp_path):
    v = embedding_voxels(spark, sf).where("t < 2 AND p < 2")
    levels = [to_chunks(v, (5, 8, 8), "uint16"), to_chunks(regions.stride_level(v, {"z": 2, "y": 2, "x": 2}), (5, 8, 8), "uint16")]
    root = f"file://{tmp_path}/plate.zarr"
    n = sinks.publish_plate(levels, root, {"t": 2, "p": 2, "c": 2, "z": 10, "y": 8, "x": 8}, (5, 8, 8), (2.0, 1.0, 1.0), [1, 2], origins={1: (0, 5, 6)})
    assert n == 2 * 2 * 2 * 2 + 2 * 2 * 2
    assert _key(to_voxels(formats.open_image(spark, root)).collect()) == _key(v.collect())
    level = formats.multiscale_levels(spark, f"{root}/A/1/1")[1]
    assert level["scale"] == [1.0, 1.0, 4.0, 2.0, 2.0] and level["axes"] == "tczyx"
    meta = json.loads((tmp_path / "plate.zarr/A/1/1/.zattrs").read_text())
    assert meta["multiscales"][0]["datasets"][0]["coordinateTransformations"][1]["translation"] == [0, 0, 0, 5, 6]
    assert formats.probe(spark, f"{root}/A/1/0") == {"shape": (2, 2, 10, 8, 8), "dtype": "uint16", "axes": "tczyx"}


def test_largest_array_of_a_group(spark, tmp_path):
    for name, n in (("a", 2), ("b/c", 4)):
        block = np.arange(n * n, dtype=np.uint16).reshape(1, n, n)
        chunks = spark.createDataFrame(formats.chunk_rows(block, "zyx"), formats.CHUNK_FIELDS)
        sinks.tiff_to_zarr(chunks, f"file://{tmp_path}/g.zarr/{name}", (1, 2, 2), "uint16")
    assert to_voxels(formats.open_image(spark, f"file://{tmp_path}/g.zarr")).count() == 16
    assert [p.rsplit("/", 1)[-1] for p, _ in formats.array_paths(spark, f"file://{tmp_path}/g.zarr")] == ["a", "c"]


def test_n5_collection(spark, tmp_path):
    setups = {0: (0, 0), 1: (0, 1), 2: (1, 0), 3: (1, 1)}
    cube = np.arange(24, dtype=np.uint16).reshape(2, 3, 4)
    for s in setups:
        for t in (3, 7):
            folder = tmp_path / f"setup{s}" / f"timepoint{t}" / "s0"
            (folder / "0" / "0").mkdir(parents=True)
            (folder / "attributes.json").write_text(json.dumps({"dimensions": [4, 3, 2], "blockSize": [4, 3, 1], "dataType": "uint16", "compression": {"type": "raw"}}))
            (folder / "0" / "0" / "0").write_bytes(struct.pack(">HH3I", 0, 3, 4, 3, 1) + (cube[:1] + s * 100 + t).astype(">u2").tobytes())
    root = f"file://{tmp_path}"
    assert formats.n5_summary(formats.n5_datasets(spark, root), setups) == {"t": 2, "p": 2, "c": 2, "z": 2, "y": 3, "x": 4}
    rows = to_voxels(formats.read_n5_collection(spark, root, setups)).collect()
    assert len(rows) == 8 * 24
    for r in rows:
        s = 2 * r["p"] + r["c"]
        assert r["v"] == (cube[0, r["y"], r["x"]] + s * 100 + (3, 7)[r["t"]] if r["z"] == 0 else 0)
    with pytest.raises(ValueError):
        formats.n5_summary([d for d in formats.n5_datasets(spark, root) if (d["setup"], d["timepoint"]) != (3, 7)], setups)


def test_detection_files(spark, tmp_path):
    rows = [(float(t), 0.0, 0.0, float(z), 1.0, 2.0, 1.5, 10.0 * z + t) for t in (1, 0) for z in (2, 0, 1)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in sinks.DETECTION_COLUMNS)).repartition(3)
    assert sinks.save_detections(table, f"file://{tmp_path}/d", {"threshold": 0.1}, "run") == 6
    import zlib

    got = np.frombuffer(zlib.decompress((tmp_path / "d/detections/0/0").read_bytes()), "<f4").reshape(-1, 8)
    assert got.tolist() == [list(map(float, r)) for r in sorted(rows)]
    points = np.frombuffer(zlib.decompress((tmp_path / "d/points_tzyx/0/0").read_bytes()), "<f4").reshape(-1, 4)
    assert points.tolist() == [[r[0], r[3], r[4], r[5]] for r in sorted(rows)]


def test_projection_files(spark, sf, tmp_path):
    planes = projection.max_projection(embedding_voxels(spark, sf).where("t = 0 AND c = 0"), "xy").withColumn("projection", F.lit("xy"))
    done = sinks.write_files(sinks.projection_files(planes, f"file://{tmp_path}", (8, 8))).collect()
    assert len(done) == 5
    image = formats.decode_tiff((tmp_path / "mip_xy_p0003_t0000_c0000.tif").read_bytes())[0]
    assert image.shape == (8, 8) and image.dtype == np.uint16
    assert {(r["y"], r["x"]): r["v"] for r in planes.where("p = 3").collect()} == {at: int(n) for at, n in np.ndenumerate(image)}


def test_small_files(spark, tmp_path):
    m = np.arange(16.0).reshape(4, 4)
    back = sinks.read_affine_mat(sinks.affine_mat(m, (7, 8, 9)))
    assert back["fixed"].tolist() == [7, 8, 9] and back["AffineTransform_double_3_3"].tolist() == [0, 1, 2, 4, 5, 6, 8, 9, 10, 3, 7, 11]
    for name in ("Round1_a.tif", "Round1_b.tif", "Round2_a.tiff", "x.TIFF", "sub/y.tiff", "z.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    root = f"file://{tmp_path}"
    assert [p.rsplit("/", 1)[-1] for p in sinks.moving_images(spark, root, 1)] == ["Round1_a.tif", "Round1_b.tif"]
    assert len(sinks.moving_images(spark, root, 2)) == 1 and sinks.moving_images(spark, root, 3) == []
    assert sinks.rename_suffix(spark, root) == 3 and (tmp_path / "sub/y.tif").exists()
    assert sinks.delete_suffix(spark, root, "log") == 1 and not (tmp_path / "z.log").exists()
    sinks.reset_folder(spark, f"{root}/sub")
    assert list((tmp_path / "sub").iterdir()) == []


def test_run_ledger(spark, tmp_path):
    book = run_ledger.RunLedger(spark, f"file://{tmp_path}/store")
    assert book.records() == [] and book.verify() == (True, []) and book.history("fusion")["has_run"] is False
    first = book.append({"a": 1}, [{"name": "fusion", "parameters": {"exponent": 2, "force_rerun": True}}], {"fusion": "x"})
    book.append({}, [{"name": "fusion", "skipped": True}], {})
    last = book.append({}, [{"name": "mip_export", "parameters": {}}], {}, status="failed")
    records = book.records()
    assert [r["run_index"] for r in records] == [1, 2, 3] and records[1]["hash_chain"]["prev_hash"] == records[0]["hash_chain"]["self_hash"]
    assert book.history("fusion", {"exponent": 2, "force_rerun": False}) == {"has_run": True, "matches": True, "latest_run_id": first, "matching_run_id": first}
    assert book.history("fusion", {"exponent": 3})["matches"] is False and book.history("mip_export")["has_run"] is False
    log = run_ledger.AuditLog(str(tmp_path / "run.events.jsonl"), "e", last)
    log.emit("started", metadata={"api-key": "x", "n": 1})
    log.emit("ended", "ERROR", error="e")
    manifest = log.manifest()
    assert manifest["event_count"] == 2 and manifest["sha256"] == run_ledger.file_sha256(log.path)
    assert json.loads((tmp_path / "run.events.jsonl").read_text().splitlines()[0])["metadata"] == {"api-key": "[REDACTED]", "n": 1}
    book.attach_manifest(last, manifest)
    with pytest.raises(ValueError):
        book.attach_manifest(first, manifest)
    assert book.verify() == (True, []) and book.records()[-1]["audit_log"]["event_count"] == 2 and book.table().count() == 3
    assert book.persist_events(log.path, last).endswith(f"{last}.jsonl")
    book.put_state({"k": [1]}, "gui")
    assert book.state() == {"k": [1]}
    path = next((tmp_path / "store/provenance/runs").glob("00000002-*.json"))
    record = json.loads(path.read_text())
    record["status"] = "altered"
    sinks.put(f"file://{path}", json.dumps(record).encode())
    assert book.verify() == (False, ["run 2: self_hash mismatch"])
    assert run_ledger.text_log_events_path("/a/run.log") == "/a/run.events.jsonl"


def test_tubes():
    from voxelloom.operators import tubes

    rng = np.random.default_rng(5)
    volume = 0.05 * rng.normal(size=(20, 20, 20))
    volume[:, 9:11, 9:11] += 1.0
    mask, response = tubes.segment(volume, (1, 2), least=20, distance=2)
    assert mask[10, 9:11, 9:11].all() and mask.sum() < 0.1 * mask.size and response.max() <= 1.0
    assert not mask[:, :4, :4].any()
    ring = np.zeros((5, 5, 5), bool)
    ring[1:4, 1:4, 1:4] = True
    ring[2, 2, 2] = False
    assert tubes.fill_holes(ring).sum() == 27
    two = np.zeros((4, 4, 4), bool)
    two[0, 0, :3], two[3, 3, 3] = True, True
    parts = tubes.labels_of(two)
    assert parts.max() == 2 and (parts[0, 0, :3] == parts[0, 0, 0]).all()
    assert tubes.drop_small(two, 2).sum() == 3
    gap = np.zeros((7, 7, 7), bool)
    gap[2:5, 2:5, 1:3], gap[2:5, 2:5, 4:6] = True, True
    assert tubes.close_gaps(gap, 1)[3, 3, 3]
    flat = np.full((6, 6, 6), 2.0)
    assert np.allclose(tubes.nonlocal_means(flat, 0.1, distance=1), 2.0) and tubes.noise_of(flat) == 0
    assert abs(tubes.noise_of(rng.normal(0, 0.3, (40, 40, 40))) - 0.3) < 0.03


def test_tile_rows_are_registered(spark):
    from voxelloom.operators import stitching

    rng = np.random.default_rng(6)
    scene = rng.integers(100, 4000, (48, 140)).astype(float)
    moves = {0: (1, -2), 1: (0, 0), 2: (-1, 1)}
    layout = stitching.canvas((32, 48), 3, 0.5, 0.25)
    rows = []
    for p, (dy, dx) in moves.items():
        tile = scene[8 + dy : 40 + dy, 16 + layout.step * p + dx : 64 + layout.step * p + dx]
        rows += [(0, p, 0, y, x, int(tile[y, x])) for y, x in np.ndindex(tile.shape)]
    pixels = spark.createDataFrame(rows, "t int, p int, c int, y int, x int, v int")
    got = {r["p"]: (round(r["dy"]), round(r["dx"])) for r in stitching.register_positions(pixels, layout, (32, 48), 3).collect()}
    assert got == moves
    made = stitching.process(pixels, (32, 48), 3, 0.5, 0.25, 0)
    assert all(abs(r["v"] - scene[8 + r["y"] - layout.margin, 16 + r["x"] - layout.margin]) <= 1 for r in made.collect())


def test_tracks_and_stage_repair(spark, tmp_path):
    from voxelloom.operators import detection
    from voxelloom.sources import stores

    (tmp_path / "t.csv").write_text("track_id,t,z,y,x,quality\n1,0,1.5,2,3,x\n1,1,0,-0.5,-0.5,1\n2,0.0,1,2,3,4\n")
    rows = detection.read_tracks(spark, f"file://{tmp_path}/t.csv").orderBy("track_id").collect()
    assert [(r["track_id"], r["t"], r["z"], r["quality"]) for r in rows] == [(1, 0, 1.5, None), (2, 0, 1.0, 4.0)]
    assert "z" not in detection.read_tracks(spark, f"file://{tmp_path}/t.csv", planar=True).columns
    store = stores.Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError):
        stores.repair_stage(store, [{"x": 1}], {0: (0, 0, 0)}, 2)
    assert stores.repair_stage(store, [{"x": 1}, {"x": 2}], {0: (0, 0, 0), 1: (1, 2, 3)}, 2)["positions"] == 2
    assert store.metadata("stage")["position_translations_zyx_um"][1] == [1.0, 2.0, 3.0]
