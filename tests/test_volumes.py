import numpy as np
import pytest

from voxelloom.operators import geometry, kernels, registration, render, segmentation, shear
from voxelloom.plans import runners
from voxelloom.plans import workflow as W
from voxelloom.sources import descriptors, formats
from voxelloom.sources.voxels import embedding_voxels, to_voxels


def _chunks(spark, volume, p=0, chunk_z=2):
    rows = formats.chunk_rows(volume, "zyx", {"p": p}, chunk_z)
    return spark.createDataFrame(rows, "t long, p long, c long, z0 long, y0 long, x0 long, nz long, ny long, nx long, dtype string, payload binary")


def _dense(chunks, shape):
    out = np.zeros(shape)
    for r in to_voxels(chunks).collect():
        out[r["z"], r["y"], r["x"]] = r["v"]
    return out


def test_identity_transform(spark):
    volume = np.random.default_rng(0).random((5, 6, 7)).astype(np.float32)
    out = shear.transform(_chunks(spark, volume), volume.shape, (1, 1, 1), shear.ShearParams(), (3, 4, 4))
    assert np.allclose(_dense(out, volume.shape), volume, atol=1e-6)


def test_shear_matches_whole_volume(spark):
    volume = np.random.default_rng(1).random((4, 6, 8)).astype(np.float32)
    params = shear.ShearParams(shear_xz=0.5, rotation_deg_xyz=(0, 10, 0))
    geo = shear.geometry(volume.shape, (2.0, 1.0, 1.0), params)
    whole = shear.kernels.affine_resample(volume, geo.matrix_zyx, geo.offset_zyx, geo.shape_zyx, 0.0, 1, True)
    tiled = shear.transform(_chunks(spark, volume), volume.shape, (2.0, 1.0, 1.0), params, (3, 3, 5))
    assert np.allclose(_dense(tiled, geo.shape_zyx), whole, atol=1e-5)
    assert np.allclose(shear.linear_matrix(shear.ShearParams(shear_yz=0.3, auto_rotate=True))[2, 1], -np.sin(np.arctan(0.3)))


def test_fuse_two_tiles(spark):
    a, b = np.full((2, 4, 6), 10.0, np.float32), np.full((2, 4, 6), 30.0, np.float32)
    both = _chunks(spark, a, 0).unionByName(_chunks(spark, b, 1))
    moved = np.eye(4)
    moved[0, 3] = 4
    out = render.fuse(both, {0: np.eye(4), 1: moved}, (2, 4, 6), (1, 1, 1), (2, 4, 5), mode="average")
    fused = _dense(out, (2, 4, 10))
    assert (fused[:, :, :4] == 10).all() and (fused[:, :, 4:6] == 20).all() and (fused[:, :, 6:] == 30).all()
    gained = render.fuse(both, {0: np.eye(4), 1: moved}, (2, 4, 6), (1, 1, 1), (2, 4, 5), mode="average", gains={1: (0.5, 1.0)})
    assert _dense(gained, (2, 4, 10))[0, 0, 9] == 16


def test_thresholds_and_masks():
    values = np.concatenate([np.full(50, 10), np.full(50, 200)])
    assert 10 <= segmentation.otsu(values) < 200
    three = np.concatenate([np.full(50, v) for v in (0.0, 50.0, 100.0)])
    low, high = segmentation.multi_otsu(three)
    assert 0 <= low < 50 <= high < 100
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    assert segmentation.fill_holes(ring)[3, 3] and not segmentation.fill_holes(ring)[0, 0]
    block = np.zeros((12, 12, 12))
    block[3:9, 3:9, 3:9] = 100
    mask = segmentation.gamma_mask(block, step=1, radius=1)
    assert mask[6, 6, 6] > 0.9 and mask[0, 0, 0] < 0.1


def test_point_sources():
    z, y, x = np.indices((16, 24, 24))
    block = 100 * np.exp(-((z - 8) ** 2 + (y - 10) ** 2 + (x - 14) ** 2) / (2 * 2.0**2))
    found = segmentation.point_sources(block, 1.0, 1.0)
    assert found.shape[0] == 1 and np.allclose(found[0, :3], (8, 10, 14))
    assert np.isnan(segmentation.cross_validated_residual(np.zeros((3, 2)), np.zeros((3, 2))))
    points = np.random.default_rng(0).random((20, 2))
    assert segmentation.cross_validated_residual(points, points + 3) < 1e-9


def test_mutual_information(spark):
    rows = [(0, float(i % 7), float(i % 7)) for i in range(140)] + [(1, float(i % 7), float(i % 20)) for i in range(140)]
    got = {r["k"]: r for r in segmentation.mutual_information(spark.createDataFrame(rows, "k int, fixed double, moving double"), ["k"]).collect()}
    assert abs(got[0]["mutual_information"] - np.log(7)) < 1e-9 and got[0]["correlation"] > 0.999
    assert got[1]["mutual_information"] < 1e-9


def test_descriptors(spark, tmp_path):
    text = """{"Saving": {"file_type": "TIFF"}, "MicroscopeState": {"timepoints": 3, "number_z_steps": 5, "is_multiposition": true, "step_size": "2.5",
      "zoom": "2x", "channels": {"b": {"is_selected": true}, "a": {"is_selected": true}, "c": {"is_selected": false}}},
      "CameraParameters": {"img_x_pixels": 64, "img_y_pixels": 32, "pixel_size": 6.5, "binning": "2x2"}, "MultiPositions": [["X", "Y"], [1, 2], [3, 4]]}"""
    e = descriptors.parse_experiment(text)
    assert e.channels == ("a", "b") and (e.timepoints, e.z_steps, e.positions) == (3, 5, 2)
    assert e.xy_um == 6.5 and e.z_um == 2.5 and e.shape_yx == (32, 64)
    assert descriptors.parse_experiment("MicroscopeState:\n  timepoints: 4\n").timepoints == 4
    xml = "<S><ViewSetup><id>3</id><attributes><channel>1</channel><tile>2</tile></attributes></ViewSetup></S>"
    assert descriptors.setup_map(xml) == {3: (2, 1)}
    for name in ("a_MIP.tif", "b.tif"):
        (tmp_path / name).write_bytes(b"x")
    assert descriptors.resolve(spark, [f"file://{tmp_path}"], "TIFF").endswith("b.tif")
    with pytest.raises(FileNotFoundError):
        descriptors.resolve(spark, [f"file://{tmp_path}"], "H5")
    (tmp_path / "s.n5" / "setup1" / "timepoint0" / "s0" / "0" / "0").mkdir(parents=True)
    (tmp_path / "s.n5" / "setup1" / "timepoint0" / "s0" / "0" / "0" / "0").write_bytes(b"b")
    assert [tuple(r) for r in descriptors.block_datasets(spark, f"file://{tmp_path}/s.n5").collect()] == [(1, 0, 1)]


def test_workflow_over_voxels(spark, sf):
    args = runners.parser().parse_args(["--file", "x", "--flatfield", "--mip-export", "--display-pyramid"])
    flow = runners.workflow_of(args)
    assert flow.sequence() == ["flatfield", "display_pyramid", "mip_export"]
    v = embedding_voxels(spark, sf).where("t = 0")
    out = W.run(spark, flow, {"data": v}, runners.RUNNERS)
    assert out[W.OPERATIONS["mip_export"]].count() == 10 * (64 + 80 + 80)
    assert out[W.OPERATIONS["display_pyramid"]].where("level = 1").count() == v.count() // 8


def test_register_shifted_tiles(spark):
    rng = np.random.default_rng(6)
    world = kernels.gaussian(rng.random((6, 20, 80)), 0.7) * 1000
    truth, rows = {0: 0, 1: 12, 2: 24}, []
    for p, x0 in truth.items():
        seen = x0 - (2 if p == 1 else 0)  # the stage is wrong by two voxels
        tile = world[:, :, seen : seen + 30]
        rows += [(0, p, 0, int(z), int(y), int(x), float(tile[z, y, x])) for z, y, x in np.ndindex(tile.shape)]
    v = spark.createDataFrame(rows, "t int, p int, c int, z int, y int, x int, v double")
    stage = spark.createDataFrame([(p, float(x), 0.0, 0.0, 0.0) for p, x in truth.items()], "row int, x double, y double, z double, theta double")
    moves = geometry.nominal_transforms(stage, 0, {"x": "+x", "y": "+y", "z": "+z"})
    edges = geometry.overlap_edges(geometry.tile_boxes(moves, (30.0, 20.0, 6.0)), (1.0, 1.0, 1.0)).where("moving = fixed + 1")
    got = {r["p"]: r["dx"] for r in registration.register_tiles(v, edges, moves, (1.0, 1.0, 1.0), 0, upsample=1).collect()}
    assert got == pytest.approx({0: 0.0, 1: -2.0, 2: 0.0}, abs=1e-6)


def test_deconvolve_keeps_shape(spark):
    volume = np.full((2, 8, 8), 120.0, np.float32)
    out = registration.deconvolve(_chunks(spark, volume), np.ones((1, 3, 3)), 2)
    dense = _dense(out, volume.shape)
    assert dense.shape == volume.shape and np.allclose(dense, 10, atol=1e-3)


def test_shear_transform_covers_every_volume(spark, sf):
    from voxelloom.queries import QUERIES
    from voxelloom.sources.voxels import embedding_voxels

    out = QUERIES["shear_transform"](spark, sf).select("t", "p", "c").distinct()
    assert set(out.collect()) == set(embedding_voxels(spark, sf).select("t", "p", "c").distinct().collect())
