import numpy as np

from voxelloom.operators import registration as R


def test_third_edge_is_pruned():
    edges = [
        {"fixed": 0, "moving": 1, "overlap_voxels": 100, "shift": [1, 0, 0]},
        {"fixed": 1, "moving": 2, "overlap_voxels": 100, "shift": [1, 0, 0]},
        {"fixed": 0, "moving": 2, "overlap_voxels": 1, "shift": [20, 0, 0]},
    ]
    solution, active, errors = R.solve_with_pruning([0, 1, 2], edges, 0)
    assert active == [0, 1] and np.isnan(errors[2])
    assert np.allclose([solution[1][0], solution[2][0]], [1, 2])


def test_disconnected_tile_stays():
    solution = R.solve_translations([0, 1, 2], [{"fixed": 0, "moving": 1, "shift": [3, 0, 0]}], 0)
    assert np.allclose(solution[1], [3, 0, 0]) and np.allclose(solution[2], 0)


def test_log_gains_and_lattice():
    gains = R.solve_log_gains([0, 1], [{"fixed": 0, "moving": 1, "gain": 2.0}], 0)
    assert abs(gains[1] - 2) < 1e-9 and gains[0] == 1
    out = R.solve_lattice(2, [(0, 1.0, 11.0)], 0.1, 5.0)
    assert out[0] == 5.0 and out[1] == 0


def test_similarity_and_ransac():
    rng = np.random.default_rng(3)
    src = rng.random((30, 2)) * 50
    turn = 1.2 * np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
    dst = src @ turn.T + [4, -2]
    dst[:5] += 40
    model, inside = R.ransac_similarity(src, dst)
    assert inside.sum() == 25 and np.allclose(model[:, :2], turn) and np.allclose(model[:, 2], [4, -2])
    parts = R.decompose(turn3 := np.diag([2.0, 3.0, 4.0]))
    assert np.allclose(sorted(parts["scale"]), [2, 3, 4]) and np.allclose(parts["rotation"], 0) and turn3.shape == (3, 3)


def test_envelope_tilt(spark):
    rows = [(z, y, 100.0 if 0 <= z - round(y * np.tan(np.radians(18))) < 10 else 0.0) for z in range(60) for y in range(96)]
    faces = spark.createDataFrame([(int(z), int(y), float(v)) for z, y, v in rows], "z int, y int, v double")
    found = R.envelope_tilt(faces, 1.0, 1.0).first()["tilt_deg"]
    assert abs(found - 18) < 1.5
