"""Queries on tables that the fixed scale factors do not show: odd ends, dense points."""

import threading

import duckdb
import numpy as np
import pandas as pd
import pytest

from voxelloom.oracles import ORACLES
from voxelloom.queries import QUERIES


def _both(spark, folder, name, table, frame):
    """Sorted rows of a query and of its SQL on ``frame``, in the same order of columns."""
    frame.to_parquet(folder / f"{table}.parquet", index=False)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    theirs = con.execute(ORACLES[name]).fetchdf()
    ours = QUERIES[name](spark, f"file://{folder}").toPandas()[list(theirs.columns)]
    return [sorted(map(repr, f.astype(object).values.tolist())) for f in (ours, theirs)]


@pytest.mark.parametrize("last", [4, 156])
def test_transform_tiles_has_only_volumes_that_exist(spark, tmp_path, last):
    frame = pd.DataFrame({"vec_id": np.arange(last + 1), "embedding": [np.zeros(64, np.float32)] * (last + 1), "label": 0})
    ours, theirs = _both(spark, tmp_path, "transform_tiles", "embeddings", frame)
    assert ours == theirs and len(ours) == (4 if last == 4 else 64)


def _mutual(fixed, moving, limit):
    """Brute force over (id, r, c) rows: sorted (moving, fixed, d)."""
    fixed, moving = [sorted(s) for s in (fixed, moving)]
    f, m = [np.array([p[1:] for p in s], float).reshape(-1, 2) for s in (fixed, moving)]
    of_m, of_f = {}, {}
    with np.errstate(invalid="ignore"):
        for i, at in enumerate(m):
            d = np.sqrt((f[:, 0] - at[0]) ** 2 + (f[:, 1] - at[1]) ** 2)
            for j in np.flatnonzero(d < limit):
                a, b = moving[i][0], fixed[j][0]
                of_m[a] = min(of_m.get(a, (np.inf, 0)), (d[j], b))
                of_f[b] = min(of_f.get(b, (np.inf, 0)), (d[j], a))
    return sorted((a, b, d) for a, (d, b) in of_m.items() if of_f[b][1] == a)


def _points(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"id {kind}, r double, c double")


def test_mutual_nn_of_dense_points(spark):
    """Every pair of these points is closer than the limit: 900 million pairs."""
    from voxelloom.operators import nearest

    n, rng = 60_000, np.random.default_rng(3)
    xy = rng.random((n, 2)) * 2
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "r": xy[:, 0], "c": xy[:, 1]}))
    late = threading.Timer(150, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = nearest.mutual_nearest(points.where("id % 2 = 0"), points.where("id % 2 = 1"), 3.0).toPandas()
    finally:
        late.cancel()
    f, m = xy[::2], xy[1::2]
    of_m, of_f, least = np.empty(n // 2, int), np.zeros(n // 2, int), np.full(n // 2, np.inf)
    for i in range(0, n // 2, 500):
        d = (m[i : i + 500, None, 0] - f[None, :, 0]) ** 2 + (m[i : i + 500, None, 1] - f[None, :, 1]) ** 2
        of_m[i : i + 500], k = d.argmin(1), d.argmin(0)
        nearer = d[k, np.arange(n // 2)] < least
        least[nearer], of_f[nearer] = d[k, np.arange(n // 2)][nearer], k[nearer] + i
    want = {(2 * i + 1, 2 * int(j)) for i, j in enumerate(of_m) if of_f[j] == i}
    assert set(zip(got["moving"], got["fixed"], strict=True)) == want and len(got) == len(want)


@pytest.mark.parametrize("unit, asks", [(1 << 20, 1 << 20), (40, 30)])
def test_mutual_nn_of_odd_points(spark, monkeypatch, unit, asks):
    from voxelloom.operators import nearest

    monkeypatch.setattr(nearest, "UNIT", unit)
    monkeypatch.setattr(nearest, "ASKS", asks)
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    lattice = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(-6, 6, (400, 2)))]
    apart = [(i, 2.9 * (i % 2) + a, b) for i, (a, b) in enumerate((rng.random((400, 2)) * 1e-3).tolist())]
    copies = [(i, 1.0, 2.0) for i in range(300)] + [(300, 5.0, 5.0), (301, 2.0, 2.0)]
    twice = [(i % 150, float(a), float(b)) for i, (a, b) in enumerate(rng.random((400, 2)) * 20)]
    odd = [(0, nan, 0.0), (1, 0.0, 0.0), (2, inf, 0.0), (3, inf, 0.0), (4, -0.0, 0.0), (5, 1e308, -1e308), (6, 1e308, -1e308), (7, -1e308, 0.0)]
    limit = [(0, 0.0, 0.0), (1, 3.0, 0.0), (2, 10.0, 0.0), (3, 12.999, 0.0)]
    for rows in (lattice, apart, copies, twice, odd, limit, limit[:1], []):
        fixed, moving = [p for p in rows if p[0] % 2 == 0], [p for p in rows if p[0] % 2 == 1]
        got = nearest.mutual_nearest(_points(spark, fixed), _points(spark, moving), 3.0)
        assert sorted(map(tuple, got.collect())) == _mutual(fixed, moving, 3.0)
    none = [(None, 0.0, 0.0), (1, None, 0.0), (3, 0.0, None)]
    got = nearest.mutual_nearest(_points(spark, [*none, (2, 1.0, 1.0)], "int"), _points(spark, [*none, (7, 1.0, 1.5)], "int"), 3.0)
    assert got.schema["fixed"].dataType.simpleString() == "int" and [tuple(r) for r in got.collect()] == [(7, 2, 0.5)]
    with pytest.raises(TypeError):
        nearest.mutual_nearest(_points(spark, [], "string"), _points(spark, [], "string"), 3.0)


def test_mutual_nn_matches_its_sql_on_copies(spark, tmp_path):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"c_custkey": np.arange(6000), "c_acctbal": np.tile(rng.integers(-99999, 999999, 1500) / 100, 4)})
    ours, theirs = _both(spark, tmp_path, "mutual_nn", "customer", frame)
    assert ours == theirs and len(ours) > 1000
