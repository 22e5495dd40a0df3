"""Results that do not come from this library's own SQL: values worked out by hand."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from voxelloom import functions as V
from voxelloom.operators import fusion, kernels, ledger, regions, statistics


def test_file_names(spark):
    names = {
        "/a/Position3/CH01_000007.tiff": (7, 3, 1), "/a/Position3/x/CH00_000002.tif": (2, 3, 0), "img_C01.tif": (0, 0, 1),
        "/Position5/img_P2_T4-C3.tif": (4, 5, 3), "P2_T4_C3.ome.tif": (4, 2, 0), "/a/myPosition9/ch2_5_CH7_8.tif": (5, 0, 2),
        "/Position1/Position2/c4-t6.tif": (6, 2, 4), "xT3_CHx.tif": (0, 0, 0),
    }
    rows = spark.createDataFrame([(n,) for n in names], "path string").select("path", *[c.alias(k) for k, c in V.tiff_indices(F.col("path")).items()])
    # ``P2_T4_C3.ome.tif`` has the stem ``P2_T4_C3.ome``, whose C is not bounded
    assert {r["path"]: (r["t"], r["p"], r["c"]) for r in rows.collect()} == names


def test_hash_chain_covers_the_hash_before(spark):
    rows = spark.createDataFrame([("s", i, f"r{i}") for i in range(1, 6)] + [("u", 1, "only")], "store string, run_index int, text string")
    chained = ledger.link_hashes(rows.repartition(3), ["store"], F.col("text"))
    got = {(r["store"], r["run_index"]): (r["prev_hash"], r["self_hash"]) for r in chained.collect()}
    previous = None
    for i in range(1, 6):
        own = hashlib.sha256(f"r{i}|{previous or ''}".encode()).hexdigest()
        assert got["s", i] == (previous, own)
        previous = own
    assert got["u", 1] == (None, hashlib.sha256(b"only|").hexdigest())
    assert ledger.verify_links(chained, ["store"], F.col("text")).count() == 0
    # who changes a record and puts its own hash right still breaks the next link
    forged = chained.withColumn("text", F.when((F.col("store") == "s") & (F.col("run_index") == 2), "x").otherwise(F.col("text")))
    forged = forged.withColumn("self_hash", F.sha2(F.concat_ws("|", "text", F.coalesce("prev_hash", F.lit(""))), 256))
    assert [(r["run_index"], r["bad_self"], r["bad_prev"]) for r in ledger.verify_links(forged, ["store"], F.col("text")).collect()] == [(3, False, True)]


def test_redaction(spark):
    value = {
        "authorization": "a", "Access-Key": "b", "api-key": 1, "X-API_KEY": 2, " token ": 3, "db_password": 4, "my_secret_x": {"k": 1}, "credentials": [1],
        "author": "kept", "apikey": "kept", "list": [{"passwd": 5, "n": 6}], "private-key": 7,
    }
    secret = ledger.REDACTED
    assert ledger.redact(value) == {
        "authorization": secret, "Access-Key": secret, "api-key": secret, "X-API_KEY": secret, " token ": secret, "db_password": secret,
        "my_secret_x": secret, "credentials": secret, "author": "kept", "apikey": "kept", "list": [{"passwd": secret, "n": 6}], "private-key": secret,
    }
    row = spark.createDataFrame([('{"access_key": 1, "a": {"TOKEN": 2, "n": 3}}',), ("no json",), (None,)], "j string")
    assert [r[0] for r in row.select(ledger.redact_json("j")).collect()] == ['{"a":{"TOKEN":"[REDACTED]","n":3},"access_key":"[REDACTED]"}', "no json", None]


def test_stitch_profile():
    low, half = float(np.float32(1e-3)), 0.5
    assert fusion.stitch_profile(8, 0, 1, 0.5, 0.1) == [1.0] * 8
    assert fusion.stitch_profile(8, 1, 3, 0.0, 0.1) == [1.0] * 8
    assert np.allclose(fusion.stitch_profile(6, 1, 3, 0.5, 1e-3), [low, half, 1, 1, half, low])
    assert np.allclose(fusion.stitch_profile(6, 0, 2, 0.5, 1e-3), [1, 1, 1, 1, half, low])
    assert np.allclose(fusion.stitch_profile(4, 1, 2, 0.01, 0.2), [0.2, 1, 1, 1])


def test_boxes_have_exclusive_stops(spark):
    v = np.zeros((16, 16, 16), int)
    v[0:9, 0:9, 8:9] = 100
    cells = [(int(z), int(y), int(x), int(v[z, y, x])) for z, y, x in np.ndindex(v.shape)]
    rows = spark.createDataFrame(cells, "z int, y int, x int, v int").withColumn("k", F.lit(1))
    box = statistics.minimal_box(rows, statistics.otsu_thresholds(rows, ["k"], 8), ["k"])
    assert tuple(box.first())[1:] == (0, 9, 0, 9, 8, 9)
    assert regions.crop_to_boxes(rows, box, ["k"]).count() == 81


def test_gaussian_kernel_reaches_five_sigmas():
    w = kernels.gaussian_kernel(1.3)
    assert len(w) == 2 * 7 + 1 and abs(w.sum() - 1) < 1e-12 and abs(w[7] / w[8] - np.exp(1 / (2 * 1.3**2))) < 1e-9
