import pytest
from pyspark.sql import functions as F

from voxelloom.operators import collections as C
from voxelloom.operators import geometry, ledger, regions
from voxelloom.plans import workflow as W


def test_chain_detects_edits():
    records = ledger.chain_records([{"run_id": f"r{i}", "status": "completed"} for i in range(4)])
    assert ledger.verify_records(records) == (True, []) and ledger.verify_records([]) == (True, [])
    records[1]["status"] = "failed"
    ok, issues = ledger.verify_records(records)
    assert not ok and issues == ["run 2: self_hash mismatch"]


def test_redaction():
    clean = ledger.redact({"api_key": "x", "a": [{"Password": 1, "b": 2}], "Token_id": None})
    assert clean == {"api_key": "[REDACTED]", "a": [{"Password": "[REDACTED]", "b": 2}], "Token_id": "[REDACTED]"}


def test_redact_column(spark):
    df = spark.createDataFrame([('{"b": 1, "secret": "s"}',), ("no json",), (None,)], "j string")
    assert [r[0] for r in df.select(ledger.redact_json("j")).collect()] == ['{"b":1,"secret":"[REDACTED]"}', "no json", None]


def test_sequence_and_issues():
    flow = W.Workflow(("fusion", "flatfield", "mip_export"), {"fusion": {"input_source": "flatfield"}, "mip_export": {"input_source": "fusion"}})
    assert flow.sequence() == ["flatfield", "fusion", "mip_export"]
    assert W.dependency_issues(flow, {"data"}) == []
    late = W.Workflow(("fusion", "flatfield"), {"fusion": {"execution_order": 1, "input_source": "flatfield"}, "flatfield": {"execution_order": 2}})
    assert W.dependency_issues(late, {"data"}) == [("fusion", "flatfield", "is produced later")]
    reasons = W.Workflow(("fusion", "registration"), {"fusion": {"input_source": "fusion"}, "registration": {"input_source": "mip_export"}})
    assert {r for *_, r in W.dependency_issues(reasons, {"data"})} == {"refers to itself", "has no image output"}
    with pytest.raises(ValueError):
        W.Workflow(("nothing",)).sequence()


def test_run_skips_what_has_run(spark):
    calls = []

    def runner(spark, tables, params):
        calls.append(params["input_source"])
        return tables["input"].withColumn("v", F.col("v") + 1)

    flow = W.Workflow(("flatfield", "fusion"), {"fusion": {"input_source": "flatfield"}})
    data = {"data": spark.createDataFrame([(1,)], "v int")}
    out = W.run(spark, flow, data, {"flatfield": runner, "fusion": runner})
    assert out[W.OPERATIONS["fusion"]].first()["v"] == 3 and len(calls) == 2
    history = {"flatfield": ledger.canonical_json(ledger.comparable(flow.resolved("flatfield")))}
    W.run(spark, flow, out, {"flatfield": runner, "fusion": runner}, history)
    assert len(calls) == 3
    with pytest.raises(W.UnavailableOperation):
        W.run(spark, W.Workflow(("usegment3d",)), data, {})


def test_stage_rows(spark):
    text = '[["X","Y","Z","THETA","F"],["1","2","NaN","4","5"],["7"]]'
    rows = C.stage_rows(spark.createDataFrame([(text,)], "payload string")).orderBy("row").collect()
    assert [tuple(r) for r in rows] == [(0, 1.0, 2.0, 0.0, 4.0, 5.0), (1, 7.0, 0.0, 0.0, 0.0, 0.0)]


def test_pyramid_factors():
    assert regions.expand_pyramid_factors([[1, 2, 4], [1, 2], [1]]) == [(1, 1, 1), (2, 2, 1), (4, 2, 1)]
    with pytest.raises(ValueError):
        regions.expand_pyramid_factors([[2]])
    assert regions.level_chunks((256, 256, 4), (10, 300, 4), (2, 2, 8)) == (10, 128, 1)
    assert geometry.budget_factor((100, 100, 100), 1000) == 10 and geometry.budget_factor((9, 9, 9), 0) == 1


def test_streaming_ingest(spark, sf, tmp_path):
    from voxelloom import streaming

    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    events.write.parquet(str(source))
    for _ in range(2):
        q = streaming.resumable_ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), "event_id long, value double")
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_without_llm(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def fake(name, *args, **kwargs):
        if name.startswith("voxelloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name="voxelloom.llm" if name != "corpus_pipeline" else name)
        return real(name, *args, **kwargs)

    kept = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("voxelloom.llm") or k in ("corpus_pipeline", "__spark_entry__")}
    monkeypatch.setattr(builtins, "__import__", fake)
    module = importlib.import_module("__spark_entry__")
    assert "mip_xy" in module.queries() and not any(k.startswith("op") and k[2].isdigit() for k in module.queries())
    sys.modules.pop("__spark_entry__")
    sys.modules.update(kept)


def test_references_and_layers():
    flow = W.Workflow(("fusion", "visualization"), {"visualization": {"volume_layers": [{"component": "a"}, {}, {"source_component": "b"}], "input_source": " "}})
    assert W.input_references(flow) == [("fusion", "input_source", "data"), ("visualization", "input_source", "data"),
                                        ("visualization", "volume_layers[0].component", "a"), ("visualization", "volume_layers[2].component", "b")]
    layers = W.volume_layers([{"component": "a"}, {"component": "a", "multiscale_policy": "off"}], {"a": 3})
    assert [r["levels"] for r in layers] == [[0, 1, 2], [0]]
    with pytest.raises(W.DependencyError):
        W.volume_layers([{"component": "b", "multiscale_policy": "require"}], {"b": 1})


def test_command_line(spark, tmp_path):
    import numpy as np

    from voxelloom.plans import run_ledger, runners

    args = runners.parser().parse_args(["--file", "x", "--usegment3d", "--channel-indices", "2, 0,2", "--input-resolution-level", "1", "-r"])
    flow = runners.workflow_of(args)
    assert flow.selected == ("usegment3d", "registration")
    assert flow.parameters["usegment3d"] == {"channel_indices": [2, 0], "channel_index": 2, "input_resolution_level": 1}
    assert runners.channel_choice("ALL") == {"all_channels": True} and runners.channel_choice(None) == {}
    for bad in (["--input-resolution-level", "-1"], ["--channel-indices", "a"]):
        with pytest.raises(ValueError):
            runners.workflow_of(runners.parser().parse_args(["--file", "x", *bad]))
    cube = np.arange(60, dtype=np.uint16).reshape(3, 4, 5)
    np.save(tmp_path / "a.npy", cube)
    root = f"file://{tmp_path}/store"
    assert runners.main(["--file", f"file://{tmp_path}/a.npy", "--store", root, "--mip-export", "--shear-transform", "--stage-axis-map", "z=+x,y=none,x=+y"]) == 0
    sheared = spark.read.parquet(f"{root}/{W.OPERATIONS['shear_transform']}")
    assert {(r["z"], r["y"], r["x"]): r["v"] for r in sheared.collect()} == {at: float(v) for at, v in np.ndenumerate(cube)}
    assert len(list((tmp_path / "store" / W.OPERATIONS["mip_export"] / "files").glob("mip_*.tif"))) == 3
    book = run_ledger.RunLedger(spark, root)
    assert book.verify() == (True, []) and book.history("mip_export")["has_run"]


def test_deconvolution_and_affine_fusion_run(spark, sf):
    import numpy as np

    from voxelloom.operators import kernels
    from voxelloom.plans import runners
    from voxelloom.sources.voxels import embedding_voxels

    assert kernels.normalize_psf(np.array([-1.0, 1.0, 3.0])).tolist() == [0, 0.25, 0.75] and not kernels.normalize_psf(np.zeros(2)).any()
    rows = embedding_voxels(spark, sf).where("t = 0 AND p < 2 AND c = 0")
    psf = np.zeros((3, 3, 3))
    psf[1, 1, 1] = 2.0
    flow = W.Workflow(("deconvolution", "fusion"), {"deconvolution": {"psf": psf, "background": 0}, "fusion": {"affines": {0: np.eye(4), 1: np.eye(4)}, "blend_mode": "average"}})
    made = W.run(spark, flow, {"data": rows}, runners.RUNNERS)
    sharp = {(r["p"], r["z"], r["y"], r["x"]): r["v"] for r in made[W.OPERATIONS["deconvolution"]].collect()}
    truth = {(r["p"], r["z"], r["y"], r["x"]): r["v"] for r in rows.collect()}
    assert sharp.keys() == truth.keys() and all(abs(sharp[k] - truth[k]) < 0.05 * truth[k] for k in truth)
    fused = {(r["z"], r["y"], r["x"]): r["v"] for r in made[W.OPERATIONS["fusion"]].collect()}
    inner = [k for k in fused if all(0 < i < n - 1 for i, n in zip(k, (10, 8, 8), strict=True))]
    assert inner and all(abs(fused[k] - (truth[(0, *k)] + truth[(1, *k)]) / 2) <= 0.5 for k in inner)
    with pytest.raises(ValueError):
        W.run(spark, W.Workflow(("deconvolution",)), {"data": rows}, runners.RUNNERS)
