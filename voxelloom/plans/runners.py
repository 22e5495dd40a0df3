"""Runners that bind workflow operations to the operators."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions import parsing
from voxelloom.operators import detection, flatfield, fusion, kernels, projection, regions, registration, render, shear
from voxelloom.plans.workflow import OPERATIONS, Workflow
from voxelloom.sources import sinks
from voxelloom.sources.voxels import to_chunks, to_voxels

#: Fixed value: default chunk of a store.
CHUNK_ZYX = (256, 256, 256)


def _shape(voxels: DataFrame) -> dict[str, int]:
    row = voxels.agg(*[(F.max(a) + 1).alias(a) for a in "zyx"]).first()
    return {a: int(row[a] or 1) for a in "zyx"}


def run_flatfield(spark: SparkSession, tables: dict, params: dict) -> DataFrame:
    rows = tables["input"]
    return flatfield.apply_flatfield(rows, flatfield.mean_profile(rows))


def run_fusion(spark: SparkSession, tables: dict, params: dict) -> DataFrame:
    if params.get("affines"):
        return run_affine_fusion(spark, tables, params)
    rows, overlap = tables["input"], dict(zip("zyx", params["overlap_zyx"], strict=True))
    return fusion.fuse_translated(rows, tables["offsets"], _shape(rows), overlap, params["blend_mode"], params["blend_exponent"]).withColumn("p", F.lit(0))


def run_detection(spark: SparkSession, tables: dict, params: dict) -> DataFrame:
    rows = tables["input"]
    chosen = detection.DetectionParams(params["channel_index"], params["bg_sigma"], params["fwhm_px"], threshold=params["threshold"], overlap=params["overlap"])
    return detection.detect(rows, _shape(rows), {"z": 64, "y": 256, "x": 256}, chosen)


def run_pyramid(spark: SparkSession, tables: dict, params: dict) -> DataFrame:
    levels = None
    for i, f in enumerate(params["factors"]):
        level = regions.stride_level(tables["input"], {a: f for a in "zyx"}).withColumn("level", F.lit(i))
        levels = level if levels is None else levels.unionByName(level)
    return levels


def run_export(spark: SparkSession, tables: dict, params: dict) -> DataFrame:
    factor = 2 ** int(params["resolution_level"])
    return regions.stride_level(tables["input"], {a: factor for a in "zyx"})


def run_registration(spark: SparkSession, tables: dict, params: dict) -> DataFrame:
    """Needs the tables ``transforms`` and ``edges`` of the stage; voxel sizes are in x, y, z order."""
    anchor = int(tables["transforms"].agg(F.min("p").alias("p")).first()["p"])
    voxel = tuple(map(float, params.get("voxel_size_um_zyx", (1.0, 1.0, 1.0))))[::-1]
    rows = tables["input"].where(F.col("c") == int(params.get("registration_channel", 0)))
    return registration.register_tiles(rows, tables["edges"], tables["transforms"], voxel, anchor)


def run_shear(spark: SparkSession, tables: dict, params: dict) -> DataFrame:
    """Shear and rotation of every volume, tile by tile."""
    rows, voxel = tables["input"], tuple(map(float, params.get("voxel_size_um_zyx", (1.0, 1.0, 1.0))))
    shape = tuple(_shape(rows).values())
    chosen = shear.ShearParams(
        params["shear_xy"], params["shear_xz"], params["shear_yz"], tuple(params.get("rotation_deg_xyz", (0.0, 0.0, 0.0))),
        bool(params.get("auto_rotate", False)), params["fill_value"], order=0 if params["interpolation"] == "nearest" else 1,
    )
    return to_voxels(shear.transform(to_chunks(rows, CHUNK_ZYX), shape, voxel, chosen, CHUNK_ZYX))


def run_deconvolution(spark: SparkSession, tables: dict, params: dict) -> DataFrame:
    """Richardson-Lucy with the point spread function in the parameters."""
    if params.get("psf") is None:
        raise ValueError("deconvolution needs the parameter psf, an array in z, y, x")
    psf = kernels.normalize_psf(np.asarray(params["psf"], float))
    return to_voxels(registration.deconvolve(to_chunks(tables["input"], CHUNK_ZYX), psf, int(params["iterations"]), float(params["background"])))


def run_affine_fusion(spark: SparkSession, tables: dict, params: dict) -> DataFrame:
    """Fusion under the 4 x 4 matrices of the parameter ``affines`` (p to matrix)."""
    rows, voxel = tables["input"], tuple(map(float, params.get("voxel_size_um_zyx", (1.0, 1.0, 1.0))))
    affines = {int(p): np.asarray(m, float) for p, m in params["affines"].items()}
    chunks = to_chunks(rows, CHUNK_ZYX)
    fused = render.fuse(chunks, affines, tuple(_shape(rows).values()), voxel, CHUNK_ZYX, params["overlap_zyx"], params["blend_mode"], params["blend_exponent"])
    return to_voxels(fused)


def run_mip(spark: SparkSession, tables: dict, params: dict) -> DataFrame:
    return projection.all_projections(tables["input"])


RUNNERS = {
    "flatfield": run_flatfield, "fusion": run_fusion, "particle_detection": run_detection, "display_pyramid": run_pyramid,
    "volume_export": run_export, "mip_export": run_mip, "registration": run_registration, "shear_transform": run_shear,
    "deconvolution": run_deconvolution,
}


def parser() -> argparse.ArgumentParser:
    """Command line: one flag for each operation and what they share."""
    out = argparse.ArgumentParser("voxelloom")
    out.add_argument("--file", help="source image, collection or store")
    out.add_argument("--store", help="folder of the Parquet store; <file>.store by default")
    out.add_argument("--save-directory", help="folder for files that operations write; the store by default")
    out.add_argument("--master", help="Spark master")
    out.add_argument("--chunks", help='chunk sizes, "256" or "256,256,256"')
    out.add_argument("--stage-axis-map", help='world axes of the stage, "z=+x,y=none,x=+y"')
    out.add_argument("--input-resolution-level", type=int, help="level that segmentation reads")
    out.add_argument("--channel-indices", help='channels of segmentation, "0,2" or "all"')
    out.add_argument("--imaging-round", type=int, help="round of moving images")
    out.add_argument("--headless", action="store_true", help="accepted; there is no other mode")
    for name in OPERATIONS:
        short = ["-r"] if name == "registration" else []
        out.add_argument(*short, f"--{name.replace('_', '-')}", action="store_true")
    return out


def channel_choice(text: str | None) -> dict:
    """Parameters of a list of channels or of all; repeated ones count once."""
    parts = [p.strip() for p in (text or "").replace("\n", ",").split(",") if p.strip()]
    if not parts:
        return {}
    if len(parts) == 1 and parts[0].lower() in ("all", "*"):
        return {"all_channels": True}
    if not all(p.isdigit() for p in parts):
        raise ValueError(f"channels must be whole numbers or all: {text!r}")
    found = list(dict.fromkeys(int(p) for p in parts))
    return {"channel_indices": found, "channel_index": found[0]}


def workflow_of(args: argparse.Namespace) -> Workflow:
    """The selected operations with checked parameters."""
    own = channel_choice(args.channel_indices)
    if args.input_resolution_level is not None:
        if args.input_resolution_level < 0:
            raise ValueError("levels are 0 or more")
        own["input_resolution_level"] = args.input_resolution_level
    return Workflow(tuple(name for name in OPERATIONS if getattr(args, name)), {"usegment3d": own} if own else {})


def write_products(spark: SparkSession, folder: str, made: dict[str, DataFrame]) -> dict[str, int]:
    """Files beside the tables: projections as TIFF, detections as arrays; how many of each."""
    out = {}
    if OPERATIONS["mip_export"] in made:
        rows = made[OPERATIONS["mip_export"]]
        target = f"{folder}/{OPERATIONS['mip_export']}/files"
        sinks.reset_folder(spark, target)
        planes = rows.select("projection", "p", "t", "c", F.col("a").alias("y"), F.col("b").alias("x"), "v")
        out["projections"] = sinks.write_files(sinks.projection_files(planes, target, (0, 0))).count()
    if OPERATIONS["particle_detection"] in made:
        out["detections"] = sinks.save_detections(made[OPERATIONS["particle_detection"]], f"{folder}/{OPERATIONS['particle_detection']}_arrays", {})
    return out


def main(argv: list[str] | None = None) -> int:
    """Ingests the source, runs the operations, writes tables, files and the run's record."""
    from voxelloom.plans.run_ledger import RunLedger
    from voxelloom.plans.workflow import run
    from voxelloom.session import build_session
    from voxelloom.sources.formats import open_image
    from voxelloom.sources.stores import Store

    args = parser().parse_args(argv)
    if not args.file:
        parser().error("--file is needed")
    flow = workflow_of(args)
    parsing.parse_chunks(args.chunks)
    spark = build_session(master=args.master)
    root = args.store or f"{args.file}.store"
    store, book = Store(spark, root), RunLedger(spark, root)
    if args.stage_axis_map:
        store.put_metadata("calibration", parsing.parse_calibration(args.stage_axis_map))
    store.ingest(to_voxels(open_image(spark, args.file)))
    made = run(spark, flow, {"data": store.read("data")}, RUNNERS)
    for component, table in made.items():
        if component != "data":
            table.write.mode("overwrite").parquet(store.path(component))
    written = {c: spark.read.parquet(store.path(c)) for c in made if c != "data"}
    write_products(spark, args.save_directory or root, written)
    steps = [{"name": o, "parameters": flow.resolved(o)} for o in flow.sequence()]
    book.append({"file": args.file}, steps, {o: OPERATIONS[o] for o in flow.sequence()})
    return 0
