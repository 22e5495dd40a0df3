"""Queries over the Parquet tables, one for each operator family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelloom import functions as V
from voxelloom.operators import collections as C
from voxelloom.operators import (
    blocks, detection, flatfield, fusion, geometry, grids, keypoints, ledger, nearest, projection, regions, registration, render, segmentation, shear,
    statistics, stitching,
)
from voxelloom.sources import sinks
from voxelloom.sources.voxels import embedding_keys, embedding_voxels, table

#: Fixed value: boxes take their threshold from every 8th voxel.
BOX_STEP = 8
SHAPE = {"z": 10, "y": 8, "x": 8}
CHUNKS = {"z": 5, "y": 4, "x": 4}
CALIBRATION = {"z": "+z", "y": "-y", "x": "+x"}
VOXEL_XYZ = (0.5, 0.5, 1.0)
EXTENT_XYZ = (6.0, 4.0, 4.0)
TILE_OFFSETS = [(p, 0, 0, 6 * p) for p in range(5)]
OVERLAP = {"z": 2, "y": 2, "x": 2}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(name: str):
    return (F.round(F.col(name).cast("double"), 6) + F.lit(0.0)).alias(name)


def _stage(spark, sf_dir):
    """Stage rows: one tile per supplier on a zigzag line."""
    s = table(spark, sf_dir, "supplier")
    low = s.agg(F.min("s_suppkey").alias("low"))
    row = (F.col("s_suppkey") - F.col("low")).cast("int")
    rows = s.join(F.broadcast(low)).select(row.alias("row"))
    return rows.select(
        "row", (F.col("row") * 4.0).alias("x"), ((F.col("row") % 2) * 2.0).alias("y"), F.lit(0.0).alias("z"),
        ((F.col("row") % 3) * 5.0).alias("theta"),
    )


def _detections(spark, sf_dir):
    """Detections: events laid out by their time stamps."""
    e, ts = table(spark, sf_dir, "events"), F.col("ts")
    kinds = e.select("event_type").distinct().withColumn(
        "c", F.row_number().over(Window.orderBy("event_type")) - 1
    )
    return e.join(F.broadcast(kinds), "event_type").select(
        (F.dayofmonth(ts) - 1).cast("double").alias("t"), (F.col("user_id") % 5).cast("double").alias("p"),
        F.col("c").cast("double").alias("c"), F.hour(ts).cast("double").alias("z"), F.minute(ts).cast("double").alias("y"),
        F.second(ts).cast("double").alias("x"), (F.col("event_id") % 3 + 1).cast("double").alias("sigma"),
        F.col("value").alias("intensity"),
    )


def _runs(spark, sf_dir):
    """Run ledger: the orders of each customer in order of their key."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    rows = o.select(
        F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("run_id"), status.alias("status"),
        F.col("o_orderpriority").alias("parameters"), (F.col("o_orderkey") % 7 == 0).alias("skipped"),
    )
    return ledger.numbered(rows, ["store"], ["run_id"])


def _body():
    return ledger.record_text(F.col("store"), F.col("run_index"), F.col("run_id"), F.col("status"), F.col("parameters"))


# projections


@query
def mip_xy(spark, sf_dir):
    return projection.max_projection(embedding_voxels(spark, sf_dir), "xy")


@query
def mip_xz(spark, sf_dir):
    return projection.max_projection(embedding_voxels(spark, sf_dir), "xz")


@query
def mip_yz(spark, sf_dir):
    return projection.max_projection(embedding_voxels(spark, sf_dir), "yz")


@query
def mip_all_projections(spark, sf_dir):
    return projection.all_projections(embedding_voxels(spark, sf_dir))


@query
def mip_export_tasks(spark, sf_dir):
    return projection.export_tasks(embedding_voxels(spark, sf_dir))


@query
def mip_resample_z(spark, sf_dir):
    faces = projection.max_projection(embedding_voxels(spark, sf_dir), "xz")
    target = projection.resampled_length(10, 2.0, 1.0)
    return projection.resample_axis(faces, "z", ["t", "p", "c", "x"], 10, target)


@query
def canonical_projection(spark, sf_dir):
    from voxelloom.sources.voxels import canonical

    return canonical(embedding_voxels(spark, sf_dir).drop("c"), ["t", "p", "z", "y", "x"])


# levels, grids, regions


@query
def pyramid_l1(spark, sf_dir):
    return regions.stride_level(embedding_voxels(spark, sf_dir), {"z": 2, "y": 2, "x": 2})


@query
def pyramid_l2(spark, sf_dir):
    return regions.stride_level(pyramid_l1(spark, sf_dir), {"z": 2, "y": 2, "x": 2})


@query
def pyramid_chain_equals_direct(spark, sf_dir):
    keys = ["t", "p", "c", "z", "y", "x"]
    direct = regions.stride_level(embedding_voxels(spark, sf_dir), {"z": 4, "y": 4, "x": 4})
    both = direct.join(pyramid_l2(spark, sf_dir).withColumnRenamed("v", "chained"), keys, "full_outer")
    return both.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("v").eqNullSafe(F.col("chained")), 0).otherwise(1)).alias("different")
    )


@query
def chunk_grid(spark, sf_dir):
    return regions.chunk_grid(spark, SHAPE, {"z": 4, "y": 3, "x": 5})


@query
def halo_expand(spark, sf_dir):
    return regions.expand_halo(regions.chunk_grid(spark, SHAPE, CHUNKS), SHAPE, {"z": 1, "y": 2, "x": 2})


@query
def halo_replicate(spark, sf_dir):
    spread = regions.replicate_to_chunks(embedding_voxels(spark, sf_dir), SHAPE, CHUNKS, {"y": 1, "x": 1})
    return spread.groupBy("t", "p", "c", "z_chunk", "y_chunk", "x_chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))


@query
def core_mask(spark, sf_dir):
    return regions.core_mask(_detections(spark, sf_dir), {"z": (4, 12), "y": (0, 30), "x": (10, 50)})


@query
def median_border(spark, sf_dir):
    return regions.median_border(embedding_voxels(spark, sf_dir), SHAPE, ["t", "p", "c"])


@query
def zero_mask(spark, sf_dir):
    v = embedding_voxels(spark, sf_dir)
    return v.select("t", "p", "c", "z", "y", "x", (F.col("v") - 2000 > 0).cast("double").alias("mask"))


@query
def grow_and_merge_boxes(spark, sf_dir):
    v = embedding_voxels(spark, sf_dir)
    boxes = statistics.minimal_box(v, statistics.otsu_thresholds(v, ["t", "c"], BOX_STEP), ["t", "c"])
    return regions.merge_boxes(regions.grow_box(boxes, SHAPE, 1), ["c"])


@query
def crop_common_box(spark, sf_dir):
    """Every two volumes that follow in time are cropped to the box around the foreground of both."""
    v = embedding_voxels(spark, sf_dir)
    boxes = statistics.minimal_box(v, statistics.otsu_thresholds(v, ["t", "p", "c"], BOX_STEP), ["t", "p", "c"])
    pair = F.floor(F.col("t") / 2).alias("pair")
    merged = regions.merge_boxes(boxes.select("*", pair), ["pair", "p", "c"])
    return regions.crop_to_boxes(v.select("*", pair), merged, ["pair", "p", "c"]).drop("pair")


@query
def voxel_budget_stride(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey"), (F.col("p_size") * 10).alias("nz"), (F.col("p_size") * 20).alias("ny"), (F.col("p_size") * 30).alias("nx"),
        (F.col("p_partkey") % 7 + 1).cast("int").alias("nt"), (F.col("p_partkey") % 5 + 1).cast("int").alias("np"),
    )
    return regions.budget_stride(p, 2_000_000)


@query
def display_level_pick(spark, sf_dir):
    v = embedding_voxels(spark, sf_dir)
    sizes = [v.agg(F.count(F.lit(1)).alias("voxels"))]
    for f in (2, 4, 8):
        sizes.append(regions.stride_level(v, {"z": f, "y": f, "x": f}).agg(F.count(F.lit(1)).alias("voxels")))
    levels = None
    for i, s in enumerate(sizes):
        row = s.select(F.lit(i).alias("level"), "voxels")
        levels = row if levels is None else levels.unionByName(row)
    return regions.display_level(levels, 5000)


# flat field


@query
def flatfield_apply(spark, sf_dir):
    v = embedding_voxels(spark, sf_dir)
    return flatfield.apply_flatfield(v, flatfield.mean_profile(v)).withColumn("v", r6("v"))


@query
def flatfield_apply_timelapse(spark, sf_dir):
    v = embedding_voxels(spark, sf_dir)
    return flatfield.apply_flatfield(v, flatfield.mean_profile(v), flatfield.baseline_profile(v)).withColumn("v", r6("v"))


@query
def flatfield_feather(spark, sf_dir):
    rows = [(i, w) for i, w in enumerate(flatfield.feather_weights(12, 3, 9))]
    return spark.createDataFrame(rows, "i int, w double").select("i", r6("w"))


# statistics


@query
def otsu_threshold(spark, sf_dir):
    return statistics.otsu_thresholds(embedding_voxels(spark, sf_dir), ["c"])


@query
def noise_normalized(spark, sf_dir):
    v = embedding_voxels(spark, sf_dir)
    return statistics.noise_normalized(v, statistics.otsu_thresholds(v, ["c"]), ["c"]).withColumn("v", r6("v"))


@query
def bbox_minimal(spark, sf_dir):
    v = embedding_voxels(spark, sf_dir)
    return statistics.minimal_box(v, statistics.otsu_thresholds(v, ["c"], BOX_STEP), ["c"])


@query
def bbox_robust(spark, sf_dir):
    v = embedding_voxels(spark, sf_dir)
    return statistics.robust_box(v, statistics.otsu_thresholds(v, ["c"], BOX_STEP), ["c"], 5.0, 95.0)


@query
def contrast_limits(spark, sf_dir):
    coarse = regions.stride_level(embedding_voxels(spark, sf_dir), {"z": 2, "y": 2, "x": 2})
    return statistics.contrast_limits(coarse).select("c", r6("low"), r6("high"))


def _tile_pairs(spark, sf_dir):
    """Every tile against the next one."""
    v = embedding_voxels(spark, sf_dir)
    keys = ["t", "p", "c", "z", "y", "x"]
    moving = v.select("t", (F.col("p") - 1).alias("p"), "c", "z", "y", "x", F.col("v").alias("moving"))
    return v.select(*keys, F.col("v").alias("fixed")).join(moving, keys)


@query
def intensity_fit(spark, sf_dir):
    fit = statistics.intensity_fit(_tile_pairs(spark, sf_dir), ["c"])
    return fit.select("c", "ok", r6("gain"), F.round("offset", 3).alias("offset"), "n")


@query
def intensity_percentile_gain(spark, sf_dir):
    fit = statistics.percentile_gain(_tile_pairs(spark, sf_dir), ["c"])
    return fit.select("c", r6("gain"), r6("offset"), "n")


@query
def intensity_compare_ks(spark, sf_dir):
    """Tiles of even against tiles of odd number."""
    v = embedding_voxels(spark, sf_dir)
    found = statistics.compare_distributions(v.select("c", "v", (F.col("p") % 2).alias("side")), ["c"])
    return found.select("c", r6("ks_d"), r6("wasserstein"))


@query
def significance_filter(spark, sf_dir):
    v = embedding_voxels(spark, sf_dir)
    points = v.where("v > 2200").select("t", "p", "c", *[(F.col(a) + 0.6).alias(a) for a in "zyx"])
    return statistics.significant(points, v, ["t", "p", "c"]).select("t", "p", "c", "z", "y", "x", "value")


@query
def centroid_weighted(spark, sf_dir):
    v = embedding_voxels(spark, sf_dir)
    points = v.where("v > 2300").select("t", "p", "c", "z", "y", "x")
    found = statistics.weighted_centroids(points, v, ["t", "p", "c", "z"], 2)
    return found.select("t", "p", "c", "z", "y", "x", r6("cy"), r6("cx"))


@query
def residual_summary(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_type", F.sqrt(F.col("value") * F.col("value") + 1).alias("d"))
    return statistics.residual_summary(d, ["event_type"]).select("event_type", r6("rms"), r6("median"), r6("p95"), "n")


@query
def warp_summary(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.col("l_discount").alias("dz"), F.col("l_tax").alias("dy"), (F.col("l_quantity") / 50).alias("dx")
    )
    s = statistics.displacement_summary(d, ["l_returnflag"])
    return s.select("l_returnflag", *[r6(c) for c in ("mean", "min", "std", "max")], "n")


@query
def intensity_histogram(spark, sf_dir):
    return statistics.histogram(embedding_voxels(spark, sf_dir), ["c"], 16)


# scalar functions


@query
def safe_cast_u16(spark, sf_dir):
    v = embedding_voxels(spark, sf_dir)
    return v.select("t", "p", "c", "z", "y", "x", projection.clip_uint16((F.col("v") - 2000) * 300.5).alias("v"))


@query
def truncate_cast_u16(spark, sf_dir):
    v = embedding_voxels(spark, sf_dir)
    cut = V.truncate_uint16((F.col("v") - 1900) / 250.0, F.lit(0.0), F.lit(1000.0))
    return v.select("t", "p", "c", "z", "y", "x", cut.alias("v"))


@query
def scalar_functions(spark, sf_dir):
    e, v = table(spark, sf_dir, "events"), F.col("value")
    x = e.select(
        "event_id", V.fwhm_to_sigma(v).alias("sigma"), V.gaussian(v, F.lit(2.0), F.lit(10.0), F.lit(7.5), F.lit(0.5)).alias("model"),
        V.ease(v / 50).alias("eased"), V.interpolate(F.lit(3.0), v, F.lit(0.25)).alias("between"),
    )
    return x.select("event_id", *[r6(c) for c in ("sigma", "model", "eased", "between")])


@query
def rotation_shear_matrix(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    deg = [F.col("s_suppkey") * k % 90 + F.lit(0.0) for k in (3, 5, 7)]
    m = geometry.shear_rotation(geometry.rotation_xyz(*deg), F.lit(0.1), F.lit(0.2), F.lit(0.3))
    cells = [(F.round(m[i][j], 6) + 0.0).alias(f"m{i}{j}") for i in range(3) for j in range(3)]
    return s.select("s_suppkey", *cells)


@query
def parse_texts(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    zoom = F.concat(F.lit("zoom "), (k / 4 + 0.5).cast("string"), F.lit("x"))
    bins = V.binning(F.concat((k % 3 + 1).cast("string"), F.lit("x"), (k % 4 + 1).cast("string")))
    chunks = V.chunk_sizes(F.concat(F.lit("1, "), (k + 1).cast("string"), F.lit(",256")))
    binding = V.calibration(F.lit("z=+x, y=none, x=+Y"))
    return n.select(
        "n_nationkey", r6_of(V.zoom_factor(zoom), "zoom"), bins["x"].cast("int").alias("bin_x"), bins["y"].cast("int").alias("bin_y"),
        F.element_at(chunks, 2).alias("chunk"), F.element_at(binding, F.lit("x")).alias("x_axis"), F.element_at(binding, F.lit("y")).alias("y_axis"),
        V.axis_token(F.element_at(F.array(*[F.lit(t) for t in ("Time", "channel", "series", "zoom")]), (k % 4 + 1).cast("int"))).alias("axis"),
        V.file_type(F.element_at(F.array(*[F.lit(t) for t in ("OME-TIFF", ".h5", "n5", "raw")]), (k % 4 + 1).cast("int"))).alias("kind"),
    )


def r6_of(column, name):
    return (F.round(column, 6) + F.lit(0.0)).alias(name)


# geometry


@query
def stage_translations(spark, sf_dir):
    stage = _stage(spark, sf_dir)
    positions = stage.select(F.col("row").alias("p")).unionByName(stage.select((F.col("row") + 1000).alias("p")))
    found = geometry.stage_translations(positions, stage, {"z": "+x", "y": "-y", "x": "none"})
    return found.select("p", *[r6(f"world_{a}") for a in "zyx"])


@query
def anchor_position(spark, sf_dir):
    return geometry.anchor_position(_stage(spark, sf_dir))


def _transforms(spark, sf_dir):
    return geometry.nominal_transforms(_stage(spark, sf_dir), 0, CALIBRATION)


@query
def nominal_transforms(spark, sf_dir):
    return _transforms(spark, sf_dir).select("p", *[r6(f"m{i}{j}") for i in range(3) for j in range(4)])


@query
def tile_bboxes(spark, sf_dir):
    boxes = geometry.tile_boxes(_transforms(spark, sf_dir), EXTENT_XYZ)
    return boxes.select("p", *[r6(f"{s}_{a}") for a in "xyz" for s in ("min", "max")])


def _edges(spark, sf_dir):
    boxes = tile_bboxes(spark, sf_dir)
    return geometry.overlap_edges(boxes, VOXEL_XYZ)


@query
def edge_specs(spark, sf_dir):
    return _edges(spark, sf_dir).select("fixed", "moving", *[r6(f"{s}_{a}") for a in "xyz" for s in ("min", "max")], "overlap_voxels")


@query
def overlap_crops(spark, sf_dir):
    crops = geometry.crop_regions(edge_specs(spark, sf_dir), VOXEL_XYZ, (2, 2, 1))
    return crops.select("fixed", "moving", *[x for a in "xyz" for x in (r6(f"min_{a}"), f"size_{a}")])


@query
def connected_tiles(spark, sf_dir):
    edges = _edges(spark, sf_dir).where("fixed % 4 <> 3")
    return geometry.connected_positions(edges, _stage(spark, sf_dir).select(F.col("row").alias("p")))


@query
def mutual_nn(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 101 + F.col("c_acctbal") / 1e4).alias("r"),
        (F.col("c_custkey") * 53 % 97 + F.lit(0.0)).alias("c"),
    )
    fixed, moving = c.where("id % 2 = 0"), c.where("id % 2 = 1")
    return nearest.mutual_nearest(fixed, moving, 3.0).select("moving", "fixed", r6("d"))


@query
def chunk_tile_overlap(spark, sf_dir):
    boxes = tile_bboxes(spark, sf_dir)
    grid = spark.range(0, 40).select((F.col("id") * 5.0 - 3).alias("chunk_min_x"), (F.col("id") * 5.0 + 2).alias("chunk_max_x"))
    grid = grid.withColumns({"chunk_min_y": F.lit(-4.0), "chunk_max_y": F.lit(2.0), "chunk_min_z": F.lit(0.0), "chunk_max_z": F.lit(9.0)})
    return fusion.chunk_tile_pairs(grid, boxes).select("chunk_min_x", "p")


# fusion


@query
def blend_profiles(spark, sf_dir):
    table_ = fusion.profile_table(spark, {"z": 10, "y": 8, "x": 12}, {"z": 3, "y": 9, "x": 4}, "center_weighted")
    return table_.select("axis", "i", r6("w"))


def _offsets(spark):
    return spark.createDataFrame(TILE_OFFSETS, "p int, oz int, oy int, ox int")


@query
def fuse_translation_average(spark, sf_dir):
    return fusion.fuse_translated(embedding_voxels(spark, sf_dir), _offsets(spark), SHAPE, OVERLAP, "average")


@query
def fuse_translation_feather(spark, sf_dir):
    return fusion.fuse_translated(embedding_voxels(spark, sf_dir), _offsets(spark), SHAPE, {"x": 2}, "feather")


@query
def gain_apply(spark, sf_dir):
    v = embedding_voxels(spark, sf_dir)
    gains = v.groupBy("t", "p").agg((F.lit(2000.0) / F.avg("v")).alias("gain"), F.lit(1.5).alias("offset"))
    return fusion.apply_gains(v, gains).withColumn("v", r6("v"))


# detection


@query
def detection_table(spark, sf_dir):
    return _detections(spark, sf_dir)


@query
def detection_sort(spark, sf_dir):
    rows = _detections(spark, sf_dir).withColumn(
        "place", F.row_number().over(Window.partitionBy("t", "p").orderBy("z", "y", "x", "c", "sigma", "intensity"))
    )
    return rows.select("t", "p", "place", "z", "y", "x", "c", "sigma", "intensity")


@query
def real_tracks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 50).alias("track"), F.col("event_id").alias("t"), F.lit(0.0).alias("z"),
        F.when(F.col("event_id") % 3 == 0, -0.5).otherwise(F.col("value")).alias("y"), F.when(F.col("event_id") % 6 == 0, -0.5).otherwise(1.0).alias("x"),
    )
    return detection.real_tracks(e, planar=True)


@query
def particle_detect(spark, sf_dir):
    params = detection.DetectionParams(fwhm_px=3.0, threshold=0.02, border=0, halo=4, bg_sigma=3.0)
    return detection.detect(embedding_voxels(spark, sf_dir), SHAPE, {"z": 10, "y": 8, "x": 4}, params)


# registration


def _moved(v, dy: int, dx: int):
    """The volumes shifted on a ring."""
    return v.withColumns({"y": F.pmod(F.col("y") + dy, F.lit(8)), "x": F.pmod(F.col("x") + dx, F.lit(8))})


@query
def phase_correlation(spark, sf_dir):
    """Every volume against itself, moved by 2 rows and 5 columns on a ring."""
    v = embedding_voxels(spark, sf_dir)
    keys = ["t", "p", "c", "z", "y", "x"]
    pairs = v.withColumnRenamed("v", "fixed").join(_moved(v, 2, 5).withColumnRenamed("v", "moving"), keys)
    pairs = pairs.withColumn("edge", ((F.col("t") * 5 + F.col("p")) * 2 + F.col("c")).cast("long"))
    return registration.pairwise_shifts(pairs.select("edge", "z", "y", "x", "fixed", "moving"), 1)


@query
def solve_translation(spark, sf_dir):
    """Positions of three moved copies of every volume, from shifts measured on their pixels."""
    v = embedding_voxels(spark, sf_dir)
    copies = [_moved(v, k, -k).withColumn("copy", F.lit(k)) for k in range(3)]
    keys = ["t", "p", "c", "z", "y", "x"]
    pairs = None
    for a, b in ((0, 1), (1, 2), (0, 2)):
        both = copies[a].select(*keys, F.col("v").alias("fixed")).join(copies[b].select(*keys, F.col("v").alias("moving")), keys)
        both = both.withColumn("edge", (((F.col("t") * 5 + F.col("p")) * 2 + F.col("c")) * 9 + a * 3 + b).cast("long"))
        pairs = both if pairs is None else pairs.unionByName(both)
    shifts = registration.pairwise_shifts(pairs.select("edge", "z", "y", "x", "fixed", "moving"), 1)
    shifts = shifts.withColumn("volume", F.floor(F.col("edge") / 9).cast("long"))

    def solve(pdf):
        import numpy as np
        import pandas as pd

        edges = [
            {"fixed": int(e) % 9 // 3, "moving": int(e) % 3, "shift": np.array([dx, dy, dz]), "overlap_voxels": 640}
            for e, dz, dy, dx in zip(pdf["edge"], pdf["dz"], pdf["dy"], pdf["dx"], strict=True)
        ]
        found, _, _ = registration.solve_with_pruning([0, 1, 2], sorted(edges, key=lambda e: (e["fixed"], e["moving"])), 0)
        rows = [(int(pdf["volume"].iloc[0]), k, *[round(float(x), 6) + 0.0 for x in at]) for k, at in found.items()]
        return pd.DataFrame(rows, columns=["volume", "copy", "x", "y", "z"])

    return shifts.groupBy("volume").applyInPandas(solve, "volume long, copy int, x double, y double, z double")


@query
def affine_resample(spark, sf_dir):
    import numpy as np
    import pandas as pd

    from voxelloom.operators import kernels
    from voxelloom.sources.voxels import CHUNK_FIELDS, block_of, to_chunks, to_voxels

    def run(parts):
        for pdf in parts:
            out = []
            for _, row in pdf.iterrows():
                moved = kernels.affine_resample(block_of(row), np.eye(3), np.array([0.0, 0.5, 0.0]), (10, 7, 8))
                out.append(row.to_dict() | {"ny": 7, "dtype": "float64", "payload": moved.tobytes()})
            yield pd.DataFrame(out)

    chunks = to_chunks(embedding_voxels(spark, sf_dir), (10, 8, 8), "float64")
    return to_voxels(chunks.mapInPandas(run, CHUNK_FIELDS)).withColumn("v", r6("v"))


@query
def envelope_tilt(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 40).cast("int").alias("y"), (F.col("l_orderkey") % 40 / 2 + F.col("l_linenumber")).cast("int").alias("z"),
        (F.col("l_quantity") + 10).alias("v"),
    )
    faces = v.groupBy("z", "y").agg(F.max("v").alias("v"))
    return registration.envelope_tilt(faces, 1.0, 0.5, 0.1).select(r6("tilt_deg"))


# ledger and audit


@query
def provenance_chain(spark, sf_dir):
    return ledger.link_hashes(_runs(spark, sf_dir), ["store"], _body()).select("store", "run_index", "run_id", "prev_hash", "self_hash")


@query
def provenance_verify(spark, sf_dir):
    """Every 97th record is altered after it was chained; all breaks are found."""
    chained = ledger.link_hashes(_runs(spark, sf_dir), ["store"], _body())
    altered = chained.withColumn("status", F.when(F.col("run_id") % 97 == 0, "altered").otherwise(F.col("status")))
    altered = altered.withColumn("prev_hash", F.when(F.col("run_id") % 89 == 0, "0").otherwise(F.col("prev_hash")))
    return ledger.verify_links(altered, ["store"], _body())


@query
def provenance_latest(spark, sf_dir):
    return ledger.latest_completed(_runs(spark, sf_dir), ["store"]).select("store", "run_index", "run_id", "parameters")


@query
def provenance_match(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("store"), F.lit("1-URGENT").alias("parameters"))
    return ledger.matching_runs(runs, wanted, ["store"])


@query
def audit_sequence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return ledger.sequenced(e, "user_id", ["ts", "event_id"]).select("event_id", "user_id", "sequence")


@query
def audit_redact(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    payload = F.concat(F.lit('{"token": "'), F.col("event_id").cast("string"), F.lit('", "props": '), F.col("props"), F.lit(', "a": [{"Password": 1}]}'))
    return e.select("event_id", ledger.redact_json(payload).alias("payload"))


@query
def audit_latest_reference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("operation"), F.col("o_orderdate").alias("updated"), F.col("o_orderkey").alias("component")
    )
    return ledger.latest_references(o).select("operation", "component")


@query
def dependency_antijoin(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("component"), "l_linenumber")
    have = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("component"))
    return refs.join(have, "component", "left_anti")


# settings and small tables


@query
def setting_functions(spark, sf_dir):
    """Vector interpolation, channel lists, first values present, casts and pixel sizes."""
    p = table(spark, sf_dir, "part").withColumn("s", F.col("p_size").cast("double"))
    key, size = F.col("p_partkey"), F.col("s")
    vector = V.interpolate_vector(F.array(size, key.cast("double")), F.array(key.cast("double"), F.lit(0.0)), F.lit(0.25))
    value, source = V.first_present(("a", F.when(key % 3 == 0, size)), ("b", F.when(key % 3 == 1, size + 1)), ("c", F.lit(1.0)))
    pixel = V.pixel_size_um(F.when(key % 2 == 0, size), F.lit(100.0), F.when(key % 5 == 0, size + 1), F.lit(50.0), F.lit(6.5), size, F.lit(2.0))
    return p.select(
        "p_partkey", F.round(vector[0], 6).alias("v0"), F.round(vector[1], 6).alias("v1"),
        F.coalesce(V.broadcast_channel(F.when(key % 2 == 0, F.array(F.lit(7))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3))), (key % 4).cast("int")), F.lit(-1)).alias("channel"),
        value.alias("value"), source.alias("source"), V.clip_to_dtype(size * 1000 - 10000.5, 0, 32767).alias("cast"), F.round(pixel, 6).alias("pixel"),
    )


@query
def array_tiles(spark, sf_dir):
    """The tiles of a volume as large as the voxels."""
    n = embedding_voxels(spark, sf_dir).agg(*[(F.max(a) + 1).alias(a) for a in "zyx"]).first()
    return grids.tile_table(spark, {a: n[a] for a in "zyx"}, {"z": 4, "y": 3, "x": 5})


@query
def registration_grid(spark, sf_dir):
    """Chunks of widths 10 to 59 with their last start at the end."""
    rows = [(n, i, s) for n in range(10, 60) for i, s in enumerate(grids.chunk_starts(n, 8, 2))]
    return spark.createDataFrame(rows, "size int, chunk int, start int")


@query
def extended_levels(spark, sf_dir):
    rows = [(i, *f) for i, f in enumerate(grids.extend_factors([(1, 1, 1, 1, 1, 1), (1, 1, 1, 1, 2, 2)], 5))]
    return spark.createDataFrame(rows, "level int, t int, p int, c int, z int, y int, x int")


@query
def pairwise_budget(spark, sf_dir):
    """Whole factors that bring grids of the parts' sizes below a budget."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size").collect()  # one small table, a plain function
    rows = [(r["p_partkey"], grids.downsample_factor((r["p_size"] * 10, r["p_size"] * 20, r["p_size"] * 30), 500_000)) for r in p]
    return spark.createDataFrame(rows, "p_partkey long, factor int")


@query
def detection_by_intensity(spark, sf_dir):
    """Place of every detection, the brightest first, within its time and position."""
    rows = _detections(spark, sf_dir)
    order = Window.partitionBy("t", "p").orderBy(F.desc("intensity"), "z", "y", "x", "c", "sigma")
    return rows.withColumn("place", F.row_number().over(order))


@query
def event_log_manifest(spark, sf_dir):
    """Events and bytes of a log with blank lines."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 0, "  ").otherwise(F.col("props")).alias("value"))
    return ledger.manifest(e).select("event_count", "bytes")


@query
def residual_of_edges(spark, sf_dir):
    """How far predicted shifts lie from measured ones, in mean voxels."""
    l = table(spark, sf_dir, "lineitem")
    gap = F.sqrt(sum((F.col(c).cast("double") ** 2 for c in ("l_quantity", "l_discount", "l_tax")), F.lit(0.0)))
    return l.select("l_orderkey", "l_linenumber", F.round(gap / ((0.5 + 0.5 + 1.0) / 3), 6).alias("residual"))


# chunk forms, tiles and tables


def _chunks(spark, sf_dir, size=(5, 8, 4)):
    from voxelloom.sources.voxels import to_chunks

    return to_chunks(embedding_voxels(spark, sf_dir), size, "uint16")


def _plane(spark, sf_dir, axis):
    from voxelloom.sources.voxels import to_voxels

    return to_voxels(blocks.max_planes(_chunks(spark, sf_dir), axis)).withColumn("v", F.col("v").cast("int")).drop(axis)


@query
def chunk_mip_xy(spark, sf_dir):
    return _plane(spark, sf_dir, "z")


@query
def chunk_mip_xz(spark, sf_dir):
    return _plane(spark, sf_dir, "y")


@query
def chunk_mip_yz(spark, sf_dir):
    return _plane(spark, sf_dir, "x")


@query
def chunk_stride(spark, sf_dir):
    from voxelloom.sources.voxels import to_voxels

    return to_voxels(blocks.stride(_chunks(spark, sf_dir), {"z": 3, "y": 2, "x": 4})).withColumn("v", F.col("v").cast("int"))


@query
def chunk_histogram(spark, sf_dir):
    return blocks.histogram(_chunks(spark, sf_dir), 1000, 3000, 20, ("c",))


@query
def chunk_fuse_feather(spark, sf_dir):
    """The fused volume without the voxels on which no tile has weight."""
    from voxelloom.sources.voxels import to_voxels

    weights = tuple(fusion.blend_profile(SHAPE[a], {"z": 0, "y": 0, "x": 2}[a]) for a in "zyx")
    fused = blocks.fuse(_chunks(spark, sf_dir), {o[0]: o[1:] for o in TILE_OFFSETS}, (10, 8, 8), (4, 8, 16), weights)
    return to_voxels(fused).where("v > 0").select("t", "c", "z", "y", "x", F.col("v").cast("int").alias("v"))


@query
def fit_tiles(spark, sf_dir):
    """Core and read bounds of profile tiles for each (p, c) of the voxels."""
    n = embedding_voxels(spark, sf_dir).agg(*[(F.max(a) + 1).alias(a) for a in "pcyx"]).first()
    return grids.halo_tiles(spark, {"y": n["y"], "x": n["x"]}, {"y": 3, "x": 5}, {"y": 1, "x": 2}, {"p": n["p"], "c": n["c"]})


@query
def transform_tiles(spark, sf_dir):
    """Tiles of full depth for each (t, p, c) of the voxels."""
    return grids.transform_table(embedding_keys(spark, sf_dir), SHAPE, {"y": 4, "x": 5})


@query
def tile_weight_products(spark, sf_dir):
    rows = flatfield.tile_weights((7, 5), ((2, 5), (1, 4)))
    cells = [(y, x, w) for y, line in enumerate(rows) for x, w in enumerate(line)]
    return spark.createDataFrame(cells, "y int, x int, w double").select("y", "x", r6("w"))


@query
def particle_overlay(spark, sf_dir):
    return keypoints.overlay(_detections(spark, sf_dir), 2)


@query
def detection_rows(spark, sf_dir):
    return sinks.detection_chunks(_detections(spark, sf_dir))


# acquisition files and movies


def _paths(spark, sf_dir):
    keys = embedding_voxels(spark, sf_dir).select("t", "p", "c").distinct()
    return keys.select(F.format_string("/data/Position%d/CH%02d_%06d.tiff", "p", "c", "t").alias("path"), "t", "p", "c")


@query
def tiff_name_parse(spark, sf_dir):
    return C.index_files(_paths(spark, sf_dir).select("path"))


@query
def collection_completeness(spark, sf_dir):
    files = _paths(spark, sf_dir).where("NOT (p = 2 AND t % 3 = 1) AND NOT (p = 4 AND c = 1 AND t = 0)")
    return C.missing_keys(C.index_files(files.select("path")))


@query
def h5_sort(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(
        F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).otherwise(F.format_string("CH%02d_%06d.h5", F.col("n_nationkey") % 3, F.col("n_nationkey") * 7 % 11)).alias("name")
    )
    return n.select("name", F.row_number().over(Window.orderBy(*V.h5_sort_keys(F.col("name")))).alias("place"))


@query
def frame_specs(spark, sf_dir):
    k = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("keyframe"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") % 4).alias("gap")
    )
    return C.frame_specs(k, 2, 5).select("frame", "start", "end", r6("alpha"))


@query
def frame_gaps(spark, sf_dir):
    f = table(spark, sf_dir, "orders").where("o_orderkey % 13 <> 5").select(F.format_string("/f/frame_%06d.png", F.col("o_orderkey") % 1000000).alias("path")).distinct()
    return C.frame_gaps(f)


# volumes and stitching


@query
def mutual_information(spark, sf_dir):
    found = segmentation.mutual_information(_tile_pairs(spark, sf_dir), ["c"], 16)
    return found.select("c", r6("mutual_information"), r6("correlation"))


@query
def shear_transform(spark, sf_dir):
    from voxelloom.sources.voxels import to_chunks, to_voxels

    chunks = to_chunks(embedding_voxels(spark, sf_dir), (5, 8, 8), "float32")
    out = shear.transform(chunks, (10, 8, 8), (2.0, 1.0, 1.0), shear.ShearParams(shear_xz=0.25), (10, 8, 8))
    return to_voxels(out).withColumn("v", F.round("v", 3))


@query
def fuse_affine(spark, sf_dir):
    import numpy as np

    from voxelloom.sources.voxels import to_chunks, to_voxels

    affines = {}
    for p in range(5):
        affines[p] = np.eye(4)
        affines[p][:2, 3] = 6.0 * p + 0.5, 0.25 * p
    chunks = to_chunks(embedding_voxels(spark, sf_dir), (10, 8, 8), "float32")
    return to_voxels(render.fuse(chunks, affines, (10, 8, 8), (1.0, 1.0, 1.0), (10, 9, 16), (0, 2, 2)))


@query
def stitch_tiles(spark, sf_dir):
    pixels = projection.max_projection(embedding_voxels(spark, sf_dir), "xy")
    layout = stitching.canvas((8, 8), 5, 0.25, 0.25)
    offsets = spark.createDataFrame([(p, layout.margin, layout.origin(p)) for p in range(5)], "p int, oy int, ox int")
    return stitching.stitch(pixels, offsets, (8, 8), 5, 0.25)


@query
def tile_name_parse(spark, sf_dir):
    keys = embedding_voxels(spark, sf_dir).select("t", "p", "c").distinct()
    paths = keys.select(F.format_string("/m/mip_xz_p%04d_t%04d_c%04d.tif", "p", "t", "c").alias("path"))
    return stitching.grouped(stitching.discover(paths))
