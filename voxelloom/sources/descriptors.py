"""Experiment descriptors, sidecars and acquisition discovery."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File patterns by acquisition type.
PATTERNS = {"TIFF": "*.tif*", "H5": "*.h5", "N5": "*.n5", "ZARR": "*.zarr"}


@dataclass(frozen=True)
class Experiment:
    channels: tuple[str, ...]
    timepoints: int
    z_steps: int
    positions: int
    shape_yx: tuple[int, int]
    xy_um: float | None
    z_um: float | None
    file_type: str


def _mapping(text: str) -> dict:
    try:
        value = json.loads(text)
    except ValueError:
        import yaml

        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError("the descriptor is not a mapping")
    return value


def _number(value) -> float | None:
    found = re.search(r"\d+(?:\.\d+)?", str(value)) if value is not None else None
    return float(found.group()) if found and float(found.group()) > 0 else None


def parse_experiment(text: str, sidecar_rows: int | None = None) -> Experiment:
    """Selected channels by name, counts and spacings of a descriptor."""
    raw = _mapping(text)
    state, camera, saving = (raw.get(k) or {} for k in ("MicroscopeState", "CameraParameters", "Saving"))
    channels = tuple(sorted(n for n, c in (state.get("channels") or {}).items() if (c or {}).get("is_selected")))
    listed = raw.get("MultiPositions") or []
    if listed and isinstance(listed[0], list) and str((listed[0] or [""])[0]).upper() == "X":
        listed = listed[1:]
    positions = 1
    if state.get("is_multiposition"):
        positions = max(1, sidecar_rows if sidecar_rows is not None else len(listed))
    width, height = _number(camera.get("img_x_pixels")), _number(camera.get("img_y_pixels"))
    xy = None
    for fov, n in ((_number(camera.get("fov_x")), width), (_number(camera.get("fov_y")), height)):
        xy = xy or (fov / n if fov and n else None)
    pixel, zoom = _number(camera.get("pixel_size")), _number(state.get("zoom"))
    if xy is None and pixel and zoom:
        bins = [float(b) for b in re.findall(r"\d+", str(camera.get("binning", "1x1")))] or [1.0]
        xy = pixel / zoom * sum(bins) / len(bins)
    return Experiment(
        channels, int(state.get("timepoints") or 1), int(state.get("number_z_steps") or 1), positions,
        (int(height or 0), int(width or 0)), xy if xy is not None else pixel, _number(state.get("step_size")), str(saving.get("file_type") or "UNKNOWN").upper(),
    )


def setup_map(xml_text: str) -> dict[int, tuple[int, int]]:
    """View setup id to (position, channel) of a tile sidecar."""
    out = {}
    for setup in ET.fromstring(xml_text).iter("ViewSetup"):
        marks = setup.find("attributes")
        value = lambda name: int(marks.findtext(name, "0")) if marks is not None else 0
        out[int(setup.findtext("id", "0"))] = (value("tile"), value("channel"))
    return out


def block_datasets(spark: SparkSession, root: str) -> DataFrame:
    """(setup, timepoint, blocks) of setupN/timepointN/s0 with stored blocks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    hit = F.regexp_extract("path", r"/setup(\d+)/timepoint(\d+)/s0/\d", 1)
    t = F.regexp_extract("path", r"/setup(\d+)/timepoint(\d+)/s0/\d", 2)
    rows = files.where(hit != "").select(hit.cast("int").alias("setup"), t.cast("int").alias("timepoint"))
    return rows.groupBy("setup", "timepoint").agg(F.count(F.lit(1)).alias("blocks"))


def candidates(spark: SparkSession, folders: list[str], file_type: str) -> list[str]:
    """Files of the type in the folders, in their order; projections last."""
    seen, out = set(), []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        pattern = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{PATTERNS.get(file_type, '*')}")
        found = sorted(s.getPath().toString() for s in pattern.getFileSystem(conf).globStatus(pattern) or [])
        out += [f for f in found if not (f in seen or seen.add(f))]
    return sorted(out, key=lambda f: "mip" in f.rsplit("/", 1)[-1].lower())


def resolve(spark: SparkSession, folders: list[str], file_type: str) -> str:
    found = candidates(spark, folders, file_type)
    if not found:
        raise FileNotFoundError(f"no {file_type} acquisition in {folders}")
    return found[0]
