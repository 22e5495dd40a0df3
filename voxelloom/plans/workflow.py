"""Workflow plans: operations, their order, parameters and dependencies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from voxelloom.operators import ledger

#: Operations in canonical order and what they produce.
OPERATIONS = {
    "flatfield": "results/flatfield/latest/data",
    "deconvolution": "results/deconvolution/latest/data",
    "shear_transform": "results/shear_transform/latest/data",
    "particle_detection": "results/particle_detection/latest/detections",
    "usegment3d": "results/usegment3d/latest/data",
    "registration": "results/registration/latest",
    "fusion": "results/fusion/latest/data",
    "display_pyramid": "results/display_pyramid/latest",
    "visualization": "results/visualization/latest",
    "render_movie": "results/render_movie/latest",
    "compile_movie": "results/compile_movie/latest",
    "volume_export": "results/volume_export/latest",
    "mip_export": "results/mip_export/latest",
}
CHAINABLE = ("flatfield", "deconvolution", "shear_transform", "usegment3d", "fusion")
UNAVAILABLE = {
    "usegment3d": "a GPU segmentation model", "visualization": "a viewer", "render_movie": "a viewer", "compile_movie": "a video encoder",
}
COMMON = {"execution_order": None, "input_source": "data", "force_rerun": False}
#: Defaults that change results.
DEFAULTS = {
    "flatfield": {"overlap_zyx": (0, 32, 32), "fit_mode": "tiled", "tile_shape_yx": (256, 256), "blend_tiles": False},
    "deconvolution": {"iterations": 2, "background": 110, "wiener_alpha": 0.005},
    "shear_transform": {"shear_xy": 0.0, "shear_xz": 0.0, "shear_yz": 0.0, "interpolation": "linear", "fill_value": 0.0},
    "registration": {"registration_type": "translation", "overlap_zyx": (8, 32, 32), "max_pairwise_voxels": 500_000},
    "fusion": {"blend_mode": "feather", "blend_exponent": 1.0, "overlap_zyx": (8, 32, 32), "gain_clip_range": (0.25, 4.0)},
    "particle_detection": {"channel_index": 0, "bg_sigma": 20.0, "fwhm_px": 3.0, "threshold": 0.1, "overlap": 0.5},
    "display_pyramid": {"factors": (1, 2, 4, 8), "contrast": (1.0, 95.0), "sample_voxels": 2_000_000},
    "volume_export": {"export_scope": "current_selection", "resolution_level": 0},
    "mip_export": {"position_mode": "multi_position", "resample_z_to_lateral": True},
}


class UnavailableOperation(RuntimeError):
    """The operation needs something that is not part of this package."""


class DependencyError(ValueError):
    """An input is produced by nothing that runs before or exists."""


@dataclass(frozen=True)
class Workflow:
    """Selected operations with their parameters."""

    selected: tuple[str, ...]
    parameters: dict[str, dict] = field(default_factory=dict)

    def resolved(self, operation: str) -> dict:
        return COMMON | DEFAULTS.get(operation, {}) | self.parameters.get(operation, {})

    def sequence(self) -> list[str]:
        """By execution order, then by canonical place."""
        names = list(OPERATIONS)
        unknown = [o for o in self.selected if o not in OPERATIONS]
        if unknown:
            raise ValueError(f"unknown operations: {unknown}")

        def key(name: str):
            order = self.resolved(name)["execution_order"]
            return (names.index(name) + 1 if order is None else int(order), names.index(name))

        return sorted(set(self.selected), key=key)


def resolve_input(requested: str, produced: dict[str, str]) -> str:
    """Component of a reference: produced before, chainable, or literal."""
    if requested in produced:
        return produced[requested]
    if requested in CHAINABLE:
        return OPERATIONS[requested]
    return requested


def input_references(workflow: Workflow) -> list[tuple[str, str, str]]:
    """(operation, field, requested source) of the selection, layers of the viewer included."""
    out = []
    for operation in workflow.sequence():
        params = workflow.resolved(operation)
        out.append((operation, "input_source", str(params["input_source"]).strip() or "data"))
        for i, layer in enumerate(params.get("volume_layers") or [] if operation == "visualization" else []):
            component = str(layer.get("component", layer.get("source_component", ""))).strip() if isinstance(layer, dict) else ""
            if component:
                out.append((operation, f"volume_layers[{i}].component", component))
    return out


def volume_layers(rows: list[dict], levels: dict[str, int]) -> list[dict]:
    """Layers with their component and the levels they show.

    ``levels`` is the number of levels of each component that exists.  The
    policy of a layer is ``inherit`` (all levels there are), ``require`` (it
    must have more than one) or ``off`` (the first only).
    """
    out = []
    for row in rows:
        component, policy = str(row.get("component") or "data"), str(row.get("multiscale_policy") or "inherit")
        if component not in levels:
            raise DependencyError(f"{component} does not exist")
        if policy not in ("inherit", "require", "off"):
            raise ValueError(f"unknown policy {policy}")
        if policy == "require" and levels[component] < 2:
            raise DependencyError(f"{component} has one level only")
        shown = 1 if policy == "off" else levels[component]
        out.append({**row, "component": component, "multiscale_policy": policy, "levels": list(range(shown))})
    return out


def dependency_issues(workflow: Workflow, available: set[str]) -> list[tuple[str, str, str]]:
    """(operation, reference, reason) of every input that cannot be met."""
    issues, produced = [], {}
    sequence = workflow.sequence()
    for place, operation in enumerate(sequence):
        wanted = str(workflow.resolved(operation)["input_source"])
        if wanted == operation:
            issues.append((operation, wanted, "refers to itself"))
        elif wanted in sequence[place + 1 :]:
            issues.append((operation, wanted, "is produced later"))
        elif wanted in OPERATIONS and wanted not in CHAINABLE:
            issues.append((operation, wanted, "has no image output"))
        elif resolve_input(wanted, produced) not in available | set(produced.values()):
            issues.append((operation, wanted, "does not exist"))
        produced[operation] = OPERATIONS[operation]
    return issues


Runner = Callable[[SparkSession, dict[str, DataFrame], dict], DataFrame]


def run(spark: SparkSession, workflow: Workflow, tables: dict[str, DataFrame], runners: dict[str, Runner], history: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Runs the operations in order; outputs are keyed by component.

    ``history`` maps operation to the canonical parameters of its latest run;
    an operation that has run alike and whose output exists is skipped unless
    it is forced.
    """
    issues = dependency_issues(workflow, set(tables))
    if issues:
        raise DependencyError("; ".join(f"{o}: {r} {why}" for o, r, why in issues))
    out, produced = dict(tables), {}
    for operation in workflow.sequence():
        params = workflow.resolved(operation)
        same = (history or {}).get(operation) == ledger.canonical_json(ledger.comparable(params))
        if same and OPERATIONS[operation] in out and not params["force_rerun"]:
            produced[operation] = OPERATIONS[operation]
            continue
        if operation not in runners:
            raise UnavailableOperation(f"{operation} needs {UNAVAILABLE.get(operation, 'a registered runner')}")
        source = resolve_input(str(params["input_source"]), produced)
        out[OPERATIONS[operation]] = runners[operation](spark, {"input": out[source], **out}, params)
        produced[operation] = OPERATIONS[operation]
    return out
