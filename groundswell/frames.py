"""Parameters of frames: nested defaults, a versioned table of what single frames override, and their checks."""

from __future__ import annotations

import copy
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

Params = dict[str, Any]

#: What holds where neither table nor caller says otherwise. Groups are keys of the first level.
DEFAULTS: Params = {
    "calibration_options": {
        "grid_type": "constant",
        "reference_frame": "IGS20",
        "window_size_meters": 30_000.0,
        "posting_meters": 30.0,
        "downsample_factor": 1,
        "unwrap_error_correction": False,
        "apply_tropo_correction": True,
        "apply_solid_earth_tide_correction": True,
        "surface": {"method": "windowed_plane", "cutoff_wavelength_meters": 50_000.0, "two_pass": False, "regions": "none"},
        "weights": {"coherence_power": 0.0, "robust": False, "filled_pixel_weight": 0.02},
        "tropo": {"mode": "legacy", "relief_off_meters": 300.0, "relief_stratified_meters": 1500.0},
        "gnss": {"buffer_meters": 0.0, "exclude_defo_nodes": False, "reprocessing": False},
        "uncertainty": {"k_grid": 1.0, "inflate_inside_areas": True, "extrapolate_sigma": False},
        "unwrap": {"gnss_veto": True, "min_region_area": 20, "anchor_distance_meters": 12_000.0, "cycle_tolerance": 0.15, "residual_gate_cycles": None},
    },
    "processing_options": {"downsample_method": "mean", "downsample_weighted": False, "vlm_output_posting_meters": 120.0},
}

#: Values that options are chosen from, by their path.
CHOICES: dict[str, tuple[str, ...]] = {
    "calibration_options.grid_type": ("constant", "variable"),
    "calibration_options.surface.method": ("windowed_plane", "loclin"),
    "calibration_options.surface.regions": ("none", "separate", "pieces"),
    "calibration_options.tropo.mode": ("legacy", "off", "stratified", "full", "auto"),
    "processing_options.downsample_method": ("mean", "median"),
}


def merged(base: Mapping[str, Any], new: Mapping[str, Any]) -> Params:
    """``base`` under ``new``: mappings on both sides are merged, anything else is replaced. Neither is changed."""
    out = {k: copy.deepcopy(v) for k, v in base.items() if k not in new}
    for k, v in new.items():
        both = isinstance(v, Mapping) and isinstance(base.get(k), Mapping)
        out[k] = merged(base[k], v) if both else copy.deepcopy(v)
    return out


def paths(params: Mapping[str, Any], before: str = "") -> Params:
    """The leaves by dotted path, as :func:`groundswell.operators.joins.overrides` has them."""
    out: Params = {}
    for k, v in params.items():
        out |= paths(v, f"{before}{k}.") if isinstance(v, Mapping) else {f"{before}{k}": v}
    return out


def checked(params: Params) -> Params:
    """``params`` if every leaf is known, and of the right kind and range; else a ValueError that names it."""
    known = paths(DEFAULTS)
    for path, value in paths(params).items():
        if path not in known:
            raise ValueError(f"unknown option {path}")
        if value not in CHOICES.get(path, (value,)):
            raise ValueError(f"{path} is {value!r}, not one of {', '.join(CHOICES[path])}")
        like = known[path]
        if isinstance(like, bool) != isinstance(value, bool) or isinstance(like, (int, float)) and not isinstance(value, (int, float)):
            raise ValueError(f"{path} is {value!r}, of another kind than {like!r}")
    tropo, k = params["calibration_options"]["tropo"], params["calibration_options"]["uncertainty"]["k_grid"]
    if tropo["relief_off_meters"] > tropo["relief_stratified_meters"]:
        raise ValueError("the relief for off is above the one for stratified")
    if k < 0:
        raise ValueError("k_grid is negative")
    return params


@dataclass
class FrameTable:
    """Overrides of frames by id as five digits, over ``default`` for all."""

    version: str
    description: str = ""
    default: Params = field(default_factory=dict)
    data: dict[str, Params] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> FrameTable:
        found = json.loads(Path(path).read_text())
        if unknown := found.keys() - {"version", "description", "default", "data"}:
            raise ValueError(f"unknown parts of a frame table: {', '.join(sorted(unknown))}")
        return cls(**found)

    def frames(self) -> list[int]:
        return sorted(map(int, self.data))

    def of(self, frame_id: int | str, extra: Mapping[str, Any] | None = None) -> Params:
        """What a frame overrides: the default, under its own entry, under ``extra``."""
        return merged(merged(self.default, self.data.get(f"{int(frame_id):05d}", {})), extra or {})

    def params(self, frame_id: int | str, extra: Mapping[str, Any] | None = None) -> Params:
        """All parameters of a frame; overrides outside a group belong to the calibration."""
        shaped: Params = {}
        for k, v in self.of(frame_id, extra).items():
            shaped = merged(shaped, {k: v} if k in DEFAULTS else {"calibration_options": {k: v}})
        return checked(merged(DEFAULTS, shaped))

    def write(self, path: str | Path, *, folded: bool = False) -> None:
        """As JSON; ``folded`` puts the default into each frame's entry, for readers that look there alone."""
        whole: Params = {"version": self.version, "description": self.description}
        whole |= {"data": {k: self.of(k) for k in self.data}} if folded else {"default": self.default, "data": self.data}
        Path(path).write_text(json.dumps(whole, indent=2) + "\n")


def packaged(folder: str | Path, name: str) -> Path:
    """A file that lies in a folder itself; names that lead elsewhere are refused."""
    path = Path(folder) / name
    if Path(name).name != name or not path.is_file():
        raise FileNotFoundError(f"no {name!r} in {folder}")
    return path
