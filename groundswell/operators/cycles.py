"""Whole cycles of land regions: which are shifted against their surroundings, by how much, and why or why not."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundswell.operators.kernels import nearest_valid


@dataclass(frozen=True)
class Limits:
    """When a region's step counts: how near land has to be (cells), how many trusted cells a region and an edge need, how
    close to a whole number a step has to be, and from which inversion residual (cycles) a shift is believed."""

    reach: int
    least: int
    edge: int
    tolerance: float = 0.15
    veto: bool = True
    gate: float | None = None


@dataclass
class Decision:
    region: int
    pixels: int
    coherent: int
    jump: float | None = None
    gnss_rel: float | None = None
    resid_med: float | None = None
    cycles: int = 0
    accepted: bool = False
    anchor: bool = False
    method: str = ""
    reason: str = ""


SCHEMA = "region int, pixels long, coherent long, jump double, gnss_rel double, resid_med double, cycles int, accepted boolean, anchor boolean, method string, reason string"


def cells_for_area(area_km2: float, pixel_m: float) -> int:
    return max(1, int(np.ceil(area_km2 * 1e6 / pixel_m**2)))


def _median(a: np.ndarray) -> float | None:
    a = a[np.isfinite(a)]
    return float(np.median(a)) if a.size else None


def _step(values: np.ndarray, trusted: np.ndarray, region: np.ndarray, land: np.ndarray, limits: Limits) -> float | None:
    """The step from settled land to a region: of medians over the cells of each that lie within reach of the other."""
    r, c = np.nonzero(region)
    box = tuple(slice(max(int(x.min()) - limits.reach, 0), int(x.max()) + limits.reach + 1) for x in (r, c))
    region, land, trusted, values = region[box], land[box], trusted[box], values[box]
    if not land.any():
        return None
    inner = region & trusted & (nearest_valid(land)[2] <= limits.reach**2)
    outer = land & trusted & (nearest_valid(region)[2] <= limits.reach**2)
    if inner.sum() < limits.edge or outer.sum() < limits.edge:
        return None
    return float(np.median(values[inner]) - np.median(values[outer]))


def _verdict(d: Decision, limits: Limits) -> Decision:
    whole = round(d.jump)
    off = abs(d.jump - whole)
    if not whole:
        d.anchor, d.reason = True, "0 cycles"
    elif limits.gate is not None and not (d.resid_med is not None and d.resid_med > limits.gate):
        d.reason = "rejected: the inversion closes without a shift"
    elif off >= limits.tolerance:
        d.reason = "rejected: not a whole number of cycles"
    elif limits.veto and d.gnss_rel is not None and abs(d.gnss_rel - whole) >= abs(d.gnss_rel):
        d.reason = "vetoed by GNSS"
    else:
        d.cycles, d.accepted, d.anchor, d.reason = -whole, True, True, "shifted"
    return d


def decide(residual: np.ndarray, labels: np.ndarray, gnss: np.ndarray, coherent: np.ndarray, cycle: float, limits: Limits, inversion: np.ndarray | None = None) -> list[Decision]:
    """A decision for each region but the largest, which is settled land; regions come by size, then label.

    A region whose step to settled land is a whole number of cycles is settled by it, unless that contradicts GNSS, or
    unless the inversion residual (radians) says that nothing is wrong; regions further out are measured against it."""
    if limits.gate is not None and inversion is None:
        raise ValueError("a gate needs the inversion's residual")
    trusted = coherent & np.isfinite(residual)
    ids, sizes = np.unique(labels[labels > 0], return_counts=True)
    out: list[Decision] = []
    if not len(ids):
        return out
    by_size = sorted(zip(-sizes, ids, strict=True))
    settled, values = labels == by_size[0][1], residual.astype(float)
    base = _median((residual - gnss)[settled & trusted]) or 0.0
    for size, label in by_size[1:]:
        region = labels == label
        own = region & trusted
        d = Decision(int(label), int(-size), int(own.sum()))
        out.append(d)
        if d.coherent < limits.least:
            d.reason = "too small"
            continue
        apart = _median((values - gnss)[own])
        d.gnss_rel = None if apart is None else (apart - base) / cycle
        d.resid_med = None if inversion is None else _median(inversion[own] / (2 * np.pi))
        step = _step(values, trusted, region, settled, limits)
        if step is None:
            d.reason = "not measured"
            continue
        d.jump, d.method = step / cycle, "neighbour"
        _verdict(d, limits)
        if d.accepted:
            values = np.where(region, values + d.cycles * cycle, values)
        if d.anchor:
            settled = settled | region
    return out


def decisions(df: DataFrame, keys: list[str], shape: tuple[int, int], cycle: float, limits: Limits) -> DataFrame:
    """keys and a row for each region of a field but its largest; ``df`` has keys, r, c, residual, label, gnss, coherent
    and, where limits have a gate, inversion. A field is one group, so it has to be averaged in blocks before."""
    layers = ["residual", "label", "gnss", "coherent", *["inversion"] * (limits.gate is not None)]
    names = [f.name for f in fields(Decision)]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a = {}
        for name in layers:
            a[name] = np.full(shape, np.nan)
            a[name][rows["r"].to_numpy(), rows["c"].to_numpy()] = rows[name].to_numpy(dtype=float, na_value=np.nan)
        found = decide(a["residual"], np.nan_to_num(a["label"]).astype(int), a["gnss"], a["coherent"] > 0, cycle, limits, a.get("inversion"))
        out = pd.DataFrame([[getattr(d, n) for n in names] for d in found], columns=names)
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    kinds = dict(df.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [SCHEMA])
    return df.select(*keys, "r", "c", *[F.col(x).cast("double").alias(x) for x in layers]).groupBy(*keys).applyInPandas(run, schema)


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, regions, measured, shifted, vetoed, and cells shifted."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("regions"), F.count_if(F.col("method") != "").alias("measured"), F.count_if("accepted").alias("shifted"),
        F.count_if(F.col("reason").startswith("vetoed")).alias("vetoed"), F.sum(F.when(F.col("accepted"), F.col("pixels")).otherwise(0)).alias("cells"),
    )
