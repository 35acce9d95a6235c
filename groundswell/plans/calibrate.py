"""Calibration of displacement fields: a plane, and the robust two-pass local-linear surface."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundswell.functions.scalars import HUBER_C, MAD_SCALE, coherence_weight
from groundswell.operators.aggregates import block_aggregate, mad_outliers
from groundswell.operators.fits import plane, robust_plane
from groundswell.operators.kernels import connected, fill_nearest, nearest_valid, per_field
from groundswell.operators.neighbourhood import gaussian, gaussian_masked, local_linear, upsample_bilinear, windowed_plane
from groundswell.session import settled


def calibrate_plane(df: DataFrame, keys: list[str], *, disp: str = "disp", gnss: str = "gnss", center: tuple[float, float] = (3.5, 3.5)) -> DataFrame:
    """Adds surface and calibrated: a plane through disp − gnss of each field, taken off. Two hash aggregates' worth of shuffles."""
    rows = df.withColumn("_d", F.col(disp) - F.col(gnss))
    fit = plane(rows, keys, value="_d", center=center)
    out = rows.drop("_d").join(fit, keys)
    out = out.withColumn("surface", F.col("p0") + F.col("px") * (F.col("c") - center[0]) + F.col("py") * (F.col("r") - center[1]))
    return out.withColumn("calibrated", F.col(disp) - F.col("surface")).drop("p0", "px", "py")


def robust_weights(df: DataFrame, keys: list[str], shape: tuple[int, int], sigma: float, *, threshold: float = 4.0, rounds: int = 2) -> DataFrame:
    """Adds ``robust`` to cells (v, w): Huber weights of the residual to the local level, 0 beyond ``threshold`` scaled MADs.

    Under ten weighted cells, or without scatter, weights stay as they are."""
    rows = df.withColumn("robust", F.lit(1.0))
    for _ in range(rounds):
        w = F.col("w") * F.col("robust")
        level = gaussian(rows.select(*keys, "r", "c", (w * F.col("v")).alias("a"), w.alias("b")), keys, ["a", "b"], shape, sigma, mode="nearest")
        near = rows.join(level.select(*keys, "r", "c", F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("level")), [*keys, "r", "c"])
        d = F.when(w > 0, F.col("v") - F.col("level"))
        med = near.groupBy(*keys).agg(F.median(d).alias("med"), F.count(d).alias("n"))
        near = near.join(med, keys).withColumn("far", F.abs(d - F.col("med")))
        mad = near.groupBy(*keys).agg((F.lit(MAD_SCALE) * F.median("far")).alias("mad"))
        z = F.col("far") / F.col("mad")
        fresh = F.when((F.col("n") < 10) | (F.col("mad") <= 0), F.col("robust")).when(F.col("far").isNull() | (z > threshold), 0.0).when(z > HUBER_C, HUBER_C / z).otherwise(1.0)
        rows = settled(near.join(mad, keys).withColumn("robust", fresh).select(*df.columns, "robust"))
    return rows


def calibrate_pair(df: DataFrame, keys: list[str], shape: tuple[int, int], *, sigma: float = 2.0, coherence_power: float = 2.0, filled: float = 0.02, two_pass: bool = True) -> DataFrame:
    """Components of the calibration of each pair's field, NULL where invalid: surface, tie, reference, tropo, and their
    sum ``calibration``; ``calibrated`` = disp − calibration.

    ``df`` has keys, r, c, disp, gnss, tropo, coherence, ok. The reference is the most coherent valid cell, its value
    taken out first. Gaps are filled from the nearest valid cell at weight ``filled``, weights are coherence to a power
    times robust weights, and a local-linear surface is fitted; with ``two_pass`` a robust plane ties what is left."""
    rows = df.withColumn("work", F.when(F.col("ok"), F.col("disp") - F.coalesce("tropo", F.lit(0.0)) - F.col("gnss")))
    best = F.max_by(F.struct("work"), F.struct(F.coalesce("coherence", F.lit(0.0)), -F.col("r"), -F.col("c")))
    ref = rows.where("work IS NOT NULL").groupBy(*keys).agg(best.alias("p")).select(*keys, F.col("p.work").alias("reference"))
    rows = rows.join(ref, keys).withColumn("v", F.col("work") - F.col("reference"))
    full = per_field(rows, keys, shape, lambda f: {"filled": fill_nearest(f["v"])}, ["v"], "filled double")
    rows = settled(rows.join(full, [*keys, "r", "c"]))
    weight = F.when(F.col("v").isNotNull(), coherence_weight("coherence", coherence_power)).otherwise(filled)
    cells = robust_weights(rows.select(*keys, "r", "c", F.col("filled").alias("v"), weight.alias("w")), keys, shape, sigma)
    level = local_linear(cells.withColumn("w", F.col("w") * F.col("robust")), keys, shape, sigma)
    out = settled(rows.join(level.select(*keys, "r", "c", F.col("level").alias("surface")), [*keys, "r", "c"]))
    if two_pass:
        fit = robust_plane(out.withColumn("rest", F.col("v") - F.col("surface")), keys, value="rest")
        out = out.join(fit, keys).withColumn("tie", F.col("p0") + F.col("px") * F.col("c") + F.col("py") * F.col("r")).drop("p0", "px", "py")
    else:
        out = out.withColumn("tie", F.lit(0.0))
    valid = F.col("v").isNotNull()
    total = F.col("surface") + F.col("tie") + F.col("reference") + F.coalesce("tropo", F.lit(0.0))
    cols = [F.when(valid, F.col(c)).alias(c) for c in ("surface", "tie", "reference")]
    return out.select(*keys, "r", "c", *cols, F.when(valid, F.coalesce("tropo", F.lit(0.0))).alias("tropo"), F.when(valid, total).alias("calibration"), F.when(valid, F.col("disp") - total).alias("calibrated"))


def _patched(v: np.ndarray, bad: np.ndarray, buffer: float, least: int) -> np.ndarray:
    """``v`` with the bad cells, grown by ``buffer``, taken from the nearest good one; regions of under ``least`` cells aren't bad."""
    if least > 1 and bad.any():
        label = connected(bad)
        bad = bad & (np.bincount(label.ravel())[label] >= least)
    if bad.any():
        bad = nearest_valid(bad)[2] <= buffer * buffer
    valid = np.isfinite(v)
    if not bad.any() or not (valid & ~bad).any():
        return v
    r, c, _ = nearest_valid(valid & ~bad)
    return np.where(valid & bad, v[r, c], v)


def calibrate_windowed(df: DataFrame, keys: list[str], shape: tuple[int, int], reference: tuple[int, int], size: int, *, factor: int = 1, events: bool = False, buffer: float = 1.0, threshold: float = 3.0, least: int = 1, sigma: float | None = None) -> DataFrame:
    """keys, r, c, calibration and calibrated = disp − calibration of each field, NULL where invalid or out of a window's reach.

    ``df`` has keys, r, c, disp, gnss, correction, coherence, ok and, with ``events``, event. In order: corrections go; the
    value at ``reference`` is taken out (an error where it is invalid); event regions, grown by ``buffer`` cells, are
    filled from the nearest cell outside; fields shrink by ``factor`` with coherence as weight. Without ``events``, cells
    of disp − gnss beyond ``threshold`` scaled MADs in regions of ``least`` cells are filled likewise. Planes in windows
    of ``size`` cells that overlap by half are blended, smoothed (None: an eighth of the window; 0: not at all),
    brought back to full size, and get reference and corrections again."""
    fixed = F.coalesce("correction", F.lit(0.0))
    rows = df.withColumn("work", F.when(F.col("ok"), F.col("disp") - fixed))
    at = rows.where((F.col("r") == reference[0]) & (F.col("c") == reference[1]))
    ref = at.select(*keys, F.coalesce("work", F.raise_error(F.lit("the reference cell is invalid")).cast("double")).alias("reference"))
    rows = rows.join(ref, keys).withColumn("v", F.col("work") - F.col("reference"))
    base = rows.select(*keys, "r", "c", "v", "gnss", "coherence", *["event"] * events)
    if events:
        marked = base.withColumn("event", F.coalesce(F.col("event"), F.lit(False)).cast("double"))
        patched = per_field(marked, keys, shape, lambda f: {"v": _patched(f["v"], f["event"] > 0, buffer, 1)}, ["v", "event"], "v double")
        base = base.drop("v", "event").join(patched, [*keys, "r", "c"])
    small = (shape[0] // factor, shape[1] // factor)
    if factor > 1:
        v = block_aggregate(base, keys, factor, shape, weight="coherence")
        base = v.join(block_aggregate(base, keys, factor, shape, value="gnss"), [*keys, "r", "c"])
    rest = base.select(*keys, "r", "c", (F.col("v") - F.col("gnss")).alias("v"))
    if not events:
        marked = mad_outliers(rest, keys, threshold=threshold).withColumn("outlier", F.coalesce("outlier", F.lit(False)).cast("double"))
        rest = per_field(marked, keys, small, lambda f: {"v": _patched(f["v"], f["outlier"] > 0, buffer, least)}, ["v", "outlier"], "v double")
    window = max(size // factor, 2)
    level = windowed_plane(rest, keys, small, window, window // 2).select(*keys, "r", "c", F.col("surface").alias("v"))
    spread = window / 8 if sigma is None else sigma
    if spread > 0:
        level = gaussian_masked(level, keys, small, spread)
    if factor > 1:
        level = upsample_bilinear(level, keys, small, shape)
    total = F.when(F.col("work").isNotNull(), F.col("surface") + F.col("reference") + fixed)
    out = rows.join(level.select(*keys, "r", "c", F.col("v").alias("surface")), [*keys, "r", "c"], "left").withColumn("calibration", total)
    return out.select(*keys, "r", "c", "calibration", (F.col("disp") - F.col("calibration")).alias("calibrated"))


def circle_km(lon: float, lat: float, km: float, points: int = 36) -> tuple[list[float], list[float]]:
    """A ring about a point on the sphere."""
    d, la, lo = km / 6371.0, math.radians(lat), math.radians(lon)
    xs, ys = [], []
    for k in range(points):
        b = 2 * math.pi * k / points
        la2 = math.asin(math.sin(la) * math.cos(d) + math.cos(la) * math.sin(d) * math.cos(b))
        lo2 = lo + math.atan2(math.sin(b) * math.sin(d) * math.cos(la), math.cos(d) - math.sin(la) * math.sin(la2))
        xs.append(math.degrees(lo2))
        ys.append(math.degrees(la2))
    return xs, ys
