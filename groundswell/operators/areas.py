"""Land pieces of a frame, its regional trend, and first drafts of areas that deform."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from groundswell.operators.aggregates import mad_scale, majority_mask
from groundswell.operators.fits import EPS, plane
from groundswell.operators.kernels import connected, erode, nearest_valid, per_field, segment_regions, spread


def land_pieces(df: DataFrame, keys: list[str], shape: tuple[int, int], *, factor: int = 6, closing: int = 8, least: int = 50) -> DataFrame:
    """``df`` with ``piece``: the land piece of each cell from 1 in order of their first blocks, 0 in none or beyond the last whole block.

    ``df`` has keys, r, c, ok (data) and land. Blocks that are mostly ``ok`` are closed by so many steps of 3 × 3, over land
    alone, so that water keeps pieces apart however narrow it is; outside the field is no land. Pieces under ``least`` blocks go."""
    coarse = (shape[0] // factor, shape[1] // factor)
    whole = df.where((F.col("r") < coarse[0] * factor) & (F.col("c") < coarse[1] * factor))
    ok, land = (majority_mask(whole.select(*keys, "r", "c", F.coalesce(m, F.lit(False)).alias(m)), keys, factor, m) for m in ("ok", "land"))

    def run(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        held = f["ok"] > 0
        bridged = erode(spread(held, closing, square=True), closing, square=True)
        return {"piece": segment_regions(bridged & ((f["land"] > 0) | held), erosions=1, least=least)}

    blocks = ok.join(land, [*keys, "r", "c"]).withColumn("ok", F.col("ok").cast("double")).withColumn("land", F.col("land").cast("double"))
    pieces = per_field(blocks, keys, coarse, run, ["ok", "land"], "piece int").select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), "piece")
    cells = df.withColumn("_r", F.floor(F.col("r") / factor).cast("int")).withColumn("_c", F.floor(F.col("c") / factor).cast("int"))
    return cells.join(pieces, [*keys, "_r", "_c"], "left").drop("_r", "_c").withColumn("piece", F.coalesce("piece", F.lit(0)))


def regional_plane(df: DataFrame, keys: list[str], *, value: str = "v", limit: float = 3.0) -> DataFrame:
    """keys, p0, px, py of a field's trend: a plane, fitted again to the cells whose residual is under ``limit`` scaled MADs of
    the residuals. All cells count; a field whose residuals have no scatter keeps its first plane."""
    rows = df.select(*keys, "r", "c", F.col(value).alias("_v")).where("_v IS NOT NULL")
    level = F.col("p0") + F.col("px") * F.col("c") + F.col("py") * F.col("r")
    left = rows.join(plane(rows, keys, value="_v"), keys).withColumn("_res", F.col("_v") - level).drop("p0", "px", "py")
    met = left.join(mad_scale(left, keys, "_res").select(*keys, "mad"), keys)
    return plane(met.where((F.col("mad") <= EPS) | (F.abs("_res") < limit * F.col("mad"))), keys, value="_v")


def draft_areas(df: DataFrame, keys: list[str], shape: tuple[int, int], *, threshold: float, least: int, buffer: int, opening: int = 3, sign: str = "both", stable: float = 0.5) -> DataFrame:
    """keys, area (1 is the largest), cells, r0, r1, c0, c1, peak, ring, reaches: areas that move against their region, to be reviewed.

    Cells further than ``threshold`` from the regional plane (``sign``: both, positive or negative) are opened by ``opening``
    steps; connected ones (8 neighbours) of ``least`` cells count, and areas are what lies within ``buffer`` cells of them, joined
    where they touch. ``peak`` is the largest residual inside. ``ring`` is the share of cells with data, up to ``buffer`` cells
    around and nearest to this area, that move by less than half the threshold (0 without any), and ``reaches`` whether it is
    ``stable``. A field is taken as a whole, so it has to be averaged or thinned out before."""
    if sign not in ("both", "positive", "negative"):
        raise ValueError(f"unknown sign: {sign}")
    level = F.col("p0") + F.col("px") * F.col("c") + F.col("py") * F.col("r")
    rest = df.join(regional_plane(df, keys), keys).select(*keys, "r", "c", (F.col("v") - level).alias("rest"))

    def run(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        far = {"both": np.abs(f["rest"]), "positive": f["rest"], "negative": -f["rest"]}[sign] > threshold
        label = connected(spread(erode(far, opening), opening), diagonal=True)
        sizes = np.bincount(label.ravel())
        sizes[0] = 0
        core = sizes[label] >= least
        area = ring = np.zeros(shape, int)
        if core.any():
            area = connected(nearest_valid(core)[2] <= buffer * buffer, diagonal=True)
            r, c, d2 = nearest_valid(area > 0)
            ring = np.where((area == 0) & (d2 <= buffer * buffer), area[r, c], 0)
        return {"inside": area, "around": ring, "rest": f["rest"]}

    cells = per_field(rest, keys, shape, run, ["rest"], "inside int, around int, rest double")
    inside = F.col("inside") > 0
    quiet = F.when(~inside & F.col("rest").isNotNull(), (F.abs("rest") < threshold / 2).cast("double"))
    found = cells.withColumn("_id", F.when(inside, F.col("inside")).otherwise(F.col("around"))).where("_id > 0").groupBy(*keys, "_id").agg(
        F.count_if(inside).alias("cells"), *[f(F.when(inside, F.col(x))).alias(f"{x}{i}") for x in "rc" for i, f in enumerate((F.min, F.max))],
        F.coalesce(F.max(F.when(inside, F.abs("rest"))), F.lit(0.0)).alias("peak"), F.coalesce(F.avg(quiet), F.lit(0.0)).alias("ring"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cells"), "_id"))
    return found.withColumn("area", rank).withColumn("reaches", F.col("ring") >= stable).select(*keys, "area", "cells", "r0", "r1", "c0", "c1", "peak", "ring", "reaches")
