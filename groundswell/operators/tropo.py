"""Tropospheric delays: which part of a correction to take, layered models, and delay cubes met with the ground."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From this relief (p5 to p95 of heights, metres) on, the layered part of a correction is worth taking out.
LAYERED_RELIEF_M = 1500.0


def choose_mode(mode: Column, apply: Column, relief: Column, *, layered: float = LAYERED_RELIEF_M) -> Column:
    """off, stratified or full. legacy follows the switch ``apply``, auto the relief; auto without heights is an error."""
    auto = F.when(relief.isNull(), F.raise_error(F.lit("tropo mode auto needs heights")).cast("string")).when(relief >= layered, "stratified").otherwise("off")
    return F.when(mode == "legacy", F.when(apply, "full").otherwise("off")).when(mode.isin("off", "stratified", "full"), mode).when(mode == "auto", auto).otherwise(F.raise_error(F.concat(F.lit("unknown tropo mode "), mode)).cast("string"))


def layered(coef: Column, x: Column, y: Column, h: Column) -> Column:
    """a + b·x + c·y + d·h + e·h²."""
    return coef[0] + coef[1] * x + coef[2] * y + coef[3] * h + coef[4] * h * h


def apply_mode(mode: Column, correction: Column, model: Column) -> Column:
    """Nothing for off, the correction for full, its layered part where both are there for stratified."""
    missing = F.raise_error(F.lit("a tropo correction is needed")).cast("double")
    return F.when(mode == "off", F.lit(None).cast("double")).when(mode == "full", F.coalesce(correction, missing)).when(mode == "stratified", F.when(correction.isNotNull(), model))


def axis_position(value: Column, levels: Column) -> Column:
    """Where a value lies on an ascending axis, in fractions of its cells; NULL outside it."""
    below = F.size(F.filter(levels, lambda x: x <= value))
    n = F.size(levels)
    i = F.least(below, n - 1) - 1
    low, high = F.get(levels, i), F.get(levels, i + 1)
    return F.when((value >= F.get(levels, F.lit(0))) & (value <= F.get(levels, n - 1)), i + (value - low) / (high - low))


def cube_at(points: DataFrame, cube: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Adds ``delay``: the cube (keys, k, r, c) between its eight nearest nodes at each point (z, y, x in cells), single precision.

    Unknown nodes count as 0; NULL outside the cube. Points are spread over their corners and met by an equi-join, so
    neither points nor cube are held in one place."""
    f = {a: F.floor(a) for a in "zyx"}
    part = lambda a, d: F.col(a) - f[a] if d else 1 - (F.col(a) - f[a])
    corners = F.array(*[F.struct((f["z"] + i).cast("int").alias("k"), (f["y"] + j).cast("int").alias("r"), (f["x"] + m).cast("int").alias("c"), (part("z", i) * part("y", j) * part("x", m)).alias("_w")) for i in (0, 1) for j in (0, 1) for m in (0, 1)])
    spread = points.withColumn("_k", F.explode(corners)).select(*points.columns, "_k.*").where("_w > 0 OR _w IS NULL")
    met = spread.join(cube.select(*keys, "k", "r", "c", F.coalesce(value, F.lit(0.0)).alias(value)), [*keys, "k", "r", "c"], "left")
    whole = F.count(value) == F.count(F.lit(1))
    return met.groupBy(*points.columns).agg(F.when(whole, F.sum(F.col("_w") * F.col(value))).cast("float").alias("delay"))
