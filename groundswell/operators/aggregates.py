"""Block, stack, robust and regional aggregates. All are hash aggregates; percentiles are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from groundswell.functions.scalars import MAD_SCALE, col


def block_aggregate(df: DataFrame, keys: list[str], factor: int, shape: tuple[int, int], *, value: str = "v", method: str = "mean", weight: str | None = None) -> DataFrame:
    """f×f blocks by mean, weighted mean or median; NULL cells don't count, and rows beyond the last whole block go."""
    ny, nx = shape
    rows = df.where((F.col("r") < ny // factor * factor) & (F.col("c") < nx // factor * factor))
    if method == "median":
        out = F.median(value)
    elif weight is None:
        out = F.avg(value)
    else:
        w = F.when(F.col(value).isNotNull(), F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0)))
        out = F.try_divide(F.sum(w * F.col(value)), F.nullif(F.sum(w), F.lit(0.0)))
    return rows.groupBy(*keys, F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")).agg(out.alias(value))


def majority_mask(df: DataFrame, keys: list[str], factor: int, mask: str = "ok") -> DataFrame:
    """True where over half of a block is."""
    return df.groupBy(*keys, F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")).agg((F.avg(F.col(mask).cast("double")) > 0.5).alias(mask))


def stack_mean(df: DataFrame, keys: list[str], value: str = "v", *, poison: bool = False) -> DataFrame:
    """Mean over a stack; with ``poison`` one NULL makes the cell NULL."""
    mean = F.avg(value)
    return df.groupBy(*keys).agg((F.when(~F.bool_or(F.col(value).isNull()), mean) if poison else mean).alias("mean"))


def relief(df: DataFrame, keys: list[str], value: str = "v", percents: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    p = F.percentile(value, F.array(*[F.lit(x) for x in percents]))
    return df.groupBy(*keys).agg((p[1] - p[0]).alias("relief"))


def quantile_trim(df: DataFrame, keys: list[str], value: str = "v", lower: float = 0.15, upper: float = 0.85) -> DataFrame:
    """Adds ``trimmed``: strictly outside the two quantiles of its group. A row a group is joined back."""
    p = F.percentile(value, F.array(F.lit(lower), F.lit(upper)))
    limits = df.groupBy(*keys).agg(p[0].alias("_lo"), p[1].alias("_hi"))
    return _back(df, limits, keys).withColumn("trimmed", (F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi"))).drop("_lo", "_hi")


def _back(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """A row a group joined back; a group of all rows is one row, sent along."""
    return df.join(groups, keys) if keys else df.crossJoin(F.broadcast(groups))


def mad_scale(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """keys, med, mad (scaled) of each group."""
    med = df.groupBy(*keys).agg(F.median(value).alias("med"))
    far = _back(df.select(*keys, value), med, keys)
    return far.groupBy(*keys).agg(F.max("med").alias("med"), (F.lit(MAD_SCALE) * F.median(F.abs(F.col(value) - F.col("med")))).alias("mad"))


def mad_outliers(df: DataFrame, keys: list[str], value: str = "v", threshold: float = 3.0) -> DataFrame:
    """Adds ``outlier``: further than ``threshold`` scaled MADs from the group's median."""
    return _back(df, mad_scale(df, keys, value), keys).withColumn("outlier", F.abs(F.col(value) - F.col("med")) > threshold * F.col("mad")).drop("med", "mad")


def residual_statistics(df: DataFrame, keys: list[str], a: Column | str, b: Column | str) -> DataFrame:
    """n, bias, median, rmse, std (population), nmad and correlation of a − b."""
    rows = df.select(*keys, col(a).alias("_a"), col(b).alias("_b"), (col(a) - col(b)).alias("d")).where("d IS NOT NULL")
    med = rows.groupBy(*keys).agg(F.median("d").alias("med"))
    d = F.col("d")
    return _back(rows, med, keys).groupBy(*keys).agg(F.count("d").alias("n"), F.avg(d).alias("bias"), F.max("med").alias("median"), F.sqrt(F.avg(d * d)).alias("rmse"), F.stddev_pop(d).alias("std"), (F.lit(MAD_SCALE) * F.median(F.abs(d - F.col("med")))).alias("nmad"), F.corr("_a", "_b").alias("corr"))


def region_offsets(df: DataFrame, keys: list[str], *, label: str = "label", value: str = "v", cycle: float) -> DataFrame:
    """Median of each region, and the whole cycles (half to even) by which it stands off the largest region."""
    regions = df.groupBy(*keys, label).agg(F.median(value).alias("med"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    main = F.first("med").over(w.orderBy(F.desc("n"), label).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return regions.withColumn("cycles", F.coalesce(F.rint(F.try_divide(F.col("med") - main, F.lit(cycle))), F.lit(0.0)).cast("int"))


def apply_cycles(df: DataFrame, regions: DataFrame, keys: list[str], *, label: str = "label", value: str = "v", cycle: float) -> DataFrame:
    """Adds ``shift`` and ``corrected``. Regions are few: their number is at most that of labels, checked by adaptive execution."""
    out = df.join(regions.select(*keys, label, "cycles"), [*keys, label], "left")
    return out.withColumn("shift", F.coalesce("cycles", F.lit(0)) * F.lit(cycle)).withColumn("corrected", F.col(value) - F.col("shift")).drop("cycles")


def largest_region(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """The most frequent label of each group, the least one of equals."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), label))
    return counts.withColumn("_k", rank).where("_k = 1").drop("_k")


def reference_pixel(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The first cell (by row, column) with the highest score."""
    best = F.max_by(F.struct("r", "c", "v"), F.struct(F.col(score), -F.col("r"), -F.col("c")))
    return df.where(F.col(score).isNotNull() & F.col("v").isNotNull()).groupBy(*keys).agg(best.alias("p")).select(*keys, "p.r", "p.c", F.col("p.v").alias("reference"))


def downsample_labels(df: DataFrame, factor: int, shape: tuple[int, int], label: str = "label") -> DataFrame:
    """The label at the centre of each whole block of factor × factor cells."""
    half = factor // 2
    inside = (F.col("r") < shape[0] // factor * factor) & (F.col("c") < shape[1] // factor * factor)
    centre = (F.col("r") % factor == half) & (F.col("c") % factor == half)
    return df.where(inside & centre).withColumn("r", F.floor(F.col("r") / factor).cast("int")).withColumn("c", F.floor(F.col("c") / factor).cast("int"))


def data_extent(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """keys and the first and last row and column (r0, r1, c0, c1, ends included) that hold data other than 0."""
    held = df.where(F.col(value).isNotNull() & (F.col(value) != 0))
    return held.groupBy(*keys).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def mode_counts(df: DataFrame, keys: list[str], mode: str = "mode") -> DataFrame:
    """How many pixels each way of decomposition was taken for."""
    names = {2: "solved", 1: "projected", 0: "empty"}
    return df.groupBy(*keys).agg(*[F.count_if(F.col(mode) == k).alias(n) for k, n in names.items()])


def checked_looks(looks: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """The looks, or an error where a pixel has too few of them, a sigma isn't positive, or a look isn't a unit vector."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    unit = F.abs(F.col("e") * F.col("e") + F.col("n") * F.col("n") + F.col("u") * F.col("u") - 1) < 1e-6
    wrong = F.when(n < least, "too few looks").when(F.col("sigma") < 0, "a negative sigma").when(~unit, "a look that isn't a unit vector")
    return looks.withColumn("_wrong", wrong).withColumn("los", F.when(F.col("_wrong").isNull(), F.col("los")).otherwise(F.raise_error("_wrong").cast("double"))).drop("_wrong")
