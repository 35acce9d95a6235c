"""Least squares from sums: lines, planes, looks and moving windows. No fit collects its rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from groundswell.functions.scalars import HUBER_C, MAD_SCALE, polynomial_terms
from groundswell.session import settled

EPS = 1e-12


def line(df: DataFrame, keys: list[str], *, weight: Column | None = None) -> DataFrame:
    """keys, n, t_bar, level (at t_bar), slope, s_tt, sw, sww of a weighted line y(t); centred in a second pass, so that
    years near 2000 keep their digits. Rows with NULL y don't count."""
    w = F.lit(1.0) if weight is None else weight
    rows = df.where("y IS NOT NULL AND t IS NOT NULL").withColumn("_w", w)
    means = rows.groupBy(*keys).agg(F.count("y").alias("n"), F.sum("_w").alias("sw"), F.sum(F.col("_w") * F.col("_w")).alias("sww"), F.try_divide(F.sum(F.col("_w") * F.col("t")), F.sum("_w")).alias("t_bar"), F.try_divide(F.sum(F.col("_w") * F.col("y")), F.sum("_w")).alias("level"))
    dt, dy = F.col("t") - F.col("t_bar"), F.col("y") - F.col("level")
    centred = rows.join(means, keys).groupBy(*keys).agg(F.sum(F.col("_w") * dt * dt).alias("s_tt"), F.sum(F.col("_w") * dt * dy).alias("s_ty"))
    return means.join(centred, keys).withColumn("slope", F.when(F.col("s_tt") > EPS, F.col("s_ty") / F.col("s_tt"))).drop("s_ty")


def station_velocity(df: DataFrame, keys: list[str], *, start: float = 2014.0) -> DataFrame:
    """slope and its standard error by weights 1/sigma² on t ≥ start; n − 2 degrees of freedom, one at least."""
    rows = df.where(F.col("t") >= start)
    w = 1 / (F.col("sigma") * F.col("sigma"))
    fit = line(rows, keys, weight=w)
    resid = F.col("y") - (F.col("level") + F.col("slope") * (F.col("t") - F.col("t_bar")))
    chi = rows.join(fit, keys).groupBy(*keys).agg(F.sum(w * resid * resid).alias("chi"))
    return fit.join(chi, keys).select(*keys, "n", "slope", F.sqrt(F.col("chi") / F.greatest(F.col("n") - 2, F.lit(1)) / F.col("s_tt")).alias("slope_sigma"))


def station_rate(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted slope, and the sigma of the first row by ``ord``."""
    return df.groupBy(*keys).agg(F.regr_slope("y", "t").alias("rate"), F.min_by("sigma", "ord").alias("sigma"))


def velocity_min_dates(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.when(F.count("y") >= least, F.regr_slope("y", "t")).alias("velocity"))


def _windows(series: DataFrame, targets: DataFrame, window: float) -> DataFrame:
    """Series rows within half a window of each target. Targets are met by buckets of time, not by a nested loop."""
    bucket = lambda t: F.floor(t / window).cast("long")
    near = targets.withColumn("_b", F.explode(F.array(bucket(F.col("t0")) - 1, bucket(F.col("t0")), bucket(F.col("t0")) + 1)))
    return series.withColumn("_b", bucket(F.col("t"))).join(near, "_b").where(F.abs(F.col("t") - F.col("t0")) <= window / 2).drop("_b")


def resample(series: DataFrame, targets: DataFrame, keys: list[str], window: float, *, method: str = "linear", min_points: int = 3) -> DataFrame:
    """Value and sigma at each target time from a fit over a moving window: linear, huber (two re-weightings) or theil_sen.

    NULL where a window has under ``min_points`` or one time only, or its target lies outside the series' span."""
    span = series.where("y IS NOT NULL").groupBy(*keys).agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    rows = _windows(series.where("y IS NOT NULL"), targets, window)
    by = [*keys, "t0"]
    if method == "theil_sen":
        fit = theil_sen(rows, by)
        base = line(rows, by).drop("level", "slope").join(fit, by).withColumn("level", F.col("intercept") + F.col("slope") * F.col("t_bar")).withColumn("n_eff", F.col("n").cast("double"))
    else:
        rows = _reweighted(rows, by, 2 if method == "huber" else 0)
        base = line(rows, by, weight=F.col("w")).withColumn("n_eff", F.try_divide(F.col("sw") * F.col("sw"), F.col("sww")))
    resid = F.col("y") - (F.col("level") + F.col("slope") * (F.col("t") - F.col("t_bar")))
    spread = rows.join(base, by).groupBy(*by).agg(F.sum(resid * resid).alias("rss"))
    out = base.join(spread, by, "left").join(span, keys)
    ok = (F.col("n") >= min_points) & (F.col("s_tt") > EPS) & (F.col("t0") >= F.col("_first")) & (F.col("t0") <= F.col("_last"))
    value = F.col("level") + F.col("slope") * (F.col("t0") - F.col("t_bar"))
    lever = (F.col("t0") - F.col("t_bar")) * (F.col("t0") - F.col("t_bar")) / F.nullif(F.col("s_tt"), F.lit(0.0))
    sigma = F.sqrt(F.col("rss") / F.greatest(F.col("n") - 2, F.lit(1))) * F.sqrt(1 / F.greatest(F.col("n_eff"), F.lit(1.0)) + lever)
    return out.select(*by, F.when(ok, value).alias("value"), F.when(ok, sigma).alias("sigma"), F.col("n").cast("long").alias("n"))


def _reweighted(rows: DataFrame, by: list[str], rounds: int) -> DataFrame:
    """Adds Huber weights ``w`` after ``rounds`` fits of a line to each group. Every step is a window over the same groups, so
    that the rows are shuffled once; a group is one moving window's rows."""
    over = Window.partitionBy(*by)
    out = rows.withColumn("w", F.lit(1.0))
    for _ in range(rounds):
        sw = F.sum("w").over(over)
        out = out.withColumn("_t", F.col("t") - F.sum(F.col("w") * F.col("t")).over(over) / sw).withColumn("_y", F.col("y") - F.sum(F.col("w") * F.col("y")).over(over) / sw)
        stt = F.sum(F.col("w") * F.col("_t") * F.col("_t")).over(over)
        out = out.withColumn("_s", F.when(stt > EPS, F.sum(F.col("w") * F.col("_t") * F.col("_y")).over(over) / stt))
        out = out.withColumn("_r", F.col("_y") - F.col("_s") * F.col("_t"))
        out = out.withColumn("_f", F.abs(F.col("_r") - F.median("_r").over(over)))
        out = out.withColumn("_m", F.lit(MAD_SCALE) * F.median("_f").over(over))
        z = F.when(F.col("_m") > EPS, F.col("_f") / F.col("_m"))
        out = out.withColumn("w", F.when(z > HUBER_C, HUBER_C / z).otherwise(1.0)).select(*rows.columns, "w")
    return out


def theil_sen(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slope (median over pairs), intercept (median). Pairs are formed inside a window, whose size is bounded by the sampling."""
    a = rows.select(*keys, F.col("t").alias("ta"), F.col("y").alias("ya"), F.col("ord").alias("oa"))
    b = rows.select(*keys, F.col("t").alias("tb"), F.col("y").alias("yb"), F.col("ord").alias("ob"))
    pairs = a.join(b, keys).where((F.col("oa") < F.col("ob")) & (F.abs(F.col("tb") - F.col("ta")) > EPS))
    slope = pairs.groupBy(*keys).agg(F.median((F.col("yb") - F.col("ya")) / (F.col("tb") - F.col("ta"))).alias("slope"))
    return rows.join(slope, keys).groupBy(*keys).agg(F.max("slope").alias("slope"), F.median(F.col("y") - F.col("slope") * F.col("t")).alias("intercept"))


def cumulative(df: DataFrame, keys: list[str], *, order: str = "t", step: str = "y") -> DataFrame:
    """Running sum of a chain of steps, one partition a series."""
    w = Window.partitionBy(*keys).orderBy(order, "ord").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.sum(step).over(w))


def plane(df: DataFrame, keys: list[str], *, value: str = "v", center: tuple[float, float] = (0.0, 0.0), count: str | None = None) -> DataFrame:
    """keys, p0 + px·(c − cx) + py·(r − cy) by the 3×3 normal equations (Cramer's rule), and as ``count`` the number of cells."""
    x, y, v = F.col("c") - center[0], F.col("r") - center[1], F.col(value)
    s = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).cast("double").alias("n"), F.sum(x).cast("double").alias("sx"), F.sum(y).cast("double").alias("sy"),
        F.sum(x * x).cast("double").alias("sxx"), F.sum(x * y).cast("double").alias("sxy"), F.sum(y * y).cast("double").alias("syy"),
        F.sum(v).alias("sv"), F.sum(x * v).alias("sxv"), F.sum(y * v).alias("syv"),
    )
    m = [["n", "sx", "sy"], ["sx", "sxx", "sxy"], ["sy", "sxy", "syy"]]
    rhs = ["sv", "sxv", "syv"]

    def det(a: list[list[str]]) -> Column:
        q = [[F.col(z) for z in row] for row in a]
        return q[0][0] * (q[1][1] * q[2][2] - q[1][2] * q[2][1]) - q[0][1] * (q[1][0] * q[2][2] - q[1][2] * q[2][0]) + q[0][2] * (q[1][0] * q[2][1] - q[1][1] * q[2][0])

    swapped = lambda k: [[rhs[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
    return s.select(*keys, *[F.try_divide(det(swapped(k)), F.nullif(det(m), F.lit(0.0))).alias(name) for k, name in enumerate(("p0", "px", "py"))], *([F.col("n").cast("long").alias(count)] if count else []))


def robust_plane(df: DataFrame, keys: list[str], *, value: str = "v", rounds: int = 3, limit: float = 3.0) -> DataFrame:
    """keys, p0, px, py of a plane that outliers don't bend: after each of ``rounds`` fits, cells further than ``limit``
    scaled MADs from the residuals' median are left out of the next. Sums, medians and a comparison a round; fields
    whose residuals have no scatter keep the plane they have."""
    rows = settled(df.select(*keys, "r", "c", F.col(value).alias("_v")).where("_v IS NOT NULL").withColumn("_use", F.lit(True)))
    fit = plane(rows, keys, value="_v")
    for _ in range(rounds - 1):
        level = F.col("p0") + F.col("px") * F.col("c") + F.col("py") * F.col("r")
        left = rows.join(fit, keys).withColumn("_res", F.col("_v") - level)
        med = left.groupBy(*keys).agg(F.median(F.when(F.col("_use"), F.col("_res"))).alias("_med"))
        far = left.join(med, keys).withColumn("_far", F.abs(F.col("_res") - F.col("_med")))
        mad = far.groupBy(*keys).agg((F.lit(MAD_SCALE) * F.median(F.when(F.col("_use"), F.col("_far")))).alias("_mad"))
        near = (F.col("_mad") <= EPS) & F.col("_use") | (F.col("_mad") > EPS) & (F.col("_far") <= limit * F.col("_mad"))
        rows = settled(far.join(mad, keys).select(*keys, "r", "c", "_v", near.alias("_use")))
        fit = plane(rows.where("_use"), keys, value="_v")
    return fit


def decompose(looks: DataFrame, keys: list[str], *, east: float = 0.0, north: float = 0.0, sigma_north: float = 0.0, cond_max: float = 10.0, min_up: float = 0.1, eig_min: float = 1e-6) -> DataFrame:
    """East and up of each pixel from its looks (los, sigma, e, n, u): weighted 2×2 normal equations where they are well
    conditioned (mode 2), else the vertical by inverse variance with known horizontal motion (mode 1), else none (mode 0)."""
    e, u, los = F.col("e"), F.col("u"), F.col("los") - F.col("n") * F.lit(north)
    var = F.col("sigma") * F.col("sigma") + F.col("n") * F.col("n") * F.lit(sigma_north * sigma_north)
    w = 1 / var
    ok = F.col("los").isNotNull() & (var > 0)
    up, flat = (F.col("los") - e * F.lit(east) - F.col("n") * F.lit(north)) / F.nullif(u, F.lit(0.0)), F.abs(u) >= min_up
    wu = F.when(flat, w * u * u)
    s = looks.where(ok).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_looks"), F.sum(w * e * e).alias("a"), F.sum(w * e * u).alias("b"), F.sum(w * u * u).alias("d"),
        F.sum(w * e * los).alias("re"), F.sum(w * u * los).alias("ru"), F.try_divide(F.sum(wu * up), F.sum(wu)).alias("up1"), F.try_divide(F.lit(1.0), F.sqrt(F.sum(wu))).alias("sigma1"),
    )
    det, mean = F.col("a") * F.col("d") - F.col("b") * F.col("b"), (F.col("a") + F.col("d")) / 2
    root = F.sqrt(F.greatest(((F.col("a") - F.col("d")) / 2) * ((F.col("a") - F.col("d")) / 2) + F.col("b") * F.col("b"), F.lit(0.0)))
    s = s.withColumn("det", det).withColumn("hi", mean + root).withColumn("lo", mean - root)
    good = (F.col("n_looks") >= 2) & (F.col("lo") > eig_min * F.col("hi"))
    fit = F.coalesce(good & (F.sqrt(F.try_divide(F.col("hi"), F.col("lo"))) <= cond_max), F.lit(False))
    part = lambda x: F.when(fit, F.try_divide(x, F.col("det")))
    return s.select(
        *keys, "n_looks", F.when(fit, 2).when(F.col("up1").isNotNull(), 1).otherwise(0).alias("mode"),
        part(F.col("d") * F.col("re") - F.col("b") * F.col("ru")).alias("east"), F.coalesce(part(F.col("a") * F.col("ru") - F.col("b") * F.col("re")), F.when(~fit, F.col("up1"))).alias("up"),
        F.sqrt(part(F.col("d"))).alias("sigma_east"), F.coalesce(F.sqrt(part(F.col("a"))), F.when(~fit, F.col("sigma1"))).alias("sigma_up"),
    )


def least_squares(df: DataFrame, keys: list[str], terms: list[Column], *, value: str = "v", weight: Column | None = None) -> DataFrame:
    """keys, n, coef, covariance (rows), mse of a weighted fit of ``value`` by ``terms``: the sums of the normal equations are
    aggregated, each group's are solved in one row, and a second aggregate has the residuals. NULL where they don't
    determine the coefficients; mse over n less the terms, one at least."""
    m = len(terms)
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(*keys, F.col(value).alias("_v"), w.alias("_w"), F.array(*[t.cast("double") for t in terms]).alias("_t")).where("_v IS NOT NULL AND _w > 0")
    t = [F.col("_t")[i] for i in range(m)]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("_w") * a * b) for a in t for b in t]).alias("_m"), F.array(*[F.sum(F.col("_w") * a * F.col("_v")) for a in t]).alias("_rhs"))

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.reshape(x, (m, m)), np.asarray(y)
            scale = 1 / np.sqrt(np.maximum(np.diag(x), 1e-300))
            known = np.linalg.matrix_rank(x * scale * scale[:, None], tol=1e-10) == m
            out.append(np.concatenate([np.linalg.solve(x, y), np.linalg.inv(x).ravel()]).tolist() if known else None)
        return pd.Series(out)

    fit = sums.withColumn("_s", solve("_m", "_rhs"))
    fit = fit.select(*keys, "n", F.slice("_s", 1, m).alias("coef"), F.when(F.col("_s").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.slice("_s", i * m + m + 1, m))).alias("_inverse"))
    model = F.aggregate(F.zip_with("_t", "coef", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    left = rows.join(fit.select(*keys, "n", "coef"), keys).groupBy(*keys).agg((F.sum(F.col("_w") * (F.col("_v") - model) * (F.col("_v") - model)) / F.greatest(F.max("n") - m, F.lit(1))).alias("mse"))
    out = fit.join(left, keys)
    return out.select(*keys, "n", "coef", F.transform("_inverse", lambda row: F.transform(row, lambda x: x * F.col("mse"))).alias("covariance"), "mse")


def surface_fit(df: DataFrame, keys: list[str], *, order: float = 1.5, value: str = "v", sigma: str | None = None, rounds: int = 2, limit: float = 2.0, x: str = "x", y: str = "y") -> DataFrame:
    """:func:`least_squares` of a polynomial surface over (x, y), repeated without the cells whose residual is further than
    ``limit`` population standard deviations from the mean residual; weights 1/sigma² where ``sigma`` names a column."""
    terms = polynomial_terms(F.col(x), F.col(y), order)
    w = 1 / (F.col(sigma) * F.col(sigma)) if sigma else None
    rows = df
    for k in range(rounds):
        fit = least_squares(rows, keys, terms, value=value, weight=w)
        if k == rounds - 1:
            return fit
        model = reduce(lambda a, b: a + b, [F.col("coef")[i] * t for i, t in enumerate(terms)])
        met = rows.join(fit.select(*keys, "coef"), keys).withColumn("_res", F.col(value) - model)
        spread = met.groupBy(*keys).agg(F.avg("_res").alias("_mean"), F.stddev_pop("_res").alias("_std"))
        rows = met.join(spread, keys).where((F.abs(F.col("_res") - F.col("_mean")) <= limit * F.col("_std")) | (F.col("_std") <= EPS)).select(*df.columns)


def stratified(df: DataFrame, keys: list[str], *, step: int = 7, least: int = 50):
    """a + b·x + c·y + d·h + e·h² of delays ``v`` over (c, r, h) on every ``step``-th cell: the sums of the 5×5 normal
    equations are aggregated, and each group's are solved in one row (NULL under ``least`` cells)."""
    rows = df.where((F.col("r") % step == 0) & (F.col("c") % step == 0) & F.col("v").isNotNull() & F.col("h").isNotNull())
    base = [F.lit(1.0), F.col("c") / 100.0, F.col("r") / 100.0, F.col("h"), F.col("h") * F.col("h")]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(a * b) for a in base for b in base]).alias("m"), F.array(*[F.sum(a * F.col("v")) for a in base]).alias("rhs"))

    @F.pandas_udf("array<double>")
    def solve(m: pd.Series, rhs: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.reshape(a, (5, 5)), np.asarray(b), rcond=1e-12)[0].tolist() for a, b in zip(m, rhs, strict=True)])

    return sums.select(*keys, "n", F.when(F.col("n") >= least, solve("m", "rhs")).alias("coef"))
