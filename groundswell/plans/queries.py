"""Registered queries of the field, station and look operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell.functions import scalars as S
from groundswell.operators import aggregates as A
from groundswell.operators import areas, cycles, fits, joins, kernels
from groundswell.operators import neighbourhood as N
from groundswell.plans import fixtures as X
from groundswell.plans.calibrate import calibrate_pair, calibrate_plane, calibrate_windowed, robust_weights
from groundswell.streaming import epochs

VEC = ["vec_id"]


def _r(*names: str, digits: int = 6) -> list[Column]:
    """Published to six places, as sums depend on order in the last ones; negative zero is zero."""
    return [(F.round(F.col(n), digits) + F.lit(0.0)).alias(n) for n in names]


def plane_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = X.tiles(spark, d).withColumnRenamed("v", "disp").withColumn("gnss", (F.col("vec_id") % 7 + F.col("r") * 2 - F.col("c")) / F.lit(100.0))
    out = calibrate_plane(rows, VEC)
    stats = A.residual_statistics(out, VEC, "calibrated", "gnss").join(A.residual_statistics(out, VEC, "disp", "gnss").select("vec_id", F.col("rmse").alias("rmse_before")), "vec_id")
    return stats.select("vec_id", "n", *_r("rmse_before", "rmse", "nmad"))


def station_velocity_wls(spark: SparkSession, d: str) -> DataFrame:
    return fits.station_velocity(X.series(spark, d), ["user_id"]).select("user_id", "n", *_r("slope", "slope_sigma", digits=4))


def station_rate_ols(spark: SparkSession, d: str) -> DataFrame:
    return fits.station_rate(X.series(spark, d), ["user_id"]).select("user_id", *_r("rate", digits=3), "sigma")


def pixel_velocity_min_dates(spark: SparkSession, d: str) -> DataFrame:
    return fits.velocity_min_dates(X.days(spark, d), ["user_id"], 65).select("user_id", *_r("velocity"))


def epoch_displacement_asof(spark: SparkSession, d: str) -> DataFrame:
    out = joins.epoch_displacement(X.days(spark, d), ["user_id"], 5.0, 25.0, 0.25).join(X.stations(spark, d).select(F.col("id").alias("station"), "lon", "lat"), F.col("user_id") % 25 == F.col("station"))
    return out.select("user_id", "station", "lon", "lat", *_r("dy"))


def correction_match_by_date(spark: SparkSession, d: str) -> DataFrame:
    p = X.pairs(spark, d).select(F.col("ref").cast("date").alias("ref"), F.col("sec").cast("date").alias("sec"), F.concat(F.lit("disp_"), F.lpad(F.col("pair_id").cast("string"), 9, "0")).alias("path"))
    c = X.pairs(spark, d).where("pair_id % 3 = 0").select(F.col("ref").cast("date").alias("day"), F.concat(F.lit("tropo_"), F.lpad(F.col("pair_id").cast("string"), 9, "0")).alias("path"))
    return joins.match_corrections(p, c).select(F.col("ref").cast("string").alias("ref"), F.col("sec").cast("string").alias("sec"), "path", "ref_correction", "sec_correction")


def pair_event_overlap(spark: SparkSession, d: str) -> DataFrame:
    return joins.affecting(X.pairs(spark, d), X.events(spark)).select("pair_id", "event")


def filename_product_id(spark: SparkSession, d: str) -> DataFrame:
    ref, sec = S.name_dates("name")
    return X.names(spark, d).select("p_partkey", *[c.alias(n) for n, c in S.product_fields("name").items()], ref.cast("string").alias("ref_day"), sec.cast("string").alias("sec_day"))


def decimal_year(spark: SparkSession, d: str) -> DataFrame:
    o = X.read(spark, d, "orders")
    return o.select("o_orderkey", F.round(S.decimal_year("o_orderdate"), 9).alias("exact"), S.decimal_year("o_orderdate", digits=4).alias("rounded"))


def lon_wrap_bbox(spark: SparkSession, d: str) -> DataFrame:
    s = X.stations(spark, d).withColumn("lon", S.wrap_longitude("lon"))
    box = {"south": -62.0, "west": -175.0, "north": 16.0, "east": 111.0}
    strict = joins.bounded(s, **box, strict=True).select("id", F.lit(True).alias("strict"))
    return joins.bounded(s, **box, strict=False).join(strict, "id", "left").select("id", "lon", "lat", F.coalesce("strict", F.lit(False)).alias("strict"))


def block_mean(spark: SparkSession, d: str) -> DataFrame:
    return A.block_aggregate(X.tiles(spark, d), VEC, 2, X.TILE).select("vec_id", "r", "c", *_r("v"))


def block_median(spark: SparkSession, d: str) -> DataFrame:
    return A.block_aggregate(X.scene(spark, d), ["frame"], 3, (100, 100), method="median").select("frame", "r", "c", *_r("v"))


def block_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return A.block_aggregate(X.scene(spark, d), ["frame"], 6, (100, 100), weight="coherence").select("frame", "r", "c", *_r("v"))


def majority_mask(spark: SparkSession, d: str) -> DataFrame:
    return A.majority_mask(X.scene(spark, d).withColumn("ok", F.col("ok") & (F.col("coherence") > 0.4)), ["frame"], 4)


def stack_mean_ignore_null(spark: SparkSession, d: str) -> DataFrame:
    return A.stack_mean(X.scene(spark, d), ["frame", "c"]).select("frame", "c", *_r("mean"))


def stack_mean_poison(spark: SparkSession, d: str) -> DataFrame:
    rows = X.scene(spark, d).withColumn("block", F.floor(F.col("r") / 4).cast("int"))
    return A.stack_mean(rows, ["frame", "block", "c"], poison=True).select("frame", "block", "c", *_r("mean"))


def relief_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return A.relief(X.scene(spark, d), ["frame"]).select("frame", *_r("relief"))


def quantile_trim_mask(spark: SparkSession, d: str) -> DataFrame:
    out = A.quantile_trim(X.scene(spark, d), ["frame", "label"])
    return out.groupBy("frame", "label").agg(F.count_if("trimmed").alias("n_trimmed"), F.count("v").alias("n"))


def global_mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    return A.mad_outliers(X.scene(spark, d), ["frame"]).where("outlier").select("frame", "r", "c", *_r("v"))


def residual_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = A.residual_statistics(X.series(spark, d).withColumn("model", F.col("sigma") * 3 + F.col("user_id") % 10), ["user_id"], "y", "model")
    return out.select("user_id", "n", *_r("bias", "median", "rmse", "std", "nmad", "corr", digits=8))


def region_median_offsets(spark: SparkSession, d: str) -> DataFrame:
    return A.region_offsets(X.scene(spark, d).where("ok"), ["frame"], cycle=0.5).select("frame", "label", *_r("med"), "n", "cycles")


def unwrap_shift(spark: SparkSession, d: str) -> DataFrame:
    rows = X.scene(spark, d).where("ok")
    out = A.apply_cycles(rows, A.region_offsets(rows, ["frame"], cycle=0.5), ["frame"], cycle=0.5)
    return out.select("frame", "r", "c", *_r("shift", "corrected"))


def largest_region(spark: SparkSession, d: str) -> DataFrame:
    return A.largest_region(X.scene(spark, d), ["frame"])


def reference_pixel(spark: SparkSession, d: str) -> DataFrame:
    return A.reference_pixel(X.scene(spark, d), ["frame"], "coherence").select("frame", "r", "c", *_r("reference"))


def decompose_looks(spark: SparkSession, d: str) -> DataFrame:
    return fits.decompose(X.looks(spark, d), ["l_orderkey"], east=0.02, sigma_north=0.05).select("l_orderkey", "n_looks", "mode", *_r("east", "up", "sigma_east", "sigma_up", digits=5))


def project_vertical(spark: SparkSession, d: str) -> DataFrame:
    li = X.looks(spark, d)
    up, sigma = S.project_vertical(F.col("los"), F.col("sigma"), F.col("e"), F.col("n"), F.col("u"), F.lit(0.02), F.lit(0.01), F.lit(0.003), F.lit(0.004), 0.75)
    return li.select("l_orderkey", up.alias("up"), sigma.alias("up_sigma")).groupBy("l_orderkey").agg(F.count("up").alias("n"), F.avg("up").alias("up"), F.max("up_sigma").alias("up_sigma")).select("l_orderkey", "n", *_r("up", "up_sigma"))


def los_projection(spark: SparkSession, d: str) -> DataFrame:
    s = X.stations(spark, d)
    lon, lat = F.col("lon") / 360, F.col("lat") / 90
    le, ln = F.when(F.col("id") % 5 == 0, 0.0).otherwise(lon * 0.6), F.when(F.col("id") % 5 == 0, 0.0).otherwise(lat * 0.1)
    s = s.select("id", (lon * 10).alias("e"), (lat * 5).alias("n"), (lon - lat).alias("u"), le.alias("le"), ln.alias("ln")).withColumn("lu", S.los_up(F.col("le"), F.col("ln")))
    args = [F.col(c) for c in ("e", "n", "u", "le", "ln", "lu")]
    return s.select("id", S.los_projection(*args, -1.5).alias("los"), S.los_sigma(*args, -1.5).alias("los_sigma"), S.incidence_degrees(F.col("lu")).alias("incidence")).select("id", *_r("los", "los_sigma", "incidence"))


def sigma_cal(spark: SparkSession, d: str) -> DataFrame:
    out = X.looks(spark, d).withColumn("s", S.sigma_cal(F.col("sigma"), F.abs("los"), 1.35, tropo=F.col("e") / 10, ref=F.lit(0.002), inflation=1 + F.abs(F.col("e"))))
    return out.groupBy("l_orderkey").agg(F.avg("s").alias("s")).select("l_orderkey", *_r("s"))


def coherence_base_weights(spark: SparkSession, d: str) -> DataFrame:
    w = S.coherence_weight("coherence", 8.0) * S.base_weight(F.col("ok"), ~F.col("ok") & (F.col("r") % 2 == 0))
    return X.scene(spark, d).withColumn("w", w).select("frame", "r", "c", *_r("w"))


def _resampled(spark: SparkSession, d: str, method: str) -> DataFrame:
    targets = spark.createDataFrame([(float(t),) for t in (0.0, 4.0, 9.5, 15.0, 22.25, 29.0)], "t0 double")
    return fits.resample(X.days(spark, d), targets, ["user_id"], 8.0, method=method).select("user_id", "t0", "n", *_r("value", "sigma", digits=4))


def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    return _resampled(spark, d, "linear")


def resample_huber(spark: SparkSession, d: str) -> DataFrame:
    return _resampled(spark, d, "huber")


def resample_theil_sen(spark: SparkSession, d: str) -> DataFrame:
    return _resampled(spark, d, "theil_sen")


def cumulative_series(spark: SparkSession, d: str) -> DataFrame:
    return fits.cumulative(X.days(spark, d), ["user_id"]).select("user_id", "ord", *_r("total", digits=4))


def daily_epochs(spark: SparkSession, d: str) -> DataFrame:
    out = epochs.daily_epochs(X.read(spark, d, "events"), "user_id")
    return out.select("user_id", F.col("day").cast("date").cast("string").alias("day"), "n", *_r("mean", "low", "high"))


def running_slope(spark: SparkSession, d: str) -> DataFrame:
    return epochs.running_slope(X.read(spark, d, "events"), "user_id").select("user_id", "n", *_r("slope", digits=4))


def gaussian_smooth_constant(spark: SparkSession, d: str) -> DataFrame:
    return N.gaussian(X.tiles(spark, d), VEC, ["v"], X.TILE, 1.0).select("vec_id", "r", "c", *_r("v"))


def gaussian_masked_reflect(spark: SparkSession, d: str) -> DataFrame:
    return N.gaussian_masked(X.gappy(spark, d), VEC, X.TILE, 1.25).select("vec_id", "r", "c", *_r("v"))


def local_linear_surface(spark: SparkSession, d: str) -> DataFrame:
    rows = X.gappy(spark, d).withColumn("w", F.when(F.col("v").isNotNull(), 1 + F.col("coherence")).otherwise(0.0))
    return N.local_linear(rows, VEC, X.TILE, 2.0).select("vec_id", "r", "c", *_r("level", "coverage", digits=5))


def surface_sigma(spark: SparkSession, d: str) -> DataFrame:
    rows = X.tiles(spark, d).withColumn("w", F.lit(1.0)).withColumn("level", F.lit(0.01) * F.col("r"))
    return N.fit_sigma(rows, VEC, X.TILE, 1.5).select("vec_id", "r", "c", *_r("n_eff", "sigma_fit", digits=5))


def hann_blend_windows(spark: SparkSession, d: str) -> DataFrame:
    return N.windowed_plane(X.gappy(spark, d), VEC, X.TILE, 4, 2).select("vec_id", "r", "c", *_r("surface", digits=5))


def bilinear_upsample(spark: SparkSession, d: str) -> DataFrame:
    return N.upsample_bilinear(X.gappy(spark, d), VEC, X.TILE, (13, 11)).select("vec_id", "r", "c", *_r("v"))


def nearest_upsample(spark: SparkSession, d: str) -> DataFrame:
    return N.upsample_nearest(X.tiles(spark, d), VEC, 2, X.TILE, (17, 16)).select("vec_id", "r", "c", *_r("v"))


def point_sample_bilinear(spark: SparkSession, d: str) -> DataFrame:
    points = X.read(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    points = points.select("vec_id", "k", ((F.col("vec_id") % 17 + F.col("k") * 7) / F.lit(4.0) - 0.5).alias("y"), ((F.col("vec_id") % 13 + F.col("k") * 5) / F.lit(4.0)).alias("x"))
    return N.sample_points(points, X.gappy(spark, d), VEC).select("vec_id", "k", *_r("sample"))


def nearest_fill(spark: SparkSession, d: str) -> DataFrame:
    return kernels.per_field(X.gappy(spark, d), VEC, X.TILE, lambda f: {"filled": kernels.fill_nearest(f["v"])}, ["v"], "filled double").select("vec_id", "r", "c", *_r("filled"))


def _distance(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    r, c, d2 = kernels.nearest_valid(np.isfinite(f["v"]))
    return {"source": np.abs(f["v"][r, c]), "distance": np.sqrt(d2)}


def sigma_extrapolation(spark: SparkSession, d: str) -> DataFrame:
    rows = kernels.per_field(X.gappy(spark, d), VEC, X.TILE, _distance, ["v"], "source double, distance double")
    return rows.select("vec_id", "r", "c", (F.col("source") * S.distance_growth(F.col("distance"), 2.0, 3.0)).alias("sigma")).select("vec_id", "r", "c", *_r("sigma"))


def sigma_inflation(spark: SparkSession, d: str) -> DataFrame:
    inside = X.gappy(spark, d).withColumn("v", F.when(F.col("v").isNotNull() & (F.col("v") < 0.1), F.lit(1.0)))
    rows = kernels.per_field(inside, VEC, X.TILE, _distance, ["v"], "source double, distance double")
    return rows.select("vec_id", "r", "c", S.distance_growth(F.col("distance"), 3.0, 2.0).alias("inflation")).select("vec_id", "r", "c", *_r("inflation"))


def stratified_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = X.scene(spark, d).withColumn("h", F.col("coherence") * 2)
    out = fits.stratified(rows, ["frame"])
    return out.select("frame", "n", *[F.round(F.get("coef", F.lit(i)), 4).alias(f"c{i}") for i in range(5)])


def robust_cell_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = X.gappy(spark, d).where("v IS NOT NULL").withColumn("w", F.lit(1.0))
    return robust_weights(rows.select("vec_id", "r", "c", "v", "w"), VEC, X.TILE, 1.5).select("vec_id", "r", "c", *_r("robust", digits=5))


def pair_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = X.gappy(spark, d).select("vec_id", "r", "c", F.coalesce("v", F.lit(0.0)).alias("disp"), ((F.col("r") - F.col("c")) / F.lit(50.0)).alias("gnss"), (F.col("r") / F.lit(200.0)).alias("tropo"), "coherence", F.col("v").isNotNull().alias("ok"))
    return calibrate_pair(rows, VEC, X.TILE).select("vec_id", "r", "c", *_r("surface", "tie", "reference", "tropo", "calibration", "calibrated", digits=5))


def windowed_calibration(spark: SparkSession, d: str) -> DataFrame:
    first = F.col("v").isNotNull() | ((F.col("r") == 3) & (F.col("c") == 3))
    rows = X.gappy(spark, d).select("vec_id", "r", "c", F.coalesce("v", F.lit(0.0)).alias("disp"), ((F.col("r") - F.col("c")) / F.lit(50.0)).alias("gnss"), (F.col("r") / F.lit(200.0)).alias("correction"), "coherence", first.alias("ok"))
    return calibrate_windowed(rows, VEC, X.TILE, (3, 3), 8, factor=2).select("vec_id", "r", "c", *_r("calibration", "calibrated", digits=5))


def connected_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = X.tiles(spark, d).withColumn("m", (F.col("v") > 0).cast("double"))
    return kernels.per_field(rows, VEC, X.TILE, lambda f: {"label": kernels.connected(f["m"] > 0)}, ["m"], "label int")


def _regions(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {"label": kernels.segment_regions(f["land"] > 0, erosions=1, least=8)}


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cells (frame, r, c, residual, label) and decisions of the scene's land, cut by a grid of water."""
    rows = X.scene(spark, d).withColumn("land", F.when((F.col("r") % 25 < 22) & (F.col("c") % 20 < 17), 1.0).otherwise(0.0))
    rows = rows.select("frame", "r", "c", "land", "coherence", (F.col("v") + F.when((F.col("r") > 50) & (F.col("c") > 60), 40.0).otherwise(0.0)).alias("residual"))
    labels = kernels.per_field(rows, ["frame"], (100, 100), _regions, ["land"], "label int")
    cells = rows.join(labels, ["frame", "r", "c"]).withColumn("gnss", F.lit(0.0)).withColumn("coherent", F.lit(1))
    return cells, cycles.decisions(cells, ["frame"], (100, 100), 5.0, cycles.Limits(reach=12, least=5, edge=3, tolerance=0.45))


def segmented_cycles(spark: SparkSession, d: str) -> DataFrame:
    cells, found = _decided(spark, d)
    out = cells.join(found.select("frame", F.col("region").alias("label"), "cycles"), ["frame", "label"], "left")
    return out.select("frame", "r", "c", F.col("label").alias("region"), F.coalesce("cycles", F.lit(0)).alias("cycles"))


def cycle_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d)[1].select("frame", "region", "pixels", "coherent", *_r("jump", "gnss_rel"), "cycles", "accepted", "anchor", "method", "reason")


def cycle_summary(spark: SparkSession, d: str) -> DataFrame:
    return cycles.summary(_decided(spark, d)[1], ["frame"])


def lowpass_family(spark: SparkSession, d: str) -> DataFrame:
    def run(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        v = kernels.fill_idw(f["v"], 8, 1)
        return {"savgol": kernels.savgol(v, 5, 2), "gauss": kernels.fft_lowpass(v, 1.5), "hann": kernels.fft_lowpass(v, 1.5, window="hann")}

    out = kernels.per_field(X.gappy(spark, d), VEC, X.TILE, run, ["v"], "savgol double, gauss double, hann double")
    return out.select("vec_id", "r", "c", *_r("savgol", "gauss", "hann"))


def rbf_surface(spark: SparkSession, d: str) -> DataFrame:
    """A smooth surface through the stations, evaluated on a grid: nodes are a table of stations, solved once and sent along."""
    nodes = kernels.few_nodes(X.stations(spark, d).select("id", "lon", "lat")).sort_values("id")
    x, y = nodes["lon"].to_numpy(), nodes["lat"].to_numpy()
    weights, scale = kernels.rbf_weights(x, y, np.sin(x / 57) + y / 90)

    @F.pandas_udf("double")
    def at(lon: pd.Series, lat: pd.Series) -> pd.Series:
        return pd.Series(kernels.rbf_values(weights, scale, x, y, lon.to_numpy(float), lat.to_numpy(float)))

    grid = spark.range(36 * 15).select((F.col("id") % 36 * 10).cast("double").alias("lon"), (F.floor(F.col("id") / 36) * 10 - 70).cast("double").alias("lat"))
    return grid.withColumn("z", at("lon", "lat")).select("lon", "lat", *_r("z", digits=5))


def stable_mask_growth(spark: SparkSession, d: str) -> DataFrame:
    rows = X.scene(spark, d)
    return kernels.per_field(rows, ["frame"], (100, 100), lambda f: {"stable": kernels.grow_mask(f["coherence"], np.nan_to_num(f["v"]) / 10, reach=3).astype(int)}, ["coherence", "v"], "stable int")


def land_pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = X.scene(spark, d).select("frame", "r", "c", ((F.col("coherence") > 0.2) & (F.col("c") % 40 < 36)).alias("ok"), (F.col("c") % 40 < 36).alias("land"))
    out = areas.land_pieces(rows, ["frame"], (100, 100), factor=3, closing=2, least=10)
    return out.groupBy("frame", "piece").agg(F.count(F.lit(1)).alias("cells"), F.min("r").alias("r0"), F.min("c").alias("c0"))


def draft_areas(spark: SparkSession, d: str) -> DataFrame:
    bump = F.when((F.col("r") - 5) * (F.col("r") - 5) + (F.col("c") - 60) * (F.col("c") - 60) < 36, 5000.0).otherwise(0.0)
    rows = X.scene(spark, d).select("frame", "r", "c", (F.coalesce("v", F.lit(0.0)) + bump + F.col("r") * 2.0).alias("v"))
    return areas.draft_areas(rows, ["frame"], (100, 100), threshold=2500.0, least=12, buffer=4, opening=1).select("frame", "area", "cells", "r0", "r1", "c0", "c1", *_r("peak", "ring"), "reaches")


def tropo_line_of_sight(spark: SparkSession, d: str) -> DataFrame:
    li = X.looks(spark, d)
    delay = S.between_epochs(F.col("los"), F.col("los") * 1.2, F.lit(0.0), F.lit(6.0), F.col("sigma") * 100)
    return li.select("l_orderkey", S.tropo_los(delay, F.col("u"), F.col("e") / 100).alias("d")).groupBy("l_orderkey").agg(F.count("d").alias("n"), F.sum("d").alias("delay")).select("l_orderkey", "n", *_r("delay"))


def polynomial_surface(spark: SparkSession, d: str) -> DataFrame:
    x, y, coef = F.col("c") / F.lit(7.0), F.col("r") / F.lit(7.0), F.array(*[F.lit(k / 10) for k in range(1, 11)])
    out = X.tiles(spark, d).select("vec_id", "r", "c", *[S.polynomial(x, y, coef, o).alias(f"p{str(o).replace('.', '_')}") for o in (0, 1, 1.5, 2, 3)])
    return out.select("vec_id", "r", "c", *_r("p0", "p1", "p1_5", "p2", "p3"))


def plate_motion(spark: SparkSession, d: str) -> DataFrame:
    e, n = S.great_circle_velocity(F.col("lon"), F.col("lat"), -80.0, -5.0, 0.2)
    return X.stations(spark, d).select("id", e.alias("east"), n.alias("north"), S.rupture_length_km(F.lit(6.0) + F.col("id") / 20).alias("rupture_km")).select("id", *_r("east", "north", "rupture_km"))


def snapshot_manifest(spark: SparkSession, d: str) -> DataFrame:
    s = X.read(spark, d, "supplier")
    row = lambda extra: F.sha2(F.concat_ws("|", "s_suppkey", "s_name", F.lit(extra)), 256)
    name = F.concat(F.lit("node_"), F.col("s_suppkey").cast("string"))
    was = s.where("s_suppkey % 5 <> 0").select(name.alias("path"), row("").alias("sha256"))
    now = s.where("s_suppkey % 7 <> 0").select(name.alias("path"), F.when(F.col("s_suppkey") % 11 == 0, row("x")).otherwise(row("")).alias("sha256"))
    return joins.verify_manifest(was, now)


def provenance_check(spark: SparkSession, d: str) -> DataFrame:
    s = X.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("grid"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("snapshot"))
    other = s.withColumn("grid", F.when(F.col("id") % 6 == 0, F.lit("other")).otherwise(F.col("grid"))).withColumn("snapshot", F.when(F.col("id") % 8 != 0, F.col("snapshot")).otherwise(F.lit("new")))
    return joins.same_provenance(s, other, ["id"], ["grid", "snapshot"]).select("id", F.array_join("differs", ",").alias("differs"))


def frame_overrides(spark: SparkSession, d: str) -> DataFrame:
    frames = X.read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("frame_id"))
    table = frames.where("frame_id % 3 = 0").select(F.lpad(F.col("frame_id").cast("string"), 5, "0").alias("key"), F.create_map(F.lit("k_grid"), (F.col("frame_id") + 1).cast("string")).alias("params"))
    out = joins.overrides(frames, table, {"k_grid": "1.0", "mode": "legacy"})
    return out.select("frame_id", F.col("params")["k_grid"].alias("k_grid"), F.col("params")["mode"].alias("mode"))


def polygon_mask(spark: SparkSession, d: str) -> DataFrame:
    rings = spark.createDataFrame([("a", [10.0, 200.0, 120.5], [-60.5, -20.25, 60.5]), ("b", [250.0, 340.5, 340.5, 250.0], [-10.5, -10.5, 55.5, 55.5])], "id string, xs array<double>, ys array<double>")
    return joins.inside_polygons(X.stations(spark, d), rings, "lon", "lat").select("id", "inside")


def names_in_order() -> list[str]:
    return [k for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in ("queries", "names_in_order")]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: globals()[k] for k in names_in_order()}
