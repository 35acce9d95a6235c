"""Queries of names, files, projections, troposphere, GNSS reference motion and parameters, each with its DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell.functions import names, projection
from groundswell.functions import scalars as S
from groundswell.operators import aggregates as A
from groundswell.operators import areas, files, fits, footprints, gnss, joins, tropo
from groundswell.operators import neighbourhood as N
from groundswell.plans import fixtures as X
from groundswell.plans import oracles as O

VEC = ["vec_id"]


def _r(*cols: str, digits: int = 6) -> list[Column]:
    return [(F.round(F.col(n), digits) + F.lit(0.0)).alias(n) for n in cols]


# --- names and files -----------------------------------------------------------------


def _any_name(key: Column) -> Column:
    """A product, a static layer, a product of another sensor or some other file, by turns."""
    five = F.lpad((key % 100000).cast("string"), 5, "0")
    month = F.lpad((key % 12 + 1).cast("string"), 2, "0")
    product = F.concat(F.lit("OPERA_L3_DISP-S1_IW_F"), five, F.lit("_VV_2022"), month, F.lit("11T002312Z_2023"), month, F.lit("22T002313Z_v0.5_20231101T000000Z.nc"))
    static = F.concat(F.lit("OPERA_L3_DISP-S1-STATIC_F"), five, F.lit("_2014"), month, F.lit("03_S1A_v1.0_line_of_sight_enu.tif"))
    return F.when(key % 4 == 0, product).when(key % 4 == 1, static).when(key % 4 == 2, F.concat(F.lit("OPERA_L3_DISP-NISAR_"), five, F.lit(".h5"))).otherwise(F.concat(F.lit("note_20220"), F.lit("311T010203Z_"), five, F.lit(".txt")))


_NAME = """(SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'OPERA_L3_DISP-S1_IW_F' || five || '_VV_2022' || mm || '11T002312Z_2023' || mm || '22T002313Z_v0.5_20231101T000000Z.nc'
  WHEN 1 THEN 'OPERA_L3_DISP-S1-STATIC_F' || five || '_2014' || mm || '03_S1A_v1.0_line_of_sight_enu.tif' WHEN 2 THEN 'OPERA_L3_DISP-NISAR_' || five || '.h5'
  ELSE 'note_20220311T010203Z_' || five || '.txt' END AS name
  FROM (SELECT p_partkey, lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS five, lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') AS mm FROM part))"""


def product_sensor(spark: SparkSession, d: str) -> DataFrame:
    rows = X.read(spark, d, "part").select("p_partkey", _any_name(F.col("p_partkey")).alias("name"))
    ref, sec = names.file_years("name")
    out = rows.select("p_partkey", names.sensor("name").alias("sensor"), *[c.alias(n) for n, c in names.static_fields("name").items()], F.array_join(names.sensing_times("name"), ",").alias("times"), ref.alias("ref_year"), sec.alias("sec_year"))
    return out.withColumn("cycle", names.cycle_m(F.lower("sensor"))).select("p_partkey", "sensor", "static_frame", "static_day", "platform", "static_version", "layer", "times", *_r("ref_year", "sec_year", digits=7), *_r("cycle", digits=8))


def sensing_time_union(spark: SparkSession, d: str) -> DataFrame:
    rows = X.read(spark, d, "part").select(_any_name(F.col("p_partkey")).alias("name"))
    return rows.select(F.explode(names.sensing_times("name")).alias("time")).distinct()


def first_files(spark: SparkSession, d: str) -> DataFrame:
    rows = X.names(spark, d).withColumn("frame", F.col("p_partkey") % 17)
    return files.first_by_name(rows, ["frame"], 5).select("frame", "ord", "name")


def one_file_a_frame(spark: SparkSession, d: str) -> DataFrame:
    rows = X.names(spark, d).where("p_partkey % 3 <> 1").withColumn("frame", F.floor(F.col("p_partkey") / 2))
    return files.the_one(rows, ["frame"])


def event_mask_files(spark: SparkSession, d: str) -> DataFrame:
    rows = X.names(spark, d)
    masks = rows.where("p_partkey % 2 = 0").select(F.explode(F.array(F.lit("b_mask.tif"), F.lit("a_area_mask.tif"), F.lit("a.tif"))).alias("end"), "name")
    masks = masks.select(F.concat(F.regexp_replace("name", r"\.nc$", "_"), "end").alias("mask"))
    return files.with_mask(rows, masks).select("p_partkey", "mask")


def series_span(spark: SparkSession, d: str) -> DataFrame:
    return files.data_span(X.series(spark, d), "user_id", "t", "ord").select(*_r("first", "last", digits=8))


def missing_nodes(spark: SparkSession, d: str) -> DataFrame:
    s = X.read(spark, d, "supplier")
    return files.not_obtained(s.select(F.col("s_suppkey").alias("id")), s.where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("id")), ["id"])


def differential_layers(spark: SparkSession, d: str) -> DataFrame:
    p = X.pairs(spark, d).where("pair_id % 5 = 0")
    days = X.read(spark, d, "orders").where("o_orderkey % 3 <> 0").groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias("t")).agg(F.max("o_orderkey").cast("double").alias("v"))
    return files.differences(p, days).select("pair_id", F.col("difference").cast("double").alias("difference"))


def top_pieces(spark: SparkSession, d: str) -> DataFrame:
    return files.largest(X.read(spark, d, "events"), "user_id", 10)


def model_points(spark: SparkSession, d: str) -> DataFrame:
    c = X.read(spark, d, "customer").select(F.col("c_custkey").alias("ord"), ((F.col("c_custkey") * 37) % 360).cast("double").alias("lon"), ((F.col("c_custkey") * 13) % 150 - 75).cast("double").alias("lat"), (F.col("c_custkey") % 11 / 2).alias("rate"))
    return joins.bounded(files.area_map(c, 6), -40.0, -120.0, 60.0, 95.0, strict=False).select("ord", "lon", "lat", "rate")


# --- projections and window arithmetic --------------------------------------------------


def _cities(spark: SparkSession, d: str) -> DataFrame:
    """Customers within some degrees of a zone's central meridian."""
    k = F.col("c_custkey")
    return X.read(spark, d, "customer").select(k.alias("id"), (F.lit(-93.0) + (k % 41 - 20) / F.lit(8.0)).alias("lon"), (F.lit(30.0) + k % 97 / F.lit(10.0)).alias("lat"))


def zone_coordinates(spark: SparkSession, d: str) -> DataFrame:
    s = _cities(spark, d)
    x, y = projection.to_plane(F.col("lon"), F.col("lat"), 32615)
    s = s.withColumn("x", x).withColumn("y", y)
    lon, lat = projection.from_plane(F.col("x"), F.col("y"), 32615)
    west, south, east, north = projection.buffered((F.col("x"), F.col("y"), F.col("x") + 1000, F.col("y") + 1000), 32615, 500.0)
    s = s.select("id", "x", "y", lon.alias("lon"), lat.alias("lat"), west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))
    return s.select("id", *_r("x", "y", digits=4), *_r("lon", "lat", "west", "south", "east", "north", digits=8))


def stations_in_zone(spark: SparkSession, d: str) -> DataFrame:
    """Stations strictly inside a box of metres grown by a padding."""
    x, y = projection.to_plane(F.col("lon"), F.col("lat"), 32615)
    s = _cities(spark, d).withColumn("x", x).withColumn("y", y)
    pad = 10_000.0
    return s.where((F.col("x") > 400_000 - pad) & (F.col("x") < 600_000 + pad) & (F.col("y") > 3_500_000 - pad) & (F.col("y") < 4_000_000 + pad)).select("id", *_r("x", "y", digits=4))


def window_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    n, m = (k % 400 + 1).cast("int"), (k % 250 + 1).cast("int")
    out = X.read(spark, d, "part").select(
        "p_partkey", S.window_pixels(k * 15.0, 30.0).alias("pixels"), S.smoothstep(k % 14 / F.lit(10.0) - 0.2).alias("step"), S.cells_for_area(k % 9 / F.lit(1000.0), 30.0).alias("cells"),
        S.frame_cutoff(n, m, 30.0).alias("cutoff"), S.window_coordinate(k % n, n).alias("place"), S.fit_step(n, m).alias("every"), S.stable(F.when(k % 5 != 0, k % 10 / F.lit(10.0)), 0.6).alias("stable"),
        projection.pixel_centre(k % 100, 500_000.0, -30.0).alias("centre"), (F.lit(S.kernel_sigma(50_000.0, 1.0)) / (k + 1)).alias("sigma"), S.grid_factor((k % 4).cast("string")).alias("k_grid"),
    )
    return out.select("p_partkey", "pixels", *_r("step"), "cells", "cutoff", *_r("place"), "every", "stable", "centre", *_r("sigma"), "k_grid")


# --- troposphere --------------------------------------------------------------------------


def tropo_modes(spark: SparkSession, d: str) -> DataFrame:
    s = X.scene(spark, d).withColumn("block", F.floor(F.col("r") / 5).cast("int"))
    heights = A.relief(s.withColumn("v", F.col("v") * 10), ["frame", "block"])
    mode = F.element_at(F.array(*[F.lit(m) for m in ("legacy", "off", "stratified", "full", "auto")]), (F.col("block") % 5 + 1).cast("int"))
    return heights.select("frame", "block", tropo.choose_mode(mode, F.col("block") % 2 == 0, F.col("relief")).alias("mode"), *_r("relief"))


_COEF = (0.02, -0.01, 0.03, 0.4, -0.05)


def tropo_component(spark: SparkSession, d: str) -> DataFrame:
    t = X.gappy(spark, d)
    model = tropo.layered(F.array(*[F.lit(x) for x in _COEF]), F.col("c") / F.lit(10.0), F.col("r") / F.lit(10.0), F.col("coherence"))
    mode = F.element_at(F.array(F.lit("off"), F.lit("stratified"), F.lit("full")), (F.col("vec_id") % 3 + 1).cast("int"))
    correction = F.when(mode == "full", F.coalesce("v", F.lit(0.0))).otherwise(F.col("v"))
    return t.select("vec_id", "r", "c", tropo.apply_mode(mode, correction, model).alias("tropo")).select("vec_id", "r", "c", *_r("tropo"))


def delay_at_heights(spark: SparkSession, d: str) -> DataFrame:
    cells = X.read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    cube = cells.select("vec_id", F.floor(F.col("pos") / 16).cast("int").alias("k"), F.floor(F.col("pos") % 16 / 4).cast("int").alias("r"), (F.col("pos") % 4).cast("int").alias("c"), F.when(F.col("pos") % 13 != 5, F.col("e").cast("double")).alias("v"))
    levels = F.array(*[F.lit(x) for x in (0.0, 500.0, 1500.0, 4000.0)])
    v = F.col("vec_id")
    points = X.read(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    points = points.select("vec_id", "i", tropo.axis_position(((v * 37 + F.col("i") * 911) % 4300).cast("double"), levels).alias("z"), ((v + F.col("i") * 5) % 13 / F.lit(4.0)).alias("y"), ((v * 3 + F.col("i")) % 14 / F.lit(4.0)).alias("x"))
    return tropo.cube_at(points, cube, VEC).select("vec_id", "i", F.round(F.col("delay").cast("double"), 5).alias("delay"))


# --- reference motion -----------------------------------------------------------------------


def _node_motion(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    lon, lat = (k * 37) % 360 - 180, (k * 13) % 150 - 75
    look = F.when(k % 9 == 0, 0.0)
    rows = X.read(spark, d, "customer").select(k.alias("id"), lon.cast("double").alias("lon"), lat.cast("double").alias("lat"), (k % 23 - 11.0).alias("ve"), (k % 17 - 8.0).alias("vn"), (k % 7 - 3.0).alias("vu"), (k % 3 + 0.4).alias("sigma_ve"), (k % 4 + 0.5).alias("sigma_vn"), (k % 5 + 1.2).alias("sigma_vu"), F.coalesce(look, F.lit(-0.6)).alias("le"), F.coalesce(look, F.lit(-0.1)).alias("ln"))
    return rows.withColumn("lu", S.los_up(F.col("le"), F.col("ln")))


def reference_los(spark: SparkSession, d: str) -> DataFrame:
    nodes = _node_motion(spark, d)
    steps = nodes.withColumns({c: F.col(c) * 0.25 for c in gnss.VALUES})
    constant = gnss.reference_motion(nodes, steps, "constant", F.lit(-0.75)).select("id", F.lit("constant").alias("grid"), "los", "los_sigma")
    variable = gnss.reference_motion(nodes, steps, "variable", F.lit(-0.75), reprocessing=True).select("id", F.lit("variable").alias("grid"), "los", "los_sigma")
    return constant.unionByName(variable).select("id", "grid", *_r("los", "los_sigma"))


def rates_of_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = _node_motion(spark, d).select("id", "lon", "lat")
    rates = _node_motion(spark, d).where("id % 6 <> 0").select("id", *gnss.VALUES)
    n = gnss.missing_nodes(nodes, rates)
    return gnss.node_rates(nodes, rates).crossJoin(F.broadcast(n)).select("id", "lon", "lat", "ve", "vn", "vu", "wanted", "missing")


_RINGS = (("a", ((-150.5, -60.5), (20.5, -20.25), (-60.5, 60.5))), ("a", ((-80.5, -15.5), (-50.5, -15.5), (-50.5, 10.5), (-80.5, 10.5))), ("b", ((70.5, -10.5), (160.5, -10.5), (160.5, 55.5), (70.5, 55.5))))


def _areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, [float(p[0]) for p in ring], [float(p[1]) for p in ring]) for i, ring in _RINGS], "id string, xs array<double>, ys array<double>")


def nodes_outside_areas(spark: SparkSession, d: str) -> DataFrame:
    """A polygon with a hole, and another."""
    nodes = _node_motion(spark, d).withColumnRenamed("id", "node").select("node", "lon", "lat")
    return gnss.without_areas(nodes, _areas(spark)).select("node", "lon", "lat")


def remove_restore_mask(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and nodes: whether a node lies in an area, or in one of an event that the pair spans."""
    events = X.events(spark).where("t1 IS NULL").withColumn("area", F.when(F.col("event") == "quake-a", "a").otherwise("b"))
    active = joins.affecting(X.pairs(spark, d), F.broadcast(events)).select("pair_id", "area")
    nodes = _node_motion(spark, d).select(F.col("id").alias("node"), F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    inside = nodes.join(joins.polygons_around(nodes, _areas(spark), "_x", "_y"), ["_x", "_y"]).select("node", F.col("id").alias("area"))
    return joins.sharing(active, inside, "pair_id", "node", "area")


def realisation_digest(spark: SparkSession, d: str) -> DataFrame:
    n = _node_motion(spark, d)
    field = gnss.field_text({c: F.col(c) for c in gnss.VALUES}, digits=3)
    return n.select("id", gnss.digest(F.concat(F.lit("grid-"), F.col("id").cast("string")), field).alias("digest"))


# --- fields ------------------------------------------------------------------------------------


def loclin_blend(spark: SparkSession, d: str) -> DataFrame:
    rows = X.gappy(spark, d).select("vec_id", "r", "c", F.coalesce("v", F.lit(0.0)).alias("v"), F.when(F.col("v").isNotNull(), (1 + F.col("coherence")) / 4).otherwise(0.0).alias("w"))
    out = N.loclin_surface(rows, VEC, X.TILE, pixel_m=1.0, cutoff_m=2.0 / S.HALF_RESPONSE, blend=(0.1, 0.35))
    return out.select("vec_id", "r", "c", *_r("surface", "coverage", digits=5))


def labels_at_block_centres(spark: SparkSession, d: str) -> DataFrame:
    return A.downsample_labels(X.scene(spark, d), 3, (100, 100)).select("frame", "r", "c", "label")


def extent_of_data(spark: SparkSession, d: str) -> DataFrame:
    rows = X.tiles(spark, d).withColumn("v", F.when(F.col("v") > 0.12, F.col("v")).otherwise(0.0))
    return A.data_extent(rows, VEC)


def look_modes(spark: SparkSession, d: str) -> DataFrame:
    looks = A.checked_looks(X.looks(spark, d), ["l_orderkey"])
    out = fits.decompose(looks, ["l_orderkey"], east=0.02, sigma_north=0.05).withColumn("part", F.col("l_orderkey") % 50)
    return A.mode_counts(out, ["part"])


_COVARIANCE = ((0.4, 0.01, 0.02, 0.0), (0.01, 0.3, 0.0, 0.03), (0.02, 0.0, 0.2, 0.01), (0.0, 0.03, 0.01, 0.1))


def polynomial_error(spark: SparkSession, d: str) -> DataFrame:
    t = X.tiles(spark, d)
    cov = F.array(*[F.array(*[F.lit(x) for x in row]) for row in _COVARIANCE])
    return t.select("vec_id", "r", "c", (S.polynomial_sigma(F.col("c") / F.lit(7.0), F.col("r") / F.lit(7.0), cov, 1.5) * F.abs("v")).alias("sigma")).select("vec_id", "r", "c", *_r("sigma"))


def weighted_plane_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = X.gappy(spark, d)
    out = fits.least_squares(rows, VEC, [F.lit(1.0), F.col("c") / F.lit(7.0), F.col("r") / F.lit(7.0)], weight=1 + F.col("coherence"))
    return out.select("vec_id", "n", *[F.round(F.col("coef")[i], 5).alias(f"c{i}") for i in range(3)], *_r("mse"))


def regional_trend(spark: SparkSession, d: str) -> DataFrame:
    return areas.regional_plane(X.gappy(spark, d), VEC).select("vec_id", *_r("p0", "px", "py"))


def seed_level(spark: SparkSession, d: str) -> DataFrame:
    """Block medians of trusted cells, spread by a normalised Gaussian and brought back to the grid."""
    seeds = X.gappy(spark, d).withColumn("v", F.when(F.col("coherence") > 0.5, F.col("v")))
    blocks = A.block_aggregate(seeds, VEC, 2, X.TILE, method="median")
    level = N.gaussian_masked(blocks, VEC, (4, 4), 1.0, mode="reflect", truncate=4.0)
    return N.upsample_nearest(level, VEC, 2, (4, 4), X.TILE).select("vec_id", "r", "c", *_r("v", digits=5))


def event_footprints(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as earthquakes."""
    key = F.col("s_suppkey")
    quakes = X.read(spark, d, "supplier").select(key.cast("int").alias("event"), (key * 37 % 3600 / 10 - 179.97).alias("lon"), (key * 53 % 1400 / 10 - 70).alias("lat"), (key % 30 / 10 + 5).alias("magnitude"), (key * 17 % 360).cast("double").alias("strike"))
    return footprints.event_rings(quakes, "event").select("event", "ord", *_r("rupture_km", "buffer_km", digits=6), *_r("lon", "lat", digits=7))


def merged_overrides(spark: SparkSession, d: str) -> DataFrame:
    frames = X.read(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("frame_id"))
    own = F.create_map(F.lit("weights.robust"), F.when(F.col("frame_id") % 2 == 0, "true").otherwise("false"), F.lit("tropo"), F.lit("off"))
    table = frames.where("frame_id % 3 = 0").select(F.lpad(F.col("frame_id").cast("string"), 5, "0").alias("key"), own.alias("params"))
    out = joins.overrides(frames, table, {"weights.robust": "none", "weights.power": "2", "tropo.mode": "auto"}, {"k_grid": "1.5"})
    text = F.transform(F.sort_array(F.map_keys("params")), lambda k: F.concat(k, F.lit("="), F.col("params")[k]))
    return out.select("frame_id", F.array_join(text, ";").alias("params"))


# --- SQL -----------------------------------------------------------------------------------------


def _to_plane(source: str, name: str) -> str:
    """CTEs <name>: source's columns with x, y in zone 15 north."""
    n = (1 / 298.257223563) / (2 - 1 / 298.257223563)
    e = 2 * math.sqrt(n) / (1 + n)
    radius = 6378137 / (1 + n) * (1 + n * n / 4 + n**4 / 64) * 0.9996
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4)
    at = lambda z: f"(0.5::DOUBLE * ln((1 + {z}) / (1 - {z})))"
    hyper = lambda s, z: f"((exp({z}) {s} exp(-({z}))) / 2)"
    plane = lambda outer, s: " + ".join(f"{k!r}::DOUBLE * {outer}({2 * j} * xi) * {hyper(s, f'{2 * j} * eta')}" for j, k in enumerate(alpha, 1))
    return f"""{name}_a AS (SELECT *, sin(radians(lat)) AS s, radians(lon + 93) AS lam FROM {source}),
{name}_b AS (SELECT *, {hyper('-', f"{at('s')} - {e!r}::DOUBLE * {at(f'({e!r}::DOUBLE * s)')}")} AS t FROM {name}_a),
{name}_c AS (SELECT *, atan2(t, cos(lam)) AS xi, {at('(sin(lam) / sqrt(1 + t * t))')} AS eta FROM {name}_b),
{name} AS (SELECT *, 500000 + {radius!r}::DOUBLE * (eta + {plane('cos', '-')}) AS x, {radius!r}::DOUBLE * (xi + {plane('sin', '+')}) AS y FROM {name}_c)"""


def _from_plane(source: str, name: str, x: str, y: str, lon: str, lat: str) -> str:
    """CTEs <name>: source's columns with longitude and latitude of (x, y) in zone 15 north."""
    n = (1 / 298.257223563) / (2 - 1 / 298.257223563)
    radius = 6378137 / (1 + n) * (1 + n * n / 4 + n**4 / 64) * 0.9996
    beta = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4)
    delta = (2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4, 7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4, 56 / 15 * n**3 - 136 / 35 * n**4, 4279 / 630 * n**4)
    hyper = lambda s, z: f"((exp({z}) {s} exp(-({z}))) / 2)"
    back = lambda outer, s: " + ".join(f"{k!r}::DOUBLE * {outer}({2 * j} * p) * {hyper(s, f'{2 * j} * q')}" for j, k in enumerate(beta, 1))
    return f"""{name}_a AS (SELECT *, ({y}) / {radius!r}::DOUBLE AS p, ({x} - 500000) / {radius!r}::DOUBLE AS q FROM {source}),
{name}_b AS (SELECT * EXCLUDE (p, q), p - ({back('sin', '+')}) AS p1, q - ({back('cos', '-')}) AS q1 FROM {name}_a),
{name}_c AS (SELECT *, asin(sin(p1) / {hyper('+', 'q1')}) AS chi FROM {name}_b),
{name} AS (SELECT * EXCLUDE (p1, q1, chi), degrees(atan2({hyper('-', 'q1')}, cos(p1))) - 93 AS {lon}, degrees(chi + {" + ".join(f"{k!r}::DOUBLE * sin({2 * j} * chi)" for j, k in enumerate(delta, 1))}) AS {lat} FROM {name}_c)"""


_CITIES = "cities AS (SELECT c_custkey AS id, -93.0::DOUBLE + (c_custkey % 41 - 20) / 8.0::DOUBLE AS lon, 30.0::DOUBLE + (c_custkey % 97) / 10.0::DOUBLE AS lat FROM customer)"
_NODES = """nodes0 AS (SELECT c_custkey AS id, ((c_custkey * 37) % 360 - 180)::DOUBLE AS lon, ((c_custkey * 13) % 150 - 75)::DOUBLE AS lat, c_custkey % 23 - 11.0::DOUBLE AS ve, c_custkey % 17 - 8.0::DOUBLE AS vn, c_custkey % 7 - 3.0::DOUBLE AS vu,
  c_custkey % 3 + 0.4::DOUBLE AS sigma_ve, c_custkey % 4 + 0.5::DOUBLE AS sigma_vn, c_custkey % 5 + 1.2::DOUBLE AS sigma_vu, CASE WHEN c_custkey % 9 = 0 THEN 0.0::DOUBLE ELSE -0.6::DOUBLE END AS le, CASE WHEN c_custkey % 9 = 0 THEN 0.0::DOUBLE ELSE -0.1::DOUBLE END AS ln FROM customer),
nodes AS (SELECT *, sqrt(1 - le * le - ln * ln) AS lu FROM nodes0)"""


def _inside(area: str, lon: str = "lon", lat: str = "lat") -> str:
    """Whether a point lies in an area: its crossings of all edges to its right are odd in number."""
    terms = []
    for name, ring in _RINGS:
        if name == area:
            for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
                if y0 != y1:
                    terms.append(f"CASE WHEN ({y0} > {lat}) <> ({y1} > {lat}) AND {lon} < ({x1}::DOUBLE - {x0}) * ({lat} - {y0}) / ({y1}::DOUBLE - {y0}) + {x0} THEN 1 ELSE 0 END")
    return f"(({' + '.join(terms)}) % 2 = 1)"


def _tropo_modes() -> str:
    q = lambda p: f"quantile_cont(v * 10, {p}::DOUBLE)"
    return f"""WITH {O.SCENE}, b AS (SELECT frame, (r // 5)::INTEGER AS block, {q(0.95)} - {q(0.05)} AS relief FROM scene WHERE v IS NOT NULL GROUP BY ALL)
SELECT frame, block, CASE block % 5 WHEN 0 THEN CASE WHEN block % 2 = 0 THEN 'full' ELSE 'off' END WHEN 1 THEN 'off' WHEN 2 THEN 'stratified' WHEN 3 THEN 'full' ELSE CASE WHEN relief >= 1500 THEN 'stratified' ELSE 'off' END END AS mode, {O.r("relief")} AS relief FROM b"""


def _cube() -> str:
    z = "(vec_id * 37 + i * 911) % 4300"
    place = f"CASE WHEN {z} <= 500 THEN ({z}) / 500.0::DOUBLE WHEN {z} <= 1500 THEN 1 + ({z} - 500) / 1000.0::DOUBLE WHEN {z} <= 4000 THEN 2 + ({z} - 1500) / 2500.0::DOUBLE END"
    return f"""WITH cube AS (SELECT vec_id, (p // 16)::INTEGER AS k, (p % 16 // 4)::INTEGER AS r, (p % 4)::INTEGER AS c, CASE WHEN p % 13 <> 5 THEN embedding[p + 1]::DOUBLE ELSE 0.0::DOUBLE END AS v FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS p FROM embeddings)),
points AS (SELECT vec_id, i, {place} AS z, ((vec_id + i * 5) % 13) / 4.0::DOUBLE AS y, ((vec_id * 3 + i) % 14) / 4.0::DOUBLE AS x FROM (SELECT vec_id, unnest(range(0, 6))::INTEGER AS i FROM embeddings)),
met AS (SELECT p.*, cube.v, (1 - abs(p.z - cube.k)) * (1 - abs(p.y - cube.r)) * (1 - abs(p.x - cube.c)) AS w FROM points p LEFT JOIN cube ON cube.vec_id = p.vec_id AND abs(p.z - cube.k) < 1 AND abs(p.y - cube.r) < 1 AND abs(p.x - cube.c) < 1)
SELECT vec_id, i, round(CASE WHEN any_value(z) IS NOT NULL AND any_value(y) <= 3 AND any_value(x) <= 3 THEN sum(w * v) END::FLOAT::DOUBLE, 5) AS delay FROM met GROUP BY vec_id, i"""


def _loclin_blend() -> str:
    s = 2.0
    moments = ["s0", "sx", "sy", "sxx", "sxy", "syy", "r0", "rx", "ry"]
    x, y = f"(c / {s}::DOUBLE)", f"(r / {s}::DOUBLE)"
    det = "nullif(a * (e * k - h * h) - b * (b * k - h * d) + d * (b * h - e * d), 0)"
    beta = "least(greatest((s0 - 0.1::DOUBLE) / (0.35::DOUBLE - 0.1::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)"
    return f"""WITH {O.GAPPY}, src AS (SELECT vec_id, r, c, coalesce(v, 0.0::DOUBLE) AS v, CASE WHEN v IS NOT NULL THEN (1 + coherence) / 4 ELSE 0.0::DOUBLE END AS w FROM gappy),
f AS (SELECT vec_id, r, c, w, CASE WHEN w > 0 THEN v ELSE 0 END AS f FROM src),
moments AS (SELECT vec_id, r, c, w AS s0, w * {x} AS sx, w * {y} AS sy, w * {x} * {x} AS sxx, w * {x} * {y} AS sxy, w * {y} * {y} AS syy, w * f AS r0, w * {x} * f AS rx, w * {y} * f AS ry FROM f),
{O._gauss("moments", "vec_id", moments, 8, s, "g")}, {O._gauss("src", "vec_id", ["v"], 8, s, "base", mode="nearest")},
eq AS (SELECT vec_id, r, c, s0, r0, s0 + x AS a, sx - {x} * s0 AS b, sy - {y} * s0 AS d, sxx - 2 * {x} * sx + {x} * {x} * s0 + x AS e, sxy - {x} * sy - {y} * sx + {x} * {y} * s0 AS h, syy - 2 * {y} * sy + {y} * {y} * s0 + x AS k, rx - {x} * r0 AS p, ry - {y} * r0 AS q
  FROM (SELECT *, 1e-6::DOUBLE * greatest(s0, 1e-6::DOUBLE) AS x FROM g)),
lev AS (SELECT vec_id, r, c, s0, (r0 * (e * k - h * h) - b * (p * k - h * q) + d * (p * h - e * q)) / {det} AS level, {beta} * {beta} * (3 - 2 * {beta}) AS beta FROM eq)
SELECT vec_id, r, c, {O.r("beta * CASE WHEN beta > 0 THEN coalesce(level, v) ELSE 0 END + (1 - beta) * v", 5)} AS surface, {O.r("s0", 5)} AS coverage FROM lev JOIN base USING (vec_id, r, c)"""


def _seed_level() -> str:
    return f"""WITH {O.GAPPY}, blocks AS (SELECT vec_id, (r // 2)::INTEGER AS r, (c // 2)::INTEGER AS c, median(CASE WHEN coherence > 0.5 THEN v END) AS v FROM gappy GROUP BY ALL),
held AS (SELECT *, CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS m FROM blocks), {O._gauss("held", "vec_id", ["v", "m"], 4, 1.0, "g", mode="reflect")}
SELECT t.vec_id, t.r, t.c, {O.r("CASE WHEN g.m > 0 THEN g.v / g.m END", 5)} AS v FROM tiles t JOIN g ON g.vec_id = t.vec_id AND g.r = t.r // 2 AND g.c = t.c // 2"""


def _weighted_plane() -> str:
    x, y, w = "(c / 7.0::DOUBLE)", "(r / 7.0::DOUBLE)", "(1 + coherence)"
    s = {"a": w, "b": f"{w} * {x}", "d": f"{w} * {y}", "e": f"{w} * {x} * {x}", "h": f"{w} * {x} * {y}", "k": f"{w} * {y} * {y}", "p": f"{w} * v", "q": f"{w} * {x} * v", "u": f"{w} * {y} * v"}
    det = "(a * (e * k - h * h) - b * (b * k - h * d) + d * (b * h - e * d))"
    return f"""WITH {O.GAPPY}, s AS (SELECT vec_id, count(v) AS n, {", ".join(f"sum({e}) AS {n}" for n, e in s.items())} FROM gappy WHERE v IS NOT NULL GROUP BY vec_id),
f AS (SELECT vec_id, n, (p * (e * k - h * h) - b * (q * k - h * u) + d * (q * h - e * u)) / {det} AS c0, (a * (q * k - h * u) - p * (b * k - h * d) + d * (b * u - q * d)) / {det} AS c1, (a * (e * u - q * h) - b * (b * u - q * d) + p * (b * h - e * d)) / {det} AS c2 FROM s),
m AS (SELECT vec_id, sum({w} * (v - c0 - c1 * {x} - c2 * {y}) * (v - c0 - c1 * {x} - c2 * {y})) / greatest(any_value(n) - 3, 1) AS mse FROM gappy JOIN f USING (vec_id) WHERE v IS NOT NULL GROUP BY vec_id)
SELECT vec_id, n, round(c0, 5) AS c0, round(c1, 5) AS c1, round(c2, 5) AS c2, {O.r("mse")} AS mse FROM f JOIN m USING (vec_id)"""


def _regional_trend() -> str:
    return f"""WITH {O.GAPPY}, held AS (SELECT * FROM gappy WHERE v IS NOT NULL), one AS ({O._plane("v", "held", "vec_id", "c", "r")}),
rest AS (SELECT vec_id, r, c, v, v - (p0 + px * c + py * r) AS res FROM held JOIN one USING (vec_id)), med AS (SELECT vec_id, median(res) AS med FROM rest GROUP BY vec_id),
mad AS (SELECT vec_id, 1.4826::DOUBLE * median(abs(res - med)) AS mad FROM rest JOIN med USING (vec_id) GROUP BY vec_id),
kept AS (SELECT vec_id, r, c, v FROM rest JOIN mad USING (vec_id) WHERE abs(res) < 3 * mad), two AS ({O._plane("v", "kept", "vec_id", "c", "r")})
SELECT vec_id, {O.r("p0")} AS p0, {O.r("px")} AS px, {O.r("py")} AS py FROM two"""


def _reference_los() -> str:
    def one(grid: str, motion: float, sigma: float) -> str:
        look = "CASE WHEN le = 0 AND ln = 0 THEN NULL ELSE"
        return f"""SELECT id, '{grid}' AS grid, {O.r(f"{look} ve * {motion} * le + vn * {motion} * ln + vu * {motion} * lu END")} AS los,
{O.r(f"{look} sqrt(power(sigma_ve * {sigma} * le, 2) + power(sigma_vn * {sigma} * ln, 2) + power(sigma_vu * {sigma} * lu, 2)) END")} AS los_sigma FROM nodes"""

    return f"WITH {_NODES} {one('constant', -0.75, 0.75)} UNION ALL {one('variable', 0.25, 1.0)}"


def _event_footprints() -> str:
    """Vertices by the direct geodesic, its arc improved four times in CTEs."""
    arcs = ""
    for i in range(4):
        arcs += f"""a{i + 1} AS (SELECT * REPLACE (flat + b * sin(arc) * (cos(fst + arc) + b / 4 * (cos(arc) * (2 * cos(fst + arc) ** 2 - 1)
  - b / 6 * cos(fst + arc) * (4 * sin(arc) ** 2 - 3) * (4 * cos(fst + arc) ** 2 - 3))) AS arc) FROM a{i}),
"""
    return f"""
WITH q AS (SELECT s_suppkey::INTEGER AS event, (s_suppkey * 37 % 3600)::DOUBLE / 10 - 179.97::DOUBLE AS lon, (s_suppkey * 53 % 1400)::DOUBLE / 10 - 70 AS lat,
  pow(10.0::DOUBLE, ((s_suppkey % 30)::DOUBLE / 10 + 5) * 0.74::DOUBLE - 3.55::DOUBLE) AS rupture_km, (s_suppkey * 17 % 360)::DOUBLE AS strike, 6378137.0::DOUBLE * (1 - 1 / 298.257223563::DOUBLE) AS polar,
  1 / 298.257223563::DOUBLE AS f FROM supplier),
w AS (SELECT *, greatest(15.0::DOUBLE, rupture_km * 0.75::DOUBLE) AS buffer_km FROM q),
o AS (SELECT w.*, ord::INTEGER AS ord, CASE WHEN ord % 66 < 33 THEN 1 ELSE -1 END AS side, radians((ord % 33 - 16) * 5.625::DOUBLE) AS bearing FROM w, range(67) t(ord)),
p AS (SELECT *, side * (rupture_km / 2 + buffer_km * cos(bearing)) AS ahead, side * buffer_km * sin(bearing) AS rightward FROM o),
g AS (SELECT *, radians(strike) + atan2(rightward, ahead) AS az, 1000 * sqrt(ahead ** 2 + rightward ** 2) AS dist, atan((1 - f) * tan(radians(lat))) AS red FROM p),
h AS (SELECT *, cos(red) * sin(az) AS sa, 2 * atan2(tan(red), cos(az)) AS fst FROM g),
v AS (SELECT *, (1 - sa * sa) * (6378137.0::DOUBLE ** 2 - polar ** 2) / polar ** 2 AS u FROM h),
a0 AS (SELECT *, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS b, dist / (polar * (1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))))) AS flat, flat AS arc FROM v),
{arcs}z AS (SELECT *, f / 16 * (1 - sa * sa) * (4 + f * (4 - 3 * (1 - sa * sa))) AS k, cos(fst + arc) AS mid FROM a4),
e AS (SELECT *, atan2(sin(arc) * sin(az), cos(red) * cos(arc) - sin(red) * sin(arc) * cos(az)) - (1 - k) * f * sa * (arc + k * sin(arc) * (mid + k * cos(arc) * (2 * mid ** 2 - 1))) AS east,
  degrees(atan2(sin(red) * cos(arc) + cos(red) * sin(arc) * cos(az), (1 - f) * sqrt(sa * sa + (sin(red) * sin(arc) - cos(red) * cos(arc) * cos(az)) ** 2))) AS north FROM z),
l AS (SELECT *, lon + degrees(east) AS far FROM e)
SELECT event, ord, {O.r('rupture_km')} AS rupture_km, {O.r('buffer_km')} AS buffer_km, round(CASE WHEN far < -180 THEN far + 360 WHEN far >= 180 THEN far - 360 ELSE far END, 7) + 0 AS lon, round(north, 7) + 0 AS lat FROM l"""


def oracle_sql() -> dict[str, str]:
    year = lambda x: f"(year({x}) + (epoch_us({x}) - epoch_us(make_timestamp(year({x}), 1, 1, 0, 0, 0.0::DOUBLE)))::DOUBLE / (epoch_us(make_timestamp(year({x}) + 1, 1, 1, 0, 0, 0.0::DOUBLE)) - epoch_us(make_timestamp(year({x}), 1, 1, 0, 0, 0.0::DOUBLE)))::DOUBLE)"
    stamp = lambda i: f"try_strptime(tokens[{i}], '%Y%m%dT%H%M%SZ')"
    static = "OPERA_L3_DISP-S1-STATIC_F(\\d+)_(\\d{8})_(S1[ABCD])_v([\\d.]+)_(\\w+)\\.tif$"
    part = lambda i: f"nullif(regexp_extract(name, '{static}', {i}), '')"
    times = "list_sort(list_distinct(tokens[1:2]))"
    tokens = f"(SELECT *, regexp_extract_all(name, '\\d{{8}}T\\d{{6}}Z') AS tokens FROM {_NAME})"
    names_ = "(SELECT p_partkey, 'OPERA_L3_DISP-' || CASE WHEN p_partkey % 7 = 0 THEN 'STATIC' ELSE 'S1' END || '_IW_F' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') || '_VV_2022' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '11T002312Z_2023' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '22T002313Z_v0.5_20231101T000000Z.nc' AS name FROM part)"
    box = lambda f, c: f"{f}(" + ", ".join(f"{c}{i}" for i in range(4)) + ")"
    corners = [("x - 500", "y - 500"), ("x - 500", "y + 1500"), ("x + 1500", "y - 500"), ("x + 1500", "y + 1500")]
    chain, source = [], "back"
    for i, (px, py) in enumerate(corners):
        chain.append(_from_plane(source, f"k{i}", px, py, f"lo{i}", f"la{i}"))
        source = f"k{i}"
    n, m, k = "(p_partkey % 400 + 1)", "(p_partkey % 250 + 1)", "p_partkey"
    steps = "ELSE 1 END"
    for step in (3, 6, 12, 25, 50):
        steps = f"WHEN ceil({n}::DOUBLE / {step}) * ceil({m}::DOUBLE / {step}) >= 100 THEN {step} {steps}"
    t = f"least(greatest(({k} % 14) / 10.0::DOUBLE - 0.2::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)"
    half = math.sqrt(math.log(2) / 2) / math.pi
    coef = " + ".join(f"{c!r}::DOUBLE * {b}" for c, b in zip(_COEF, ("1", "(c / 10.0::DOUBLE)", "(r / 10.0::DOUBLE)", "coherence", "coherence * coherence"), strict=True))
    b = ("(c / 7.0::DOUBLE)", "(r / 7.0::DOUBLE)", "(c / 7.0::DOUBLE * (r / 7.0::DOUBLE))", "1.0::DOUBLE")
    quad = " + ".join(f"{_COVARIANCE[i][j]!r}::DOUBLE * {b[i]} * {b[j]}" for i in range(4) for j in range(4))
    decomposed = O.oracle_sql()["decompose_looks"]
    return {
        "product_sensor": f"""SELECT p_partkey, CASE WHEN regexp_matches(name, '^OPERA_L3_DISP-S1_[A-Z]+_F') THEN 'S1' WHEN regexp_matches(name, '^OPERA_L3_DISP-NISAR_') THEN 'NISAR' END AS sensor, {part(1)}::INTEGER AS static_frame, {part(2)} AS static_day, {part(3)} AS platform, {part(4)} AS static_version, {part(5)} AS layer, array_to_string({times}, ',') AS times,
round(CASE WHEN len(tokens) >= 2 THEN {year(stamp(1))} END, 7) + 0.0::DOUBLE AS ref_year, round(CASE WHEN len(tokens) >= 2 THEN {year(stamp(2))} WHEN len(tokens) = 1 THEN {year(stamp(1))} END, 7) + 0.0::DOUBLE AS sec_year, round(CASE p_partkey % 4 WHEN 0 THEN 0.02773288::DOUBLE WHEN 2 THEN 0.12065::DOUBLE END, 8) + 0.0::DOUBLE AS cycle FROM {tokens}""",
        "sensing_time_union": f"SELECT DISTINCT unnest({times}) AS time FROM {tokens}",
        "first_files": f"SELECT frame, ord, name FROM (SELECT p_partkey % 17 AS frame, row_number() OVER (PARTITION BY p_partkey % 17 ORDER BY name) AS ord, name FROM {names_}) WHERE ord <= 5",
        "one_file_a_frame": f"SELECT p_partkey // 2 AS frame, CASE WHEN count(*) = 1 THEN 'one' ELSE 'many' END AS state, CASE WHEN count(*) = 1 THEN min(name) END AS name FROM {names_} WHERE p_partkey % 3 <> 1 GROUP BY 1",
        "event_mask_files": f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(name, '.nc', '_a_area_mask.tif') END AS mask FROM {names_}",
        "series_span": f"""WITH {O.SERIES}, e AS (SELECT user_id, arg_min(t, ord) AS a, arg_max(t, ord) AS b FROM series GROUP BY 1) SELECT {O.r("min(a)", 8)} AS "first", {O.r("max(b)", 8)} AS "last" FROM e""",
        "missing_nodes": "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 6 = 0",
        "differential_layers": f"""WITH {O.PAIRS}, l AS (SELECT o_orderdate AS t, max(o_orderkey)::DOUBLE AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1)
SELECT pair_id, (b.v - a.v)::FLOAT::DOUBLE AS difference FROM pairs JOIN l a ON a.t = ref JOIN l b ON b.t = sec WHERE pair_id % 5 = 0""",
        "top_pieces": "SELECT user_id, count(*) AS cells FROM events GROUP BY 1 ORDER BY cells DESC, user_id LIMIT 10",
        "model_points": """SELECT * FROM (SELECT c_custkey AS ord, CASE WHEN (c_custkey * 37) % 360 > 180 THEN (c_custkey * 37) % 360 - 360 ELSE (c_custkey * 37) % 360 END::DOUBLE AS lon, ((c_custkey * 13) % 150 - 75)::DOUBLE AS lat, (c_custkey % 11) / 2.0::DOUBLE AS rate FROM customer WHERE c_custkey >= 6)
WHERE lon BETWEEN -120 AND 95 AND lat BETWEEN -40 AND 60""",
        "zone_coordinates": f"""WITH {_CITIES}, {_to_plane("cities", "p")}, pp AS (SELECT id, x, y FROM p), {_from_plane("pp", "back", "x", "y", "lon", "lat")}, {", ".join(chain)}
SELECT id, {O.r("x", 4)} AS x, {O.r("y", 4)} AS y, {O.r("lon", 8)} AS lon, {O.r("lat", 8)} AS lat, {O.r(box("least", "lo"), 8)} AS west, {O.r(box("least", "la"), 8)} AS south, {O.r(box("greatest", "lo"), 8)} AS east, {O.r(box("greatest", "la"), 8)} AS north FROM k3""",
        "stations_in_zone": f"WITH {_CITIES}, {_to_plane('cities', 'p')} SELECT id, {O.r('x', 4)} AS x, {O.r('y', 4)} AS y FROM p WHERE x > 390000 AND x < 610000 AND y > 3490000 AND y < 4010000",
        "window_arithmetic": f"""SELECT p_partkey, round_even({k} * 15.0::DOUBLE / 30, 0)::INTEGER AS pixels, {O.r(f"{t} * {t} * (3 - 2 * {t})")} AS step, greatest(ceil(({k} % 9) / 1000.0::DOUBLE * 1e6::DOUBLE / 900), 1)::INTEGER AS cells, 4 * greatest({n}, {m}) * 30.0::DOUBLE AS cutoff,
{O.r(f"CASE WHEN {n} > 1 THEN 2 * ({k} % {n})::DOUBLE / ({n} - 1) - 1 ELSE -1 END")} AS place, CASE {steps}::INTEGER AS every, coalesce(CASE WHEN {k} % 5 <> 0 THEN ({k} % 10) / 10.0::DOUBLE END, 0) >= 0.6::DOUBLE AS stable, 500000 + ({k} % 100 + 0.5::DOUBLE) * -30 AS centre, {O.r(f"{50000 * half!r}::DOUBLE / ({k} + 1)")} AS sigma, ({k} % 4)::DOUBLE AS k_grid FROM part""",
        "tropo_modes": _tropo_modes(),
        "tropo_component": f"""WITH {O.GAPPY} SELECT vec_id, r, c, {O.r(f"CASE vec_id % 3 WHEN 1 THEN CASE WHEN v IS NOT NULL THEN {coef} END WHEN 2 THEN coalesce(v, 0) END")} AS tropo FROM gappy""",
        "delay_at_heights": _cube(),
        "reference_los": _reference_los(),
        "rates_of_nodes": f"WITH {_NODES} SELECT id, lon, lat, ve, vn, vu, (SELECT count(*) FROM nodes) AS wanted, (SELECT count(*) FROM nodes WHERE id % 6 = 0) AS missing FROM nodes WHERE id % 6 <> 0",
        "nodes_outside_areas": f"WITH {_NODES} SELECT id AS node, lon, lat FROM nodes WHERE NOT {_inside('a')} AND NOT {_inside('b')}",
        "remove_restore_mask": f"""WITH {_NODES}, {O.PAIRS}, ev(event, t0) AS (VALUES ('a', TIMESTAMP '1993-06-10 04:00:00'), ('b', TIMESTAMP '1995-01-17 05:46:00'), ('b', TIMESTAMP '1997-11-08 10:02:00')),
act AS (SELECT DISTINCT pair_id, event FROM pairs JOIN ev ON ref <= t0 AND sec >= t0)
SELECT DISTINCT pair_id, id AS node FROM act, nodes WHERE event = 'a' AND {_inside('a')} OR event = 'b' AND {_inside('b')}""",
        "realisation_digest": f"WITH {_NODES} SELECT id, sha256(sha256('grid-' || id::VARCHAR) || sha256(printf('ve=%.3f|vn=%.3f|vu=%.3f', ve, vn, vu))) AS digest FROM nodes",
        "loclin_blend": _loclin_blend(),
        "labels_at_block_centres": f"WITH {O.SCENE} SELECT frame, (r // 3)::INTEGER AS r, (c // 3)::INTEGER AS c, label FROM scene WHERE r < 99 AND c < 99 AND r % 3 = 1 AND c % 3 = 1",
        "extent_of_data": f"WITH {O.TILES} SELECT vec_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM tiles WHERE v > 0.12::DOUBLE GROUP BY 1",
        "look_modes": f"SELECT l_orderkey % 50 AS part, count(*) FILTER (mode = 2) AS solved, count(*) FILTER (mode = 1) AS projected, count(*) FILTER (mode = 0) AS empty FROM ({decomposed}) GROUP BY 1",
        "polynomial_error": f"WITH {O.TILES} SELECT vec_id, r, c, {O.r(f'sqrt(greatest({quad}, 0)) * abs(v)')} AS sigma FROM tiles",
        "weighted_plane_fit": _weighted_plane(),
        "regional_trend": _regional_trend(),
        "seed_level": _seed_level(),
        "event_footprints": _event_footprints(),
        "merged_overrides": """SELECT s_suppkey::INTEGER AS frame_id, 'k_grid=1.5;' || CASE WHEN s_suppkey % 3 = 0 THEN 'tropo=off;weights.power=2;weights.robust=' || CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END ELSE 'tropo.mode=auto;weights.power=2;weights.robust=none' END AS params FROM supplier""",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: globals()[k] for k in oracle_sql()}
