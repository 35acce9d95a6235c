import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from groundswell.operators.files import with_mask
from groundswell.operators.joins import inside_polygons, sharing
from groundswell.plans import catalogue
from groundswell.sources import stations as T
from groundswell.streaming.epochs import daily_epochs


def test_station_text_and_manifest(spark, tmp_path):
    (tmp_path / "look.txt").write_text("A1 359.5 10\n\nB2  12.25 -3.5\n")
    (tmp_path / "s").mkdir()
    (tmp_path / "s/A1.tenv8").write_text("2015.0 1 2 3 .1 .2 .3 x\n2015.5 nan 2 3 .1 .2 .3 x\n")
    assert [(x.id, x.lon, x.lat) for x in T.read_lookup(spark, str(tmp_path / "look.txt")).orderBy("id").collect()] == [("A1", -0.5, 10.0), ("B2", 12.25, -3.5)]
    got = T.read_series(spark, str(tmp_path / "s")).orderBy("year").collect()
    assert got[0].id == "A1" and got[0].east == 1.0 and got[1].east is None
    assert len(T.manifest(spark, str(tmp_path / "s")).first().sha256) == 64


def test_areas_need_a_version(spark, tmp_path):
    ring = [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    whole = {"version": "1", "features": [{"properties": {"id": "a", "name": "n", "t0": "2019-07-06T03:19:53Z", "t1": None, "magnitude": 7.1}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}
    (tmp_path / "a.json").write_text(json.dumps(whole))
    got = T.read_areas(spark, str(tmp_path / "a.json")).first()
    assert got.id == "a" and got.t0.year == 2019 and got.t1 is None and got.xs == [0.0, 1.0, 0.0]


def test_streamed_epochs_equal_the_batch(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 3600) AS ts, id % 3 AS user_id, CAST(id AS DOUBLE) AS value FROM range(80)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(x.user_id, x.day): x.mean for x in daily_epochs(spark.read.parquet(str(tmp_path / "in")), "user_id").collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = daily_epochs(stream, "user_id").writeStream.outputMode("update").format("memory").queryName("epochs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(x.user_id, x.day): x.mean for x in spark.table("epochs").collect()} == batch


def test_manifest_has_paths_below_the_folder(spark, tmp_path):
    for name in ("a/x.tenv8", "b/x.tenv8", "b/c/y +z%.txt"):
        (tmp_path / "s" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "s" / name).write_text(name)
    got = {r.path: r.sha256 for r in T.manifest(spark, str(tmp_path / "s")).collect()}
    assert got == {n: hashlib.sha256(n.encode()).hexdigest() for n in ("a/x.tenv8", "b/x.tenv8", "b/c/y +z%.txt")}


def test_series_rows_are_numbered_in_their_files(spark, tmp_path):
    for name in "AB":
        (tmp_path / f"{name}.tenv8").write_text("".join(f"{2015 + k} {k} 0 0 .1 .2 .3\n" for k in range(4)) + "\n")
    got = [(r.id, r.ord, r.year) for r in T.read_series(spark, str(tmp_path)).orderBy("id", "ord").collect()]
    assert got == [(n, k, 2015.0 + k) for n in "AB" for k in range(4)]


def test_decisions_are_written_to_four_places(spark, tmp_path):
    rows = spark.createDataFrame([("p", 12345.678, None), ("q", -0.5, 1)], "pair string, jump double, cycles int")
    T.write_decisions(rows.coalesce(1), str(tmp_path / "d"))
    lines = next((tmp_path / "d").glob("*.csv")).read_text().splitlines()
    assert lines[0] == "pair,jump,cycles" and lines[1].startswith("p,12345.6780,") and lines[2] == "q,-0.5000,1"


def test_products_go_through_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 0, 0, 0.25, None), (1, 2, 0, 1, float("nan"), 1.0)], "frame_id int, pair_id int, r int, c int, calibration double, sigma double")
    T.write_product(rows, str(tmp_path / "p"))
    got = T.read_product(spark, str(tmp_path / "p"), layers=("calibration",), optional=("sigma", "tide")).orderBy("c").collect()
    assert [(x.frame_id, x.c, x.calibration, x.sigma, x.tide) for x in got] == [(1, 0, 0.25, None, None), (1, 1, None, 1.0, None)]
    with pytest.raises(ValueError, match="tide"):
        T.read_product(spark, str(tmp_path / "p"), layers=("tide",))
    T.write_snapshot(rows.withColumn("grid_type", F.lit("constant")), str(tmp_path / "s"), "grid_type")
    with pytest.raises(Exception, match="exist"):
        T.write_snapshot(rows.withColumn("grid_type", F.lit("constant")), str(tmp_path / "s"), "grid_type")


def test_model_text_bursts_and_holes(spark, tmp_path):
    (tmp_path / "m.txt").write_text("h\n" * 6 + "359.0 10 1.5\n\n12 -3 0.25\n")
    assert [(x.ord, x.lon, x.lat, x.rate) for x in T.read_model_text(spark, str(tmp_path / "m.txt")).orderBy("ord").collect()] == [(6, -1.0, 10.0, 1.5), (8, 12.0, -3.0, 0.25)]
    (tmp_path / "b.json").write_text(json.dumps({"data": {"t1_iw1": {"frame_ids": [3, 4]}, "t1_iw2": {"frame_ids": [4]}}}))
    assert sorted((x.burst_id, x.frame_id) for x in T.read_bursts(spark, str(tmp_path / "b.json")).collect()) == [("t1_iw1", 3), ("t1_iw1", 4), ("t1_iw2", 4)]
    rings = [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]], [[3.0, 3.0], [6.0, 3.0], [6.0, 6.0], [3.0, 6.0]]]
    whole = {"version": "1", "features": [{"properties": {"id": "a", "name": "n"}, "geometry": {"type": "Polygon", "coordinates": rings}}]}
    (tmp_path / "a.json").write_text(json.dumps(whole))
    areas = T.read_areas(spark, str(tmp_path / "a.json"))
    points = spark.createDataFrame([(1.0, 1.0), (4.0, 4.0), (12.0, 4.0), (1.0, 1.0), (None, 1.0)], "x double, y double")
    got = [(x.x, x.inside) for x in inside_polygons(points, areas.select("id", "xs", "ys")).collect()]
    assert areas.count() == 2 and sorted(got, key=str) == sorted([(1.0, True), (1.0, True), (4.0, False), (12.0, False), (None, False)], key=str)


def test_a_product_meets_one_mask_and_no_mask_passes_the_driver(spark):
    products = [(1, "a.nc"), (2, "a_b.nc"), (2, "a_b.nc"), (3, "a_b_c.v1.nc"), (4, "z.nc"), (5, None)]  # one row twice
    masks = ["a_b_c_mask.tif", "a_b_mask.tif", "a_mask.tif", "a_b_c.v1_x_mask.tif", "z_mask.tiff", "zz_mask.tif", "a_b.tif", "mask.tif", None]
    out = with_mask(spark.createDataFrame(products, "k int, name string"), spark.createDataFrame([(m,) for m in masks * 2], "mask string"))
    fits = lambda stem: [m for m in masks if m and m.startswith(f"{stem}_") and m.endswith("mask.tif")]
    want = [(k, n, min(fits(n.rsplit(".", 1)[0]), default=None) if n else None) for k, n in products]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_ids_that_share_several_keys_meet_once(spark, block):
    left = [(i, k) for i in range(40) for k in "abcd" if (i * 7 + ord(k)) % 3] * 2 + [(50, None), (None, "a")]
    right = [(i, k) for i in range(90) for k in "bcde" if (i * 5 + ord(k)) % 4 == 1] + [(95, "x"), (96, None)]
    out = sharing(spark.createDataFrame(left, "p long, key string"), spark.createDataFrame(right, "n long, key string"), "p", "n", "key", block=block)
    want = {(p, n) for p, k in left for n, m in right if k and k == m and p is not None}
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_masks_of_pairs_are_not_shuffled_row_by_row(spark):
    plan = catalogue.remove_restore_mask(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Repartition")] and plan.count("Generate explode(_a#") == plan.count("Generate explode(_b#") == 1


def test_masks_have_all_pairs_that_an_event_affects(spark):
    d = "/root/testdata/sf0.001"
    shocks = [datetime(1993, 6, 10, 4), datetime(1995, 1, 17, 5, 46), datetime(1997, 11, 8, 10, 2)]
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz")).collect()
    want = {k for k, day in orders if any(day <= t <= day + timedelta(days=30) for t in shocks)}
    got = catalogue.remove_restore_mask(spark, d)
    assert {x.pair_id for x in got.select("pair_id").distinct().collect()} == want and any(k % 40 for k in want)


def test_rows_of_a_block_are_not_held_at_once(spark):
    out = sharing(spark.createDataFrame([(i, "a") for i in range(9)], "p long, key string"), spark.createDataFrame([(i, "a") for i in range(7)], "n long, key string"), "p", "n", "key")
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = plan[: plan.index("REPARTITION_BY_NUM")]
    assert dealt.index("Generate explode(_b#") < dealt.index("Coalesce") < dealt.index("Generate explode(_a#") and "Aggregate" not in dealt
    assert out.count() == 63
