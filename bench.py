"""Wall-clock of the headline queries; one JSON line."""

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell.operators.neighbourhood import loclin_surface
from groundswell.plans import catalogue, queries
from groundswell.session import session

HEADLINE = ["plane_calibration", "station_velocity_wls", "decompose_looks", "resample_linear", "resample_huber", "gaussian_smooth_constant", "local_linear_surface", "hann_blend_windows", "global_mad_outliers", "pair_event_overlap", "block_mean", "nearest_fill", "loclin_blend", "weighted_plane_fit", "delay_at_heights"]


def loclin_full_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local-linear surface of one full frame at its fit grid (1288 x 1577 cells of 180 m, 50 km cut-off), whatever the tables."""
    shape = (1288, 1577)
    i = F.col("id")
    cells = spark.range(shape[0] * shape[1]).select(F.lit(1).alias("frame"), F.floor(i / shape[1]).cast("int").alias("r"), (i % shape[1]).cast("int").alias("c"))
    cells = cells.select("*", (F.sin(F.col("r") / 90) + F.cos(F.col("c") / 70)).alias("v"), (((F.col("r") * 7 + F.col("c") * 3) % 10) / 10.0).alias("w"))
    return loclin_surface(cells, ["frame"], shape, pixel_m=180.0, cutoff_m=50_000.0)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    known = queries.queries() | catalogue.queries() | {"loclin_full_frame": loclin_full_frame}
    for name in [*HEADLINE, "loclin_full_frame"]:
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
