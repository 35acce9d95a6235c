"""Fields, series, looks, pairs, names and stations derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell.functions.scalars import decimal_year

TILE = (8, 8)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, r, c, v: an 8×8 field a vector."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return rows.select("vec_id", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).cast("int").alias("c"), F.col("v").cast("double").alias("v"))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with the cells where (3·vec_id + 5·r + 7·c) mod 11 < 2 invalid, and a coherence."""
    rows = tiles(spark, sf_dir)
    gap = (F.col("vec_id") * 3 + F.col("r") * 5 + F.col("c") * 7) % 11 < 2
    return rows.withColumn("v", F.when(~gap, F.col("v"))).withColumn("coherence", ((F.col("vec_id") + F.col("r") + F.col("c") * 2) % 10) / F.lit(10.0))


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, r, c, v (NULL where invalid), ok, label, coherence: frames of 100 × 100 cells."""
    e = read(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    k = F.regexp_extract("props", r"(\d+)", 1).cast("double") / 100
    i = F.col("event_id")
    return e.select(F.floor(i / 10000).cast("int").alias("frame"), F.floor(i % 10000 / 100).cast("int").alias("r"), (i % 100).cast("int").alias("c"), F.when(ok, F.col("value")).alias("v"), ok.alias("ok"), F.col("event_type").alias("label"), k.alias("coherence"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ord, t (decimal year), y, sigma."""
    e = read(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_id").alias("ord"), decimal_year("ts").alias("t"), F.col("value").alias("y"), (1 + F.col("event_id") % 5).cast("double").alias("sigma"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series with time in days from 2024."""
    e = read(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400e6) - F.lit(19_723.0)
    return e.select("user_id", F.col("event_id").alias("ord"), t.alias("t"), F.col("value").alias("y"))


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, los, sigma, e, n, u."""
    li = read(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", (F.col("l_extendedprice") / 1e5).alias("los"), (F.lit(0.01) + F.col("l_tax")).alias("sigma"), (F.when(F.col("l_linestatus") == "O", F.lit(-0.6)).otherwise(F.lit(0.6)) + F.col("l_discount")).alias("e"), F.lit(-0.1).alias("n"))
    return rows.withColumn("u", F.sqrt(1 - F.col("e") * F.col("e") - F.col("n") * F.col("n")))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon (0 to 360), lat."""
    k = F.col("n_nationkey").cast("long")
    return read(spark, sf_dir, "nation").select(k.alias("id"), ((k * 37) % 360).cast("double").alias("lon"), ((k * 13) % 150 - 75).cast("double").alias("lat"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey and the name of a product."""
    p = read(spark, sf_dir, "part")
    frame = F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0")
    month = F.lpad((F.col("p_partkey") % 12 + 1).cast("string"), 2, "0")
    kind = F.when(F.col("p_partkey") % 7 == 0, "STATIC").otherwise("S1")
    return p.select("p_partkey", F.concat(F.lit("OPERA_L3_DISP-"), kind, F.lit("_IW_F"), frame, F.lit("_VV_2022"), month, F.lit("11T002312Z_2023"), month, F.lit("22T002313Z_v0.5_20231101T000000Z.nc")).alias("name"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, ref, sec: thirty days from each order's date."""
    o = read(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select(F.col("o_orderkey").alias("pair_id"), day.alias("ref"), (day + F.expr("INTERVAL 30 DAYS")).alias("sec"))


#: A small catalogue of instants and windows.
EVENTS = (("quake-a", "1993-06-10 04:00:00", None), ("quake-b", "1995-01-17 05:46:00", None), ("quake-c", "1997-11-08 10:02:00", None), ("unrest-a", "1994-02-01 00:00:00", "1994-04-15 00:00:00"), ("unrest-b", "1996-07-01 00:00:00", "1996-07-20 00:00:00"), ("unrest-c", "1998-01-05 00:00:00", "1998-03-01 00:00:00"))


def events(spark: SparkSession) -> DataFrame:
    time = lambda c: F.col(c).cast("timestamp_ntz")
    return spark.createDataFrame([*EVENTS], "event STRING, t0 STRING, t1 STRING").select("event", time("t0").alias("t0"), time("t1").alias("t1"))
