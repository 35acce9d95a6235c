"""Station tables and series, area catalogues and snapshots, read and written with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell.functions.scalars import wrap_longitude

SERIES = ("year", "east", "north", "up", "sigma_east", "sigma_north", "sigma_up")


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """id, lon (±180), lat of a white-space table without header."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("id"), wrap_longitude(F.get(parts, F.lit(1)).cast("double")).alias("lon"), F.get(parts, F.lit(2)).cast("double").alias("lat"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """id (the file's stem), ord (the row's place in its file) and the seven columns of station series; unreadable numbers are NULL.

    A file is read whole, as it is small (a row an epoch), so that places in it are known."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    lines = files.select("file", F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("ord", "value"))
    parts = F.split(F.trim("value"), r"\s+")
    numbers = [F.nanvl(F.get(parts, F.lit(i)).try_cast("double"), F.lit(None).cast("double")).alias(c) for i, c in enumerate(SERIES)]
    return lines.select(F.regexp_extract("file", r"^([^.]+)", 1).alias("id"), F.col("ord").cast("long").alias("ord"), *numbers)


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """id, name, t0, t1, magnitude, xs, ys of a versioned feature collection: a row for each ring of a polygon, holes included."""
    properties = "STRUCT<id: STRING, name: STRING, t0: STRING, t1: STRING, magnitude: DOUBLE>"
    geometry = "STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
    schema = f"version STRING, features ARRAY<STRUCT<properties: {properties}, geometry: {geometry}>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = whole.select(F.when(F.col("version").isNull(), F.raise_error(F.lit("a catalogue needs a version"))).otherwise(F.col("version")).alias("version"), F.explode("features").alias("f"))
    rows = rows.select("f", F.explode("f.geometry.coordinates").alias("ring"))
    ring = F.col("ring")
    time = lambda c: F.to_timestamp_ntz(F.regexp_replace(F.substring(F.col(c), 1, 19), "T", " "))
    return rows.select("f.properties.id", "f.properties.name", time("f.properties.t0").alias("t0"), time("f.properties.t1").alias("t1"), "f.properties.magnitude", F.transform(ring, lambda p: F.get(p, F.lit(0))).alias("xs"), F.transform(ring, lambda p: F.get(p, F.lit(1))).alias("ys"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path (from the folder down) and sha256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    top = path.rstrip("/").split("://")[-1].removeprefix("file:")
    below = F.substring_index(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), top + "/", -1)
    return files.select(below.alias("path"), F.sha2("content", 256).alias("sha256"))


def write_snapshot(df: DataFrame, path: str, by: str) -> None:
    """A snapshot is written once: a folder that exists is an error."""
    df.write.mode("errorifexists").partitionBy(by).parquet(path)


def write_decisions(df: DataFrame, path: str) -> None:
    """Decisions as CSV with a header, fractions to four places."""
    cols = [F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_product(df: DataFrame, path: str, *, by: tuple[str, ...] = ("frame_id", "pair_id")) -> None:
    """Product layers as single precision, partitioned by frame and pair."""
    cols = [F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").partitionBy(*[c for c in by if c in df.columns]).parquet(path)


def read_model_text(spark: SparkSession, path: str, *, skip: int = 6) -> DataFrame:
    """ord, lon (±180), lat, rate of a model's text table (lon, lat, rate), whose first ``skip`` lines are a header.

    Read whole: a model is a file of some megabytes, and lines are skipped by their place."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line")).where((F.col("ord") >= skip) & (F.trim("line") != ""))
    parts = F.split(F.trim("line"), r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).cast("double")
    return lines.select("ord", wrap_longitude(number(0)).alias("lon"), number(1).alias("lat"), number(2).alias("rate"))


def read_bursts(spark: SparkSession, path: str) -> DataFrame:
    """burst_id and its frames, from a JSON object of objects {"data": {burst: {"frame_ids": [...]}}}."""
    schema = "data MAP<STRING, STRUCT<frame_ids: ARRAY<INT>>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return whole.select(F.explode("data").alias("burst_id", "v")).select("burst_id", F.explode("v.frame_ids").alias("frame_id"))


def read_product(spark: SparkSession, path: str, *, layers: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    """frame_id, pair_id, r, c and layers of written products as doubles, NULL for NaN; ``optional`` layers that a product hasn't are NULL."""
    rows = spark.read.parquet(path)
    absent = [x for x in layers if x not in rows.columns]
    if absent:
        raise ValueError(f"the product has no layer {', '.join(absent)}")
    nan = lambda x: F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")).alias(x)
    more = [nan(x) if x in rows.columns else F.lit(None).cast("double").alias(x) for x in optional]
    return rows.select(*[k for k in ("frame_id", "pair_id", "r", "c") if k in rows.columns], *[nan(x) for x in layers], *more)


def bounds(df: DataFrame, keys: list[str]) -> DataFrame:
    """(south, west, north, east) of pixel centres (x, y)."""
    return df.groupBy(*keys).agg(F.min("y").alias("south"), F.min("x").alias("west"), F.max("y").alias("north"), F.max("x").alias("east"))
