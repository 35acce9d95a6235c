"""Tables of files: lookups by name, limits, and what is there once, twice or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def first_by_name(files: DataFrame, keys: list[str], most: int | None, name: str = "name") -> DataFrame:
    """Files in order of their names, numbered from 1, at most ``most`` of each group (None: all)."""
    rows = files.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(name)))
    return rows if most is None else rows.where(F.col("ord") <= most)


def the_one(files: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """keys, state (one, many) and the file where there is exactly one."""
    found = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("_name"))
    return found.select(*keys, F.when(F.col("n") == 1, "one").otherwise("many").alias("state"), F.when(F.col("n") == 1, F.col("_name")).alias(name))


def with_mask(products: DataFrame, masks: DataFrame, name: str = "name", mask: str = "mask") -> DataFrame:
    """Products with the first mask file (by name) that is called <stem>_...mask.tif; NULL where there is none.

    A mask's name is cut only after as many parts between underscores as some product's stem has, and the first mask of each
    stem is kept, so that the two meet in an equi-join and each product meets one row at most. Both sides are dealt out by
    stem: names made here are many times the table that Spark judges them by, too many to pass the driver."""
    parts = lambda c: F.size(F.split(c, "_"))
    stems = products.withColumn("_stem", F.regexp_replace(name, r"\.[^.]*$", ""))
    lengths = stems.where("_stem IS NOT NULL").agg(F.collect_set(parts("_stem")).alias("_lengths"))
    named = masks.where(F.col(mask).rlike(r"mask\.tif$")).select(F.col(mask).alias("_mask")).crossJoin(F.broadcast(lengths))
    cut = named.select("_mask", F.explode(F.filter("_lengths", lambda k: k < parts("_mask"))).alias("_k"))
    first = cut.groupBy(F.call_function("substring_index", "_mask", F.lit("_"), "_k").alias("_stem")).agg(F.min("_mask").alias("_mask"))
    return stems.join(first.hint("merge"), "_stem", "left").select(*products.columns, F.col("_mask").alias(mask))


def data_span(rows: DataFrame, file: str, time: str, order: str) -> DataFrame:
    """(first, last): the earliest first row and the latest last row of all files, by order in the file."""
    ends = rows.groupBy(file).agg(F.min_by(time, order).alias("a"), F.max_by(time, order).alias("b"))
    return ends.agg(F.min("a").alias("first"), F.max("b").alias("last"))


def not_obtained(wanted: DataFrame, obtained: DataFrame, keys: list[str]) -> DataFrame:
    """What was asked for and isn't there."""
    return wanted.select(*keys).distinct().join(obtained.select(*keys), keys, "left_anti")


def differences(pairs: DataFrame, layers: DataFrame, value: str = "v") -> DataFrame:
    """pairs (pair_id, ref, sec) with the layer at ``sec`` less that at ``ref`` in single precision, met by time; pairs lacking one go."""
    side = lambda s: layers.select(F.col("t").alias(s), F.col(value).alias(f"_{s}"))
    met = pairs.join(side("ref"), "ref").join(side("sec"), "sec")
    return met.select("pair_id", (F.col("_sec") - F.col("_ref")).cast("float").alias("difference"))


def largest(rows: DataFrame, label: str, most: int = 10) -> DataFrame:
    """The ``most`` labels with most rows, and how many those are; of equals the least label first."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("cells")).orderBy(F.desc("cells"), label).limit(most)


def area_map(points: DataFrame, skip: int = 0) -> DataFrame:
    """lon (to ±180), lat and rate of model points (lon 0 to 360), without the first ``skip`` by ``ord``."""
    return points.where(F.col("ord") >= skip).select("ord", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")).alias("lon"), "lat", "rate")
