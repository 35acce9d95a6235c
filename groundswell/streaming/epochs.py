"""Daily epochs and running slopes over a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_epochs(obs: DataFrame, key: str, *, value: str = "value", late: str = "2 days") -> DataFrame:
    """Mean, count and extremes a key and day; the same plan on a table and on a stream, where rows over ``late`` behind are left out."""
    rows = obs.withWatermark("ts", late) if obs.isStreaming else obs
    out = rows.groupBy(F.window("ts", "1 day").alias("w"), key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("day"), "mean", "n", "low", "high")


def running_slope(obs: DataFrame, key: str, *, value: str = "value") -> DataFrame:
    """Slope per day from mergeable sums: the state of a stream is one row of sums a key (use output mode update or complete)."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400e6) - F.lit(19_723.0)
    rows = obs.select(key, t.alias("t"), F.col(value).alias("y")).where("y IS NOT NULL")
    t, y = F.col("t"), F.col("y")
    s = rows.groupBy(key).agg(F.count(y).alias("n"), F.sum(t).alias("st"), F.sum(y).alias("sy"), F.sum(t * t).alias("stt"), F.sum(t * y).alias("sty"))
    return s.select(key, "n", F.try_divide(F.col("n") * F.col("sty") - F.col("st") * F.col("sy"), F.nullif(F.col("n") * F.col("stt") - F.col("st") * F.col("st"), F.lit(0.0))).alias("slope"))
