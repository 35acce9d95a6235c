"""Session settings that the engine expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with UTC times, adaptive execution and Arrow; ``conf`` adds or overrides settings (dots as double underscores)."""
    builder = SparkSession.builder.master(master).appName("groundswell")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is set, a local session (tests) gets a folder of its own; a cluster an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not found and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder: what builds on it is planned anew, and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
