"""Sessions, and the package's way to Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def session(name: str = "docquery", **conf: str) -> SparkSession:
    """A session with the settings that the library counts on; the cluster's own win."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return ready(b.getOrCreate())


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find the package where the driver found it, if it isn't installed for them.

    Batches of long texts are bounded by bytes, unless the session has a bound of its own, so that a
    worker's memory doesn't depend on how long texts are.
    """
    if spark.conf.get(_BATCH, None) in (None, "67108864b"):  # unset, or Spark's default
        spark.conf.set(_BATCH, str(4 << 20))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")
