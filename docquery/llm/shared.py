"""What the operators of this subpackage share: tables, the shared folder, row-local maps."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ready, table  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session that runs in one process (tests) gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="docquery-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already
        pass


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    The table goes when it's freed, or else when the driver's process ends.
    """
    spark = ready(df.sparkSession)
    path = f"{shared_dir(spark)}/docquery-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def free(*tables: DataFrame) -> None:
    """Remove settled tables that no plan reads any more, and let Spark drop the shuffles of plans that are gone."""
    for t in tables:
        _remove(t.sparkSession, t._settled)
    if tables:
        sweep(tables[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are gone; else they stay until the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
