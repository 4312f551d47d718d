"""Session defaults, table loading and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Settings for a session that this library creates itself; a cluster's own settings are left alone.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("docmetrics").config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config(map=DEFAULTS)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, a Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once a row.

    A generator of one element: the optimizer neither merges projections over it nor pushes a filter on its output below
    it, so that a chain of steps isn't written out again for each use of a step.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through a reliable checkpoint.

    The folder is the one the session names in ``spark.checkpoint.dir``.  Where none is named, a local session gets a
    temporary folder; on a cluster the executors don't share such a folder, so there the call fails.  Spark removes
    the files once the returned frame is no longer referenced (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "docmetrics-checkpoints"))
    return df.checkpoint()


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, computed once, marked to be broadcast if it has at most ``most`` rows; a larger one is joined by a shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df
