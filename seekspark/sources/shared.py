"""Tables that cut lineage: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and all runs on one machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
    return f"file:///tmp/checkpoints/seekspark-{os.getpid()}"


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, dropped when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; what is left then is in the shared folder, under our name
        pass


def kept(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes the table, in folders by a column if asked, and returns one that reads it."""
    spark = df.sparkSession
    path = place(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
