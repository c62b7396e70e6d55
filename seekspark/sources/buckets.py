"""A stored table whose changes rewrite only the partitions they fall into: Parquet by buckets of the key, overwritten dynamically."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, kept

BUCKETS = 64


def bucketed(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Stores rows by buckets; each key is there once. How many buckets there are is chosen so that one is a task's work."""
    bucketed(rows, key, buckets).repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """Adds rows, in place of those with their keys."""
    _replace(spark, path, bucketed(new, key, buckets), new, key)


def delete(spark: SparkSession, path: str, ids: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    _replace(spark, path, None, ids, key, buckets)


def _replace(spark: SparkSession, path: str, new: DataFrame | None, ids: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """Rewrites the buckets of the ids; the next state is written aside first, so a job that fails before leaves the table as it was."""
    old = read(spark, path)
    touched = sorted(r[0] for r in (new if new is not None else bucketed(ids, key, buckets)).select("bucket").distinct().collect())  # at most a row a bucket
    state = old.where(F.col("bucket").isin(touched)).join(ids.select(key), key, "left_anti")
    state = kept(state.unionByName(new) if new is not None else state, "next")
    left = {r[0] for r in state.select("bucket").distinct().collect()}
    state.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for b in touched:  # a bucket that has lost all its rows is not overwritten
        if b not in left:
            drop(spark, f"{path}/bucket={b}")
