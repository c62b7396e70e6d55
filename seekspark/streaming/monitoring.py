"""The monitoring operators on streams: dashboard, trends, alerts, dedupe, strategy means, anomalies, chunk ingestion.

Each function takes a streaming DataFrame and gives one. `drain` runs a bounded stream to its end. What a stream writes is Parquet in
the shared folder, a folder for each micro-batch, with the checkpoint beside it: a batch that is tried again overwrites its own
folder, and a stream that is started again goes on where it stopped. Aggregates are written as updates, so state beyond the
watermark is evicted; readers keep each key's latest row.
"""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import chunking, monitor
from ..sources.shared import place
from .stateful import store_provider

RETENTION = "24 hours"
#: Size of the quantile sketch of a window.
SKETCH = 2400
#: Columns of which a dashboard has means over what succeeded.
MEANS = ["results", "similarity", "score"]


def source(spark: SparkSession, directory: str, name: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the table's files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}.parquet*").parquet(directory)


def dashboard(logs: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Dashboard columns of each (sliding) window; late events count for RETENTION.

    p95_ms and p99_ms are the least values with at least that share of the window's values up to them, from a quantile sketch in the
    window's state. It is exact up to SKETCH values; beyond, the rank is off by no more than about 2.3 / SKETCH^0.9 of all (0.2 %)
    with 99 % confidence, whatever the number of values.
    """
    g = monitor.scored(logs.withWatermark("ts", RETENTION)).groupBy(F.window("ts", width, slide or width))
    x = g.agg(*monitor.dashboard_columns(), F.kll_sketch_agg_double("response_ms", F.lit(SKETCH)).alias("ms"))
    ps = [F.kll_sketch_get_quantile_double("ms", F.lit(p)).alias(f"p{round(100 * p)}_ms") for p in (0.95, 0.99)]
    return x.select(F.col("window.start").alias("start"), "queries", "successes", "avg_ms", "avg_results", "avg_similarity", "avg_score", *ps)


def by_value(logs: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """The dashboard's counts and sums of each (sliding) window and response time: what `exact_dashboard` reads. Late events count for RETENTION.

    A window's state is a row for each of its different values, in the store that keeps state on disk, dealt out by window and value.
    """
    g = monitor.scored(logs.withWatermark("ts", RETENTION)).groupBy(F.window("ts", width, slide or width), "response_ms")
    ok = lambda c: F.when(F.col("success"), F.col(c))
    parts = [x for c in MEANS for x in (F.sum(ok(c)).alias(f"sum_{c}"), F.count(ok(c)).alias(f"n_{c}"))]
    x = g.agg(F.count("*").alias("queries"), F.count_if("success").alias("successes"), *parts)
    return x.select(F.col("window.start").alias("start"), *x.columns[1:])


def exact_dashboard(values: DataFrame) -> DataFrame:
    """Dashboard columns of each window, of what `by_value` wrote; p95_ms and p99_ms are the least values with at least that share of
    the window's values up to them."""
    mean = lambda total, n: F.when(n > 0, total / F.when(n > 0, n))
    ms = mean(F.sum(F.col("response_ms") * F.col("queries")), F.sum(F.when(F.col("response_ms").isNotNull(), F.col("queries"))))
    means = [mean(F.sum(f"sum_{c}"), F.sum(f"n_{c}")).alias(f"avg_{c}") for c in MEANS]
    x = values.groupBy("start").agg(F.sum("queries").alias("queries"), F.sum("successes").alias("successes"), ms.alias("avg_ms"), *means)
    p = monitor.percentiles(values.select("start", "response_ms", F.col("queries").alias("times")), "response_ms", [0.95, 0.99], ["start"], n="times", upper=True)
    return x.join(p.select("start", F.col("p95").alias("p95_ms"), F.col("p99").alias("p99_ms")), "start", "left")


def trends(logs: DataFrame, granularity: str = "1 day") -> DataFrame:
    return monitor.trends(monitor.scored(logs.withWatermark("ts", RETENTION)), granularity)


def alerts(logs: DataFrame) -> DataFrame:
    """Stateless: a row of the stream gives its alerts."""
    return monitor.alerts(monitor.scored(logs))


def once(logs: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event once within the watermark."""
    return logs.withWatermark("ts", RETENTION).dropDuplicatesWithinWatermark([key])


def sessions(logs: DataFrame, key: str = "query", gap: str = "30 minutes") -> DataFrame:
    """Session windows by key: the sliding expiry of a cache entry, as events see it."""
    g = logs.withWatermark("ts", RETENTION).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("queries"))
    return g.select(F.col("session_window.start").alias("start"), key, "queries")


def windowed_points(windows: DataFrame, points: DataFrame, key: str, length: str = "1 hour") -> DataFrame:
    """Each window (start, key, ...) with the points (ts, key, ...) of its key in the `length` from its start on.

    Both sides have watermarks and the join bounds the times, so a row leaves the state once nothing can meet it any more. Rows meet by
    key and span of `length`: a window lies in the spans from its start to its end, a point in one, so no row is held against all of its key.
    """
    w, p = windows.withWatermark("start", RETENTION), points.withWatermark("ts", RETENTION)
    span = lambda t: f"unix_micros({t}) div unix_micros(timestamp_seconds(0) + interval {length})"
    w = w.withColumn("_span", F.explode(F.expr(f"sequence({span('start')}, {span(f'start + interval {length}')})")))
    p = p.withColumnRenamed(key, "_key").withColumn("_in", F.expr(span("ts")))
    inside = (F.col(key) == F.col("_key")) & (F.col("_span") == F.col("_in")) & (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("start") + F.expr(f"interval {length}"))
    return w.join(p, inside).drop("_key", "_span", "_in")


def strategies(logs: DataFrame) -> DataFrame:
    """Running means of each strategy; the key is bounded, and so is the state."""
    return monitor.strategy_metrics(monitor.scored(logs))


def chunks(docs: DataFrame, strategy: str = "fixed") -> DataFrame:
    """Chunks of documents as they stream in."""
    return chunking.chunk(docs, strategy)


# --- running ---------------------------------------------------------------------


def store(stream: DataFrame, path: str, mode: str = "append", each=None):
    """Starts the stream into folders of `path`; `each` makes of a batch, and of the path, what is written of it."""

    def write(batch: DataFrame, number: int) -> None:
        out = each(batch, path, number) if each else batch
        out.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(availableNow=True).start()


def stored(spark: SparkSession, path: str, schema, keys: list[str] | None = None) -> DataFrame:
    """What a stream has written: all rows, or each key's latest."""
    fields = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(fields).parquet(f"{path}/rows") if _written(spark, path) else spark.createDataFrame([], fields)
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
        rows = rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
    return rows.drop("batch")


def _written(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drain(stream: DataFrame, keys: list[str] | None = None, each=None, schema=None, timers: bool = False) -> DataFrame:
    """Runs the stream over all that is there, and returns what it wrote; with keys it is an aggregate, written as updates."""
    path = place(stream.sparkSession, "stream")
    with store_provider(stream.sparkSession) if timers else nullcontext():
        store(stream, path, "update" if keys else "append", each).awaitTermination()
    return stored(stream.sparkSession, path, schema or stream.schema, keys)


def progress(query) -> list[dict]:
    """Of each micro-batch of a running or ended query: its number, rows and milliseconds."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["batchDuration"]} for p in query.recentProgress]


#: Samples that wait for the next batches; one that comes late is held against the one before it among these.
HELD = 1000


def sampled(samples: DataFrame, directory: str | None = None) -> DataFrame:
    """Anomalies of samples (at, efficiency, scans) as they stream in; each is held against the one before it by `at`, in its batch or
    among the last HELD before it. A batch without rows hands these on as they are."""
    spark = samples.sparkSession
    last = directory or place(spark, "last")

    def each(batch: DataFrame, path: str, number: int) -> DataFrame:
        before = spark.read.schema(batch.schema).parquet(f"{last}/{number - 1}") if number else batch.limit(0)
        both = batch.unionByName(before)
        both.orderBy(F.desc("at")).limit(HELD).write.mode("overwrite").parquet(f"{last}/{number}")
        return monitor.anomalies(both).join(before.select("at"), "at", "left_anti")

    return drain(samples, each=each, schema=monitor.anomalies_schema())
