"""Search quality from query logs: score, alerts, dashboard, trends. The same columns serve tables and streams.

Logs are rows (event_id, ts, query, response_ms, results, similarity, diversity, success, strategy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import kept

MAX_MS, MIN_RESULTS, MIN_SCORE = 250.0, 6, 85.0


def quality_score(ms: Column, n: Column, similarity: Column, diversity: Column, success: Column) -> Column:
    """0 to 100: 40 for speed, 25 for enough results, 20 for similarity, 15 for diversity."""
    speed = F.when(ms <= MAX_MS, 40 * (1 - F.least(ms / MAX_MS, F.lit(1.0)))).otherwise(0.0)
    enough = F.when(n >= MIN_RESULTS, 25.0).otherwise(25.0 * n / MIN_RESULTS)
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), speed + enough + 20 * similarity + 15 * diversity))
    return F.when(success & (n > 0), score).otherwise(0.0)


def scored(logs: DataFrame) -> DataFrame:
    c = F.col
    return logs.withColumn("score", quality_score(c("response_ms"), c("results"), c("similarity"), c("diversity"), c("success")))


def alerts(logs: DataFrame) -> DataFrame:
    """(event_id, ts, alert, severity): what is wrong with each scored query."""
    c = F.col
    of = lambda cond, name, severity: F.when(cond, F.struct(F.lit(name).alias("alert"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(
        of(c("response_ms") > MAX_MS, "SlowResponse", "Warning"), of(c("success") & (c("results") < MIN_RESULTS), "FewResults", "Warning"), of(c("success") & (c("score") < MIN_SCORE), "LowQuality", "Critical"), of(~c("success"), "Failure", "Critical"),
    ))
    return logs.select("event_id", "ts", F.explode(found).alias("x")).select("event_id", "ts", "x.*")


def percentile(values: Column, p: float) -> Column:
    """Of a sorted array: the element at the lower index, without interpolation."""
    return F.try_element_at(values, F.floor(p * (F.size(values) - 1)).cast("int") + 1)


def dashboard_columns() -> list[Column]:
    ok = lambda c: F.avg(F.when(F.col("success"), F.col(c)))
    return [F.count("*").alias("queries"), F.count_if("success").alias("successes"), F.avg("response_ms").alias("avg_ms"), ok("results").alias("avg_results"), ok("similarity").alias("avg_similarity"), ok("score").alias("avg_score")]


def percentiles(logs: DataFrame, column: str, ps: list[float], by: list[str] | None = None, ranges: int = 1024, most: int = 10_000, n: str | None = None, upper: bool = False) -> DataFrame:
    """Lower-index percentiles by a distributed ranking: no group is gathered to one task. Rows may stand for `n` values each; with
    `upper` a percentile is the least value with at least that share of the values up to it.

    Values fall into `ranges` of equal width between the least and the largest; counts of the ranges, a bounded number for each
    group, tell in which of them a rank lies. While such a range has more than `most` distinct values it is cut into `ranges` again, so
    outliers and long tails do not make it large. Only what is left is put in order.
    """
    keys = by or []
    counts = logs.where(F.col(column).isNotNull()).groupBy(*keys, column).agg((F.sum(n) if n else F.count("*")).alias("n"))
    counts = kept(counts.withColumn("v", F.col(column).cast("double")), "counts")
    total = counts.groupBy(*keys).agg(F.sum("n").alias("all"), F.min("v").alias("low"), F.max("v").alias("high"))
    rank = F.array(*(F.ceil(F.lit(p) * F.col("all")) - 1 if upper else F.floor(F.lit(p) * (F.col("all") - 1)) for p in ps))
    asked = total.select(*keys, "low", "high", F.lit(0).cast("long").alias("base"), F.posexplode(rank).alias("p", "rank"))
    together = [F.col(f"c.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    for _ in range(8):  # 1024 to the eighth is more than there are doubles between two powers of two
        inside = counts.alias("c").join(asked.alias("a"), [*together, F.col("v").between(F.col("low"), F.col("high"))])
        inside = inside.select(*(F.col(f"a.{k}") for k in keys), "p", "rank", "base", "low", "high", "v", "n")
        step = (F.col("high") - F.col("low")) / ranges
        slot = F.when(step > 0, F.least(F.lit(ranges - 1), F.floor((F.col("v") - F.col("low")) / F.when(step > 0, step)))).otherwise(0)
        sums = inside.groupBy(*keys, "p", "rank", "base", slot.alias("slot")).agg(F.sum("n").alias("n"), F.count("*").alias("distinct"), F.min("v").alias("low"), F.max("v").alias("high"))
        sums = sums.withColumn("to", F.col("base") + F.sum("n").over(Window.partitionBy(*keys, "p").orderBy("slot")))
        now = sums.where((F.col("rank") < F.col("to")) & (F.col("rank") >= F.col("to") - F.col("n")))
        now = kept(now.select(*keys, "p", "rank", (F.col("to") - F.col("n")).alias("base"), "low", "high", "distinct"), "asked")
        asked = now.drop("distinct")
        if now.where(F.col("distinct") > most).isEmpty():
            break
    inside = counts.alias("c").join(asked.alias("a"), [*together, F.col("v").between(F.col("low"), F.col("high"))])
    inside = inside.select(*(F.col(f"a.{k}") for k in keys), "p", "rank", "base", F.col(f"c.{column}").alias(column), "n")
    found = inside.withColumn("upto", F.col("base") + F.sum("n").over(Window.partitionBy(*keys, "p").orderBy(column)))
    at = lambda i: F.min(F.when((F.col("p") == i) & (F.col("upto") > F.col("rank")), F.col(column)))
    return found.groupBy(*keys).agg(*(at(i).alias(f"p{round(p * 100)}") for i, p in enumerate(ps)))


def trends(logs: DataFrame, granularity: str = "1 day") -> DataFrame:
    """(start, queries, avg_ms, avg_score, success_rate) of each bucket that has queries."""
    g = logs.groupBy(F.window("ts", granularity)).agg(F.count("*").alias("queries"), F.avg("response_ms").alias("avg_ms"), F.avg("score").alias("avg_score"), F.avg(F.col("success").cast("double")).alias("success_rate"))
    return g.select(F.col("window.start").alias("start"), "queries", "avg_ms", "avg_score", "success_rate")


def direction(points: DataFrame, value: str, order: str = "start") -> DataFrame:
    """(n, head, tail, change, direction): means of the first and last min(10, n div 2) points, five percent either way."""
    n = points.withColumns({"a": F.row_number().over(Window.orderBy(order)), "d": F.row_number().over(Window.orderBy(F.desc(order))), "n": F.count("*").over(Window.partitionBy())})
    m = F.least(F.lit(10), F.floor(F.col("n") / 2))
    x = n.agg(F.count("*").alias("n"), F.avg(F.when(F.col("a") <= m, F.col(value))).alias("head"), F.avg(F.when(F.col("d") <= m, F.col(value))).alias("tail"))
    change = F.when(F.col("head") != 0, (F.col("tail") - F.col("head")) / F.when(F.col("head") != 0, F.col("head"))).otherwise(0.0)
    x = x.withColumn("change", change)
    return x.withColumn("direction", F.when(F.col("n") < 2, "Stable").when(F.col("change") > 0.05, "Improving").when(F.col("change") < -0.05, "Degrading").otherwise("Stable"))


def top_queries(logs: DataFrame, k: int = 10) -> DataFrame:
    return logs.groupBy("query").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score")).orderBy(F.desc("n"), "query").limit(k)


def strategy_metrics(logs: DataFrame) -> DataFrame:
    """(strategy, uses, avg_ms, avg_similarity, satisfaction)."""
    return logs.groupBy("strategy").agg(F.count("*").alias("uses"), F.avg("response_ms").alias("avg_ms"), F.avg("similarity").alias("avg_similarity"), F.avg(F.when(F.col("success"), F.col("score"))).alias("satisfaction"))


def overall(metrics: DataFrame) -> DataFrame:
    """Sum of uses, means of the strategies' means, and the strategies used most and liked best."""
    return metrics.agg(F.sum("uses").alias("uses"), F.avg("avg_ms").alias("avg_ms"), F.avg("satisfaction").alias("satisfaction"), F.max_by("strategy", F.struct("uses", "strategy")).alias("most_used"), F.max_by("strategy", F.struct("satisfaction", "strategy")).alias("best"))


def best_by(logs: DataFrame, key: str) -> DataFrame:
    """The strategy with the best mean score for each value of `key`."""
    m = logs.groupBy(key, "strategy").agg(F.avg("score").alias("avg_score"), F.count("*").alias("uses"))
    w = Window.partitionBy(key).orderBy(F.desc(F.round("avg_score", 9)), "strategy")
    return m.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def insights(points: DataFrame) -> DataFrame:
    """A sentence each on speed and quality of a trend."""
    x = points.agg(F.avg("avg_ms").alias("ms"), F.avg(F.when(F.col("avg_score") > 0, F.col("avg_score"))).alias("q"))
    speed = F.when(F.col("ms") < MAX_MS, F.format_string("response time is good: %.1f ms", "ms")).otherwise(F.format_string("response time needs work: %.1f ms", "ms"))
    quality = F.when(F.col("q") > MIN_SCORE, F.format_string("quality is good: %.1f", "q")).otherwise(F.format_string("quality needs work: %.1f", "q"))
    return x.select(F.explode(F.array(speed, quality)).alias("insight"))


def slope(points: DataFrame, value: str, order: str) -> DataFrame:
    """(n, slope, direction, confidence): least squares over the place in the sequence."""
    x = points.withColumn("i", F.row_number().over(Window.orderBy(order)) - 1).agg(F.count("*").alias("n"), F.regr_slope(value, "i").alias("slope"))
    s = F.coalesce("slope", F.lit(0.0))
    return x.select("n", s.alias("slope"), F.when(s > 0.01, "Increasing").when(s < -0.01, "Decreasing").otherwise("Stable").alias("direction"), F.least(F.lit(1.0), F.abs(s) * 10).alias("confidence"))


def before(samples: DataFrame, value: str, order: str, parts: int | None = None) -> DataFrame:
    """Adds `previous`: the value of the row before in the whole order. Rows are split by ranges; a range's first row has its
    predecessor from the last rows of the ranges, one a partition, so no task orders all rows."""
    n = parts or int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = kept(samples.repartitionByRange(n, order).withColumn("range", F.spark_partition_id()), "ranges")
    last = x.groupBy("range").agg(F.max_by(value, order).alias("last"))
    last = last.select((F.lead("range").over(Window.orderBy("range"))).alias("range"), "last").where("range is not null")
    w = Window.partitionBy("range").orderBy(order)
    x = x.withColumn("previous", F.lag(value).over(w)).withColumn("first", F.row_number().over(w) == 1)
    return x.join(F.broadcast(last), "range", "left").withColumn("previous", F.when(F.col("first"), F.col("last")).otherwise(F.col("previous"))).drop("range", "first", "last")


def anomalies(samples: DataFrame) -> DataFrame:
    """(at, kind, severity) of samples (at, efficiency, scans): low efficiency, and jumps of scans since the sample before."""
    e = F.col("efficiency")
    low = F.when(e < 0.5, F.struct(F.lit("LowEfficiency").alias("kind"), F.when(e < 0.3, "High").when(e < 0.4, "Medium").otherwise("Low").alias("severity")))
    x = before(samples, "scans", "at").withColumn("jump", F.col("scans") - F.col("previous"))
    j = F.col("jump")
    more = F.when(j > 1000, F.struct(F.lit("ScanIncrease").alias("kind"), F.when(j > 10000, "High").when(j > 5000, "Medium").otherwise("Low").alias("severity")))
    return x.select("at", F.explode(F.array_compact(F.array(low, more))).alias("a")).select("at", "a.*")


def anomalies_schema():
    return T.StructType([T.StructField("at", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("severity", T.StringType())])


def monitoring_summary(samples: DataFrame, found: DataFrame) -> DataFrame:
    """One row on a period: samples, mean, least and largest efficiency, all scans, anomalies by severity."""
    x = samples.agg(F.count("*").alias("samples"), F.avg("efficiency").alias("avg_efficiency"), F.min("efficiency").alias("min_efficiency"), F.max("efficiency").alias("max_efficiency"), F.sum("scans").alias("scans"))
    of = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return x.join(F.broadcast(found.agg(of("High"), of("Medium"), of("Low"))))


def full_dashboard(logs: DataFrame, open_alerts: DataFrame) -> DataFrame:
    """The dashboard's columns with p95_ms and p99_ms, the hit rate (queries with results) and the number of open alerts."""
    x = logs.agg(*dashboard_columns(), F.avg((F.col("results") > 0).cast("double")).alias("hit_rate"))
    p = percentiles(logs, "response_ms", [0.95, 0.99]).select(F.col("p95").alias("p95_ms"), F.col("p99").alias("p99_ms"))
    return x.join(F.broadcast(p)).join(F.broadcast(open_alerts.agg(F.count("*").alias("active_alerts"))))


def recent(logs: DataFrame, k: int = 50) -> DataFrame:
    return logs.orderBy(F.desc("ts"), F.desc("event_id")).limit(k)


def resolved(raised: DataFrame, resolutions: DataFrame, as_of: str, retention: str = "24 hours") -> DataFrame:
    """(event_id, ts, alert, severity, resolved_at): alerts with what resolved them; those resolved longer ago than `retention` are gone.

    resolutions: (event_id, alert, resolved_at)."""
    last = resolutions.groupBy("event_id", "alert").agg(F.min("resolved_at").alias("resolved_at"))
    x = raised.join(last, ["event_id", "alert"], "left")
    old = F.col("resolved_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {retention}")
    return x.where(~F.coalesce(old, F.lit(False))).select("event_id", "ts", "alert", "severity", "resolved_at")


def reoptimised(logs: DataFrame, feedback: DataFrame, key: str = "kind") -> DataFrame:
    """(key, strategy, uses, satisfaction): the strategy to use for each kind of query, by the mean of users' ratings.

    feedback: (event_id, rating). Queries without a rating count with the score that they got, as a share of 100."""
    x = logs.join(feedback.groupBy("event_id").agg(F.avg("rating").alias("rating")), "event_id", "left")
    m = x.groupBy(key, "strategy").agg(F.count("*").alias("uses"), F.avg(F.coalesce("rating", F.col("score") / 100)).alias("satisfaction"))
    w = Window.partitionBy(key).orderBy(F.desc(F.round("satisfaction", 9)), "strategy")
    return m.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
