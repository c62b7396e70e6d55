"""A semantic result cache as a table (entry_id, query, vec, hits, created, last_used, expires)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import nearest

ENTRIES, LEAST = 10_000, 0.95


def lookup(cache: DataFrame, queries: DataFrame, least: float = LEAST) -> DataFrame:
    """(qid, entry_id, score): each query's nearest entry, if it is near enough."""
    hits = nearest.knn(cache.select(F.col("entry_id").alias("doc_id"), "vec"), queries.select("qid", "vec"), 1, min_score=least)
    return hits.select("qid", F.col("doc_id").alias("entry_id"), "score")


def live(cache: DataFrame, as_of: str) -> DataFrame:
    return cache.where(F.col("expires") > F.lit(as_of).cast("timestamp"))


def evict(cache: DataFrame, most: int = ENTRIES, policy: str = "LRU") -> DataFrame:
    """The `most` entries to keep: by last use, by hits or by expiry. A global order, kept by top-k and not by a window."""
    order = {"LRU": [F.desc("last_used")], "LFU": [F.desc("hits")], "TTL": [F.desc("expires")]}[policy]
    return cache.orderBy(*order, "entry_id").limit(most)


def expiring(cache: DataFrame, sliding: str = "15 minutes", absolute: str = "1 hour") -> DataFrame:
    """Sets `expires`: so long after the last use, but no longer after the entry was made."""
    return cache.withColumn("expires", F.least(F.col("last_used") + F.expr(f"interval {sliding}"), F.col("created") + F.expr(f"interval {absolute}")))


def similar(cache: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """(qid, entry_id, score, rank): the stored queries most like each query."""
    hits = nearest.knn(cache.select(F.col("entry_id").alias("doc_id"), "vec"), queries.select("qid", "vec"), k, min_score=least)
    return hits.withColumnRenamed("doc_id", "entry_id")


def evict_similar(cache: DataFrame, least: float = 0.95) -> DataFrame:
    """Entries without those that a more used one (then: the older by id) already answers for, however many are alike."""
    gone = nearest.outshone(cache.select(F.col("entry_id").alias("doc_id"), "vec", F.col("hits").alias("use")), least)
    return cache.join(gone.select(F.col("doc_id").alias("entry_id")), "entry_id", "left_anti")


def warm(cache: DataFrame, results: DataFrame, logs: DataFrame, k: int = 100) -> DataFrame:
    """Adds the results (query, vec) of the k queries asked most often that have no entry."""
    known = cache.select("query").distinct()
    often = logs.groupBy("query").agg(F.count("*").alias("n")).join(known, "query", "left_anti").orderBy(F.desc("n"), "query").limit(k)
    new = results.join(often, "query").select(F.xxhash64("query").alias("entry_id"), "query", "vec", F.col("n").cast("int").alias("hits"))
    return cache.select("entry_id", "query", "vec", "hits").unionByName(new)


def compact(cache: DataFrame, as_of: str) -> DataFrame:
    """Live entries, the latest of each query."""
    return put(live(cache, as_of), cache.limit(0))


def key(*parts: Column) -> Column:
    """Sixteen characters of the SHA-256 of what a cached result depends on, safe in addresses and file names."""
    digest = F.base64(F.unhex(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)))
    return F.substring(F.translate(digest, "+/", "-_"), 1, 16)


def usage(cache: DataFrame) -> DataFrame:
    """(entries, bytes): how many entries there are, and the size of their queries and vectors."""
    size = F.octet_length("query") + (8 * F.size("vec") if "vec" in cache.columns else F.lit(0))
    return cache.agg(F.count("*").alias("entries"), F.sum(size).cast("long").alias("bytes"))


def invalidate(cache: DataFrame, pattern: str) -> DataFrame:
    """Entries whose query does not match the pattern with * and ?."""
    return cache.where(~F.col("query").like(pattern.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")))


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The latest entry of each query stays."""
    w = Window.partitionBy("query").orderBy(F.desc("created"), "entry_id")
    return cache.unionByName(new).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def stats(lookups: DataFrame) -> DataFrame:
    """(hits, misses, hit_rate, avg_ms) of lookups (hit, ms)."""
    x = lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.avg("ms").alias("avg_ms"))
    n = F.col("hits") + F.col("misses")
    return x.select("hits", "misses", F.when(n > 0, F.col("hits") / F.when(n > 0, n)).otherwise(0.0).alias("hit_rate"), "avg_ms")
