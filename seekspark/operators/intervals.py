"""Joins of points with intervals, by equality of bins: no nested loop, whatever the intervals' lengths.

An interval lies in at most two bins of the power of two that is not shorter than it. A point is looked up once for each power
that any interval has, of which there are no more than 64. Counts and means by interval need no such join, as they are differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def micros(c: str | Column) -> Column:
    """Microseconds of a timestamp, so that times meet as whole numbers."""
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def interval_join(points: DataFrame, intervals: DataFrame, at: Column, start: Column, end: Column, by: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Points with the intervals they lie in, start <= at < end, of the same `by`.

    at, start and end are whole numbers made of the columns of their table; the two tables share no column but `by`. `how` is inner, or
    right to keep intervals without a point. Nulls and intervals that end before they begin hold nothing.
    """
    keys = by or []
    length = F.greatest(end - start, F.lit(1))
    level = F.ceil(F.log2(length.cast("double"))).cast("int")
    marked = intervals.withColumns({"_start": start, "_end": end}).withColumn("_id", F.monotonically_increasing_id())
    marked = marked.withColumn("_level", F.when((F.col("_start") < F.col("_end")), level))
    levels = [r[0] for r in marked.select("_level").where("_level is not null").distinct().collect()]  # at most 64
    bins = F.sequence(F.expr("shiftright(_start, _level)"), F.expr("shiftright(_end - 1, _level)"))
    held = marked.where("_level is not null").withColumn("_bin", F.explode(bins))
    where = F.explode(F.array(*(F.struct(F.lit(x).alias("_level"), F.shiftright(at, x).alias("_bin")) for x in sorted(levels)))) if levels else None
    if where is None:
        found = points.withColumns({"_at": at, "_level": F.lit(None).cast("int"), "_bin": F.lit(None).cast("long")})
    else:
        found = points.withColumn("_at", at).withColumn("_where", where).select("*", "_where.*").drop("_where")
    met = found.join(held, [*keys, "_level", "_bin"]).where("_start <= _at and _at < _end")
    if how == "right":
        rest = marked.join(met.select("_id").distinct(), "_id", "left_anti")
        met = met.unionByName(rest, allowMissingColumns=True)
    return met.drop("_start", "_end", "_id", "_level", "_bin", "_at")


#: Sums over buckets are differences of sums from the first point on, which decimals keep exact. What these do not hold meets its buckets one by one.
EXACT = "decimal(38,12)"


def bucketed(points: DataFrame, buckets: DataFrame, at: str, start: str, end: str, count: str = "queries", **means: str) -> DataFrame:
    """A row for each bucket, also those without a point: its columns, the number of points in it as `count`, and means of their columns.

    Of every time that a bucket begins or ends at, the points before it are counted and summed, range by range of the times; a bucket
    is a difference of two such rows. The work grows with points and buckets, and not with how many points the buckets hold together.
    """
    held = lambda c: F.col(c).try_cast(EXACT)
    off = lambda c: F.col(c).isNotNull() & ~F.coalesce(F.abs(held(c).cast("double") - F.col(c)) <= 1e-11 * F.abs(F.col(c)), F.lit(False)) | (F.abs(F.col(c)) > 1e14)
    sums = [F.count("*").alias("_n")]
    for i, c in enumerate(means.values()):
        sums += [F.count(c).alias(f"_n{i}"), F.sum(F.when(~off(c), held(c))).cast(EXACT).alias(f"_sum{i}"), F.count_if(off(c)).alias(f"_off{i}")]
    times = points.groupBy(micros(at).alias("_t")).agg(*sums).where("_t is not null").withColumn("_edge", F.lit(1))
    names = times.columns[1:-1]
    marked = buckets.withColumns({"_start": micros(start), "_end": micros(end)})
    edges = marked.where("_start < _end").select(F.explode(F.array("_start", "_end")).alias("_t")).distinct().withColumn("_edge", F.lit(0))
    x = times.unionByName(edges, allowMissingColumns=True).fillna(0, names)
    x = kept(x.repartitionByRange("_t").withColumn("_range", F.spark_partition_id()), "times")
    total = lambda w: {c: F.coalesce(F.sum(c).over(w).cast(times.schema[c].dataType), F.lit(0).cast(times.schema[c].dataType)) for c in names}
    each = x.groupBy("_range").agg(*(F.sum(c).cast(times.schema[c].dataType).alias(c) for c in names))
    before = each.withColumns(total(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))  # a row a range
    upto = x.withColumns(total(Window.partitionBy("_range").orderBy("_t", "_edge").rowsBetween(Window.unboundedPreceding, 0))).where("_edge = 0")
    upto = upto.join(F.broadcast(before.toDF("_range", *(f"_b{c}" for c in names))), "_range").select("_t", *((F.col(c) + F.col(f"_b{c}")).cast(times.schema[c].dataType).alias(c) for c in names))
    upto = kept(upto, "upto")
    a, b = upto.toDF(*(f"_a{c}" for c in upto.columns)), upto.toDF(*(f"_z{c}" for c in upto.columns))
    met = marked.join(a, (F.col("_start") == F.col("_a_t")) & (F.col("_start") < F.col("_end")), "left").join(b, (F.col("_end") == F.col("_z_t")) & (F.col("_start") < F.col("_end")), "left")
    of = lambda c: F.coalesce(F.col(f"_z{c}") - F.col(f"_a{c}"), F.lit(0))
    mean = lambda i: F.when(of(f"_n{i}") > 0, of(f"_sum{i}").cast("double") / F.when(of(f"_n{i}") > 0, of(f"_n{i}")))
    plain = F.lit(True)
    for i in range(len(means)):
        plain = plain & (of(f"_off{i}") == 0)
    met = met.withColumn("_plain", plain)
    out = met.where("_plain").select(*buckets.columns, of("_n").alias(count), *(mean(i).alias(m) for i, m in enumerate(means)))
    if times.where(" + ".join(["0", *(f"_off{i}" for i in range(len(means)))]) + " > 0").isEmpty():
        return out
    rest = interval_join(points, met.where("not _plain").select(*buckets.columns), micros(at), micros(start), micros(end))
    return out.unionByName(rest.groupBy(*buckets.columns).agg(F.count("*").alias(count), *(F.avg(c).alias(m) for m, c in means.items())))
