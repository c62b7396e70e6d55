"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a document of a source whose target is r times its size should be
taken r times on average. It is taken floor(r) times for certain, and once more with the fractional part as probability.
These fractions are rounded dependently: two documents at a time pass probability between them, so much that their words
weighted by probability stay the same in sum, in a random direction with odds that keep each document's expectation, until
one of the two is 0 or 1. The other goes on to the next. Documents meet in order of size within a shard of their source, one
of each shard is left over, and the shards' leftovers meet in the same way up a tree of shards of shards.

Two documents of unlike sizes settle the smaller one, so what a tree of pairs leaves over is one of the largest. About `BALLAST`
documents of each source (half of a small one) therefore take no part in the pairs and wait at the root. There the transfers go on
from large to small, between a document and all smaller ones of its source as one partner: it gains all the words it lacks from
them, or loses all it has to them, each of them giving or getting in proportion to what it has or lacks, again with the odds that
keep every expectation. So the words that a source is off its target in the end are those of its smallest waiting document, unless
one document outweighs all that wait; what is left of such a one is drawn by its probability.

Random numbers are hashes of the documents' keys and the seed: reruns and retried tasks agree.

Defined results: null or wordless text: size 0, taken 0 and never paired. Rows equal in all columns are interchangeable. A null source
is a source of its own, after all others in order. Texts of any length
are counted whole. Repeated rows are documents of their own. If no document has a word, all targets
are 0. An empty table gives no row. Other columns are ignored by `mix_sources` and pass through `mixture`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, mix, spare

WEIGHTS, MOST, SHARD, FAN, BALLAST = (5.0, 2.0, 1.0), 3, 256, 64, 256
N_WORDS = "coalesce(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'), 0)"


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target and any other columns of `sizes`: shares of all words by weight, none above `most` times its source's size.

    Sources are numbered in code point order, null last, by a distributed sort; weights repeat along it. The excess of capped
    sources is shared out again by weight until no source is above its cap; each step is one sum over the sources.
    """
    spark = sizes.sparkSession
    # the in-partition number of a row of a saved, range-partitioned and sorted table, and the rows of the partitions before
    order = F.col("source").isNull(), F.col("source")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in sizes.columns if c not in ("source", "source_size")]
    placed = sizes.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("m"))
    placed = scratch.save(placed.select("source", "source_size", *others, F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("k")), "sources")
    before, at = {}, 0
    for part, rows in sorted(placed.groupBy("part").count().collect()):  # a row for each partition
        before[part], at = at, at + rows
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv)), F.col("part")) if before else F.lit(0)
    place = (offset + F.col("k")) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), place.cast("int") + 1)
    t = scratch.save(placed.select("source", "source_size", *others, weight.alias("weight")), "weights")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    cap, level = most * F.col("source_size"), None
    while True:
        full = F.lit(False) if level is None else cap <= F.col("weight") * level
        used, share, sources = t.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("long"))).first()
        if level is not None and sources == held or not share:
            break
        level, held = (total - used) / share, sources
    value = F.least(cap.cast("double"), F.col("weight") * F.lit(float(level or 0.0)))
    return t.select("source", "source_size", value.alias("target"), *others)


_ROW = "doc_id long, tkey long, source string, shard long, size long, source_size long, target double, whole int, p double"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _transfer(p: float, size: float, q: float, other: float, u: float) -> tuple[float, float]:
    """Probabilities after words have moved between two documents so that one of them is 0 or 1."""
    a, b = p * size, q * other
    gain, loss = min(size - a, b), min(a, other - b)
    if u * (gain + loss) < loss:  # the first gains, with the odds that leave its expectation as it was
        return (1.0 if gain == size - a else (a + gain) / size), (0.0 if gain == b else (b - gain) / other)
    return (0.0 if loss == a else (a - loss) / size), (1.0 if loss == other - b else (b + loss) / other)


def _pooled(size: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Probabilities, all 0 or 1, of documents in order of size: each in turn against all after it as one partner."""
    p = p.copy()
    for i in range(len(p)):
        later, rest = size[i + 1 :], p[i + 1 :]
        a, down = p[i] * size[i], float(later @ rest)
        up = float(later.sum()) - down
        gain, loss = min(size[i] - a, down), min(a, up)
        if gain + loss > 0:
            if u[i] * (gain + loss) < loss:
                a += gain
                rest *= 1 - gain / down if gain < down else 0.0
            else:
                a -= loss
                rest += (1 - rest) * (loss / up if loss < up else 1.0)
            rest[rest < 1e-12], rest[rest > 1 - 1e-12] = 0.0, 1.0
        q = a / size[i]
        p[i] = 0.0 if q < 1e-12 else 1.0 if q > 1 - 1e-12 else float(v[i] < q)  # words are left only where the partner had too few
    return p


def _rooted(seed: int):
    """Rows sorted by source and size: those of a source that wait at the root, settled. They are about BALLAST at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            size, p = b.column(4).to_numpy().astype(np.float64), b.column(8).to_numpy()
            return pa.RecordBatch.from_arrays([*b.columns[:8], pa.array(_pooled(size, p, _odds(b, seed), _odds(b, seed + 1)))], _NAMES)

        for b in batches:
            source = b.column(2).to_pylist()
            cuts = [0, *(i for i in range(1, len(source)) if source[i] != source[i - 1]), len(source)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    if held and held[-1].column(2)[0].as_py() != source[i]:
                        yield done()
                        held = []
                    held.append(b.slice(i, j - i))
        if held:
            yield done()

    return run


def _odds(b: pa.RecordBatch, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each row, by its key."""
    u = mix(mix(b.column(1).to_numpy().view(np.uint64) + np.uint64(seed)) ^ b.column(4).to_numpy().astype(np.uint64))
    return (u >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _settled(seed: int):
    """Rows sorted by source, shard and size: the fractions of each shard meet one after another; one at most is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, odds = None, None, 0.0  # the row that still has a fraction, and that fraction

        def left() -> list[tuple]:
            return [] if held is None else [(*held[:-1], odds)]

        for b in batches:
            out: list[tuple] = []
            for row, x in zip(zip(*(c.to_pylist() for c in b.columns), strict=True), _odds(b, seed).tolist(), strict=True):
                if row[2:4] != group:
                    out += left()
                    group, held, odds = row[2:4], row, row[-1]
                    continue
                q = row[-1]
                if held is not None:
                    odds, q = _transfer(odds, held[4], q, row[4], x)
                    if not 0 < odds < 1:
                        out.append((*held[:-1], odds))
                        held = None
                    else:
                        out.append((*row[:-1], q))
                        continue
                if 0 < q < 1:
                    held, odds = row, q
                else:
                    out.append((*row[:-1], q))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), b.schema.types, strict=True)], _NAMES)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(left()[0], b.schema.types, strict=True)], _NAMES)

    return run


def mix_sources(
    docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 11, key: Column | None = None
) -> DataFrame:
    """doc_id, tkey (`key`, or a hash of the text), source, size, source_size, target, copies, taken for every row of `docs`."""
    tkey = (F.xxhash64("text") if key is None else key).alias("tkey")
    sized = scratch.save(docs.select("doc_id", "source", tkey, F.expr(N_WORDS).cast("long").alias("size")), "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    wanted = scratch.save(targets(sizes, scratch, weights, most), "targets").withColumnRenamed("source", "s")
    rows = sized.join(wanted, sized.source.eqNullSafe(wanted.s)).drop("s")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(rate).cast("int")).withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0))
    n, shards = sized.count(), 1
    while shards * SHARD < n:
        shards *= FAN
    waits = F.pmod(F.xxhash64("doc_id", "tkey", F.lit(seed)), F.greatest(F.lit(2), F.ceil(F.col("docs") / BALLAST))) == 0
    rows = rows.withColumns({"shard": F.lit(0).cast("long"), "waits": waits})
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    halves = rows.where("p > 0 and p < 1")
    out = rows.where("p <= 0 or p >= 1").select(*_NAMES)
    root, open_ = halves.where("waits").select(*_NAMES), halves.where("not waits").select(*_NAMES)
    while shards >= 1:
        open_ = open_.withColumn("shard", F.pmod(F.xxhash64("tkey", "doc_id"), F.lit(shards)))
        open_ = open_.repartition(parts, "source", "shard").sortWithinPartitions("source", "shard", F.desc("size"), "doc_id", "tkey")
        level = scratch.save(open_.mapInArrow(_settled(seed), _ROW), f"level{shards}")
        out = out.unionByName(level.where("p <= 0 or p >= 1"))
        open_ = level.where("p > 0 and p < 1")
        shards //= FAN
        seed += 1
    root = root.unionByName(open_).repartition(parts, "source").sortWithinPartitions("source", F.desc("size"), "doc_id", "tkey")
    out = out.unionByName(scratch.save(root.mapInArrow(_rooted(seed), _ROW), "root"))
    copies = (F.col("whole") + F.col("p").cast("int")).cast("long")
    return out.select("doc_id", "tkey", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 11) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, all columns kept. Rows unlike in any column are apart."""
    maps = {f.name for f in docs.schema.fields if isinstance(f.dataType, T.MapType)}
    key = F.xxhash64(*(F.to_json(c) if c in maps else F.col(c) for c in docs.columns))
    mixed = mix_sources(docs, scratch, weights, most, seed, key)
    pid, tkey, n, i = (spare(x, docs) for x in ("pid", "tkey", "copies", "copy"))
    taken = mixed.where("copies > 0").groupBy(F.coalesce("doc_id", F.lit(0)).alias(pid), F.col("tkey").alias(tkey)).agg(F.sum("copies").cast("int").alias(n))
    keyed = docs.withColumns({pid: F.coalesce("doc_id", F.lit(0)), tkey: key}).dropDuplicates([pid, tkey])
    return keyed.join(taken, [pid, tkey]).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
