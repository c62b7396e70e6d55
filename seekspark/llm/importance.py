"""Importance resampling towards a target corpus, by hashed word features.

Features are the words and pairs of consecutive words of a text, each in one of `buckets` buckets by its CRC-32. One pass
over the raw table and one over the target give a vector of counts for each partition (np.bincount), and a tree of tasks adds
these up. A bucket's gain is a thousand times the logarithm of how much likelier it is in the target. The second pass sends
the gains, one number a bucket, to the tasks, which sum them over each document (np.bincount with weights). A document's weight is
the mean gain of its features; with Gumbel noise from a hash of its doc_id the highest scores are a sample without
replacement in proportion to exp(weight / 1000).

Drawn documents get their place in the whole order: those above a cut, found on counts by ranges of scores, are sorted
by range, numbered within their partition, and the rows of the partitions before are added.

Defined results. Null and empty texts, and those without a word, have no features and weight 0, and cannot be drawn. Texts of any length
are taken whole, in bounded batches by document. Repeated rows count and are drawn each by itself; with equal scores the smaller doc_id
comes first, nulls last, then the smaller weight and number of features. A null doc_id is hashed as an empty one. Empty tables give
empty results; an empty target gives the gains of no counts. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_runs import crc_spans, runs
from .common import LOWER, Scratch, slices, utf8

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7

#: Bytes of words, after A-Z are in lower case: digits, a-z, and all of characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Scores are counted by ranges of this width to find the cut. Scores lie within some 10^5 of zero, so the ranges are few thousands.
WIDTH = 64


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the row of every feature, and the number of words of every row."""
    data, at = utf8(column)
    data = LOWER[data]
    first, last, begin = runs(WORD[data], at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(begin))
    one = crc_spans(data, first, last)
    pair = np.flatnonzero(row[1:] == row[:-1])
    space = np.full(len(pair), 32, np.uint8)
    spaced = crc_spans(space, np.arange(len(pair)), np.arange(len(pair)) + 1, one[pair])
    two = crc_spans(data, first[pair + 1], last[pair + 1], spaced)
    return np.concatenate([one, two]).astype(np.int64) % buckets, np.concatenate([row, row[pair]]), np.diff(begin)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, "text"):
            total += np.bincount(features(b.column(0), buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select("text").mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)  # a table may have no partition
    return vectors.union(none).treeReduce(np.add)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of B buckets."""
    s_all, t_all, n = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = sent.value
        for b in slices(batches, "text"):
            bucket, row, words = features(b.column(1), len(by_bucket))
            n = np.bincount(row, minlength=b.num_rows)
            total = np.bincount(row, weights=by_bucket[bucket], minlength=b.num_rows).astype(np.int64)  # whole numbers below 2^53
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """With score: the weight and Gumbel noise from the first 32 bits of sha256('<seed>:<doc_id>')."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return weighed.withColumn("score", F.col("weight") + F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * -1000.0))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, part = 0, TaskContext.get().partitionId()
    for b in batches:
        here = pa.array(np.arange(done, done + b.num_rows, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), here], [*b.schema.names, "part", "i"])
        done += b.num_rows


def ranked(rows: DataFrame, scratch: Scratch, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """`rows` (doc_id, n_words, n_features, weight, score) with rank: 1, 2, ... for the drawn, null for the others."""
    fit = F.col("n_words") >= least_words
    counts = sorted(rows.where(fit).groupBy(F.floor(F.col("score") / WIDTH).alias("r")).count().collect(), reverse=True)  # a row for each range of scores
    most = percent * sum(c for _, c in counts) // 100
    if not most:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    cut = counts[bisect.bisect_left(list(accumulate(c for _, c in counts)), most)][0] * WIDTH
    order = F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")
    above = fit & (F.col("score") >= cut)
    sort = rows.where(above).repartitionByRange(*order).sortWithinPartitions(*order)
    sort = scratch.save(sort.mapInArrow(_numbered, "doc_id long, n_words long, n_features long, weight long, score long, part int, i long"), "ranked")
    sizes = sorted(sort.groupBy("part").count().collect())  # a row for each partition
    offsets = [0, *accumulate(c for _, c in sizes)]
    before = rows.sparkSession.createDataFrame([(p, o) for (p, _), o in zip(sizes, offsets, strict=False)], "part int, before long")
    rank = F.col("before") + F.col("i") + 1
    sort = sort.join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= most, rank)).drop("part", "i", "before")
    return sort.unionByName(rows.where(~above).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: `percent` of the documents with `least_words`, drawn towards the texts of `target`."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    return ranked(scratch.save(scored(weigh(docs, gain), seed), "scored"), scratch, percent, least_words)


#: CRC-32 of a hexadecimal string of bytes, in SQL: table `crc_table` has one row with the list `t`.
CRC_TABLE = "crc_table as (select list(x order by i) as t from (select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as x from range(256) r(i)))"
CRC = """xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}), 2), lambda i: (16 * (strpos('0123456789ABCDEF', {0}[i]) - 1) + strpos('0123456789ABCDEF', {0}[i + 1]) - 1)::bigint)),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"""

ORACLE = rf"""
with {CRC_TABLE},
texts as (select 'd' as side, doc_id, text from documents union all select 'b', null, text from benchmark),
numbered as (select *, row_number() over () as k from texts),
w as (select side, doc_id, k, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from numbered),
f as (select side, doc_id, k, unnest(list_concat(ws, list_transform(range(1, length(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as f from w),
h as (select f, hex(encode(f)) as x from (select distinct f from f)),
b as (select f, {CRC.format("x")} % 10000 as b from h, crc_table),
fb as (select side, k, b from f join b using (f)),
s as (select b, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from fb group by b),
n as (select coalesce(sum(s), 0)::double as s_all, coalesce(sum(t), 0)::double as t_all from s),
g as (select b, floor(1000 * ln((t + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000))))::bigint as g from s, n),
d as (select k, count(*) as n, floor(sum(g)::double / count(*))::bigint as weight from fb join g using (b) where side = 'd' group by k),
r as (select doc_id, coalesce(length(ws), 0) as words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from w left join d using (k) where side = 'd'),
o as (select *, case when words >= 20 then row_number() over (partition by words >= 20 order by score desc, doc_id) end as place, count(*) filter (words >= 20) over () as n from r)
select doc_id, n_features, weight, score, case when place <= 25 * n // 100 then place end as rank from o
"""
