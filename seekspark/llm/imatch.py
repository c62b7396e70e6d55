"""Document fingerprints by I-Match, over randomised lexicons.

A term is a word with A-Z in lower case. The lexicon is the terms whose document frequency, over all documents, lies within a band
from `low` to `high` of the number of documents (an inverse document frequency from -ln high to -ln low). It can have no more than
(mean distinct terms of a document) / low terms, however many documents there are, so it is sent to every task.

The distinct terms of a text that are in the lexicon are sorted and hashed. One hash of all of them is classic I-Match: a single
changed term changes it. So random subsets of the lexicon are hashed too: `replicas` of them at each of `levels` rates 1/2, 1/4, ...
A text whose terms partly changed agrees in those subsets that hold none of the changed terms, so among them are some for each length of text
and amount of change. Likeness of two fingerprints is the share of equal hashes among the subsets in which either has a term.

The edited text needs the next document. Documents are cut into ranges of (doc_id, hash of the text); the first document of each
range also goes to the range before, the first of all to the last. Each range is then one walk in order, in which every document
meets its next one.

Defined results. A null text is empty. A text without a term of the lexicon is hashed by all its terms; one without a word has
an empty hash everywhere, is like another of that kind (1) and unlike all others (0). Null doc_ids come first; rows of one doc_id are in the
order of a hash of their text, equal rows in any. A single row is its own next. Texts of any length are taken whole. Other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, longs, mix, slices, word_hashes

LOW, HIGH = 0.001, 0.35
LEVELS, REPLICAS = 12, 16
#: Ranges of documents for each shuffle partition, and rows of the sample by which they are cut for each range.
RANGES, SAMPLE = 4, 64
_STEP, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def distinct_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct term of every row, sorted by both."""
    h, begin = word_hashes(column)
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def lexicon(docs: DataFrame, scratch: Scratch, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """The sorted hashes of the terms that from `low` to `high` of all documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            t, at = np.unique(np.concatenate(terms), return_inverse=True)
            return t, np.bincount(at, weights=np.concatenate(counts), minlength=len(t)).astype(np.int64)

        for b in slices(batches, "text"):
            t, n = np.unique(distinct_terms(b.column(0))[1], return_counts=True)
            terms.append(t), counts.append(n)
            held += len(t)
            if held > 1 << 20:
                t, n = merged()
                if len(t) > 1 << 19:
                    yield pa.RecordBatch.from_arrays([longs(t), pa.array(n)], ["term", "n"])
                    terms, counts, held = [], [], 0
                else:
                    terms, counts, held = [t], [n], len(t)
        if held:
            t, n = merged()
            yield pa.RecordBatch.from_arrays([longs(t), pa.array(n)], ["term", "n"])

    total = docs.count()
    df = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = scratch.save(df.where(F.col("n").between(math.ceil(low * total), math.floor(high * total))).select("term"), "lexicon")
    return np.sort(kept.toPandas()["term"].to_numpy(np.int64).view(np.uint64))  # bounded: see above


def _set_hashes(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """A hash of the sorted terms of each row, by scrambled hashes of the terms and their places; 0 for none."""
    out = np.zeros(rows, np.uint64)
    if len(h):
        start = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(h)) - np.repeat(start, np.diff(start, append=len(h)))
        out[row[start]] = mix(np.add.reduceat(h * (2 * place + 1).view(np.uint64), start))
    return out


def fingerprints(column: pa.Array, lexicon: np.ndarray, levels: int = LEVELS, replicas: int = REPLICAS) -> np.ndarray:
    """The bytes of each row's fingerprint: eight for the whole lexicon, two for each subset; zeros where it has no term."""
    rows = len(column)
    row, h = distinct_terms(column)
    if len(lexicon):
        inside = lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h
    else:
        inside = np.zeros(len(h), bool)
    some = np.zeros(rows, bool)
    some[row[inside]] = True
    keep = inside | ~some[row]
    row, h = row[keep], mix(h[keep])
    out = np.zeros((rows, 8 + 2 * levels * replicas), np.uint8)
    out[:, :8] = _set_hashes(row, h, rows).astype(">u8").view(np.uint8).reshape(rows, 8)
    at = 8
    for k in range(replicas):
        drawn = mix(h + np.uint64((k + 1) * _STEP & _ALL))
        here, terms = row, h
        for level in range(1, levels + 1):  # each subset is half of the one before
            half = drawn & np.uint64(1) == 0
            here, terms, drawn = here[half], terms[half], drawn[half] >> np.uint64(1)
            x = _set_hashes(here, terms, rows)
            x = np.where(x == 0, 0, np.maximum(x & np.uint64(0xFFFF), 1))
            out[:, at : at + 2] = x.astype(">u2").view(np.uint8).reshape(rows, 2)
            at += 2
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal hashes among the subsets in which either fingerprint has a term, row by row."""
    pairs = [(np.ascontiguousarray(x[:, :8]).view(">u8"), np.ascontiguousarray(x[:, 8:]).view(">u2")) for x in (a, b)]
    same, either = (sum(f(x, y).sum(axis=1) for x, y in zip(*pairs, strict=True)) for f in (lambda x, y: (x == y) & (x != 0), lambda x, y: (x != 0) | (y != 0)))
    return np.where(either == 0, 1.0, same / np.maximum(either, 1))


def _ranged(docs: DataFrame, spread: int) -> DataFrame:
    """bucket, extra, doc_id, h, text: each document in its range, and the first of each range, as an extra, at the end of the one before."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = docs.select("doc_id", "h")
    sample = ids.orderBy(F.xxhash64("doc_id", "h")).limit(SAMPLE * spread).collect()  # cuts ranges of about equal size; which rows meet does not depend on it
    least = -(1 << 63)
    keys = sorted((least if i is None else i, h) for i, h in sample)
    cuts = [keys[len(keys) * k // spread] for k in range(1, spread)] if keys else []
    cut_ids, cut_hashes = (np.array([c[k] for c in cuts], np.int64) for k in (0, 1))

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        i, h = doc_id.fillna(least).to_numpy(np.int64), h.to_numpy(np.int64)
        low, high = np.searchsorted(cut_ids, i, "left"), np.searchsorted(cut_ids, i, "right")
        out = low.copy()
        for k in range(int((high - low).max(initial=0))):
            out += (low + k < high) & (cut_hashes[np.minimum(low + k, len(cuts) - 1)] <= h) if len(cuts) else 0
        return pd.Series(out.astype(np.int32))

    # doc_ids as whole numbers: pandas would turn a column with nulls into doubles
    bucket: Column = range_of(F.coalesce("doc_id", F.lit(least)), "h")
    firsts = sorted(ids.withColumn("bucket", bucket).groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("first")).collect(), key=lambda r: r[0])  # a row for each range
    before = [(firsts[k - 1][0], *firsts[k][1]) for k in range(len(firsts))]
    before = docs.sparkSession.createDataFrame(before, "before int, first_id long, first_h long")
    placed = docs.withColumn("bucket", bucket).join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra"))
    more = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("extra"))
    places = F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, more)))
    return placed.select(places.alias("at"), "doc_id", "h", "text").select("at.bucket", "at.extra", "doc_id", "h", "text")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def match(docs: DataFrame, scratch: Scratch, low: float = LOW, high: float = HIGH) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and their likeness and that to the next document's."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(lexicon(docs, scratch, low, high))
    spread = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, last = sent.value, None  # last: bucket, extra, doc_id, text, fingerprint of the row before
        for b in slices(batches, "text"):
            texts, prints = b.column(3).to_pylist(), fingerprints(b.column(3), terms)
            rows = [*zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts, prints, strict=True)]
            rows = ([last] if last else []) + rows
            last = rows[-1]
            pairs = [(x, y) for x, y in zip(rows[:-1], rows[1:], strict=True) if x[0] == y[0] and not x[1]]
            if not pairs:
                continue
            half = [len(x[3]) // 2 for x, _ in pairs]
            edited = pa.array([x[3][: len(x[3]) - k] + y[3][:k] for (x, y), k in zip(pairs, half, strict=True)], pa.large_string())
            own, following, other = np.stack([x[4] for x, _ in pairs]), np.stack([y[4] for _, y in pairs]), fingerprints(edited, terms)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[2] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in edited]),
                    pa.array([x.tobytes().hex() for x in own]),
                    pa.array([x.tobytes().hex() for x in other]),
                    pa.array(likeness(own, other)),
                    pa.array(likeness(own, following)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    walk = _ranged(docs, spread).repartition("bucket").sortWithinPartitions("bucket", "extra", F.asc_nulls_first("doc_id"), "h")
    return walk.select("bucket", "extra", "doc_id", "text").mapInArrow(run, _OUT)
