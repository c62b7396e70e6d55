"""A vector index that is kept: cells with product-quantised residuals, exact reranking, changes without a rebuild.

The index is a folder in the shared file system:

  codes/segment=S/cell=C     (doc_id, code, far): of each vector the nearest centroid of each part of what its cell's centre leaves over, and how
                             far from the centre it lies
  vectors/segment=S/cell=C   (doc_id, vec): the vectors themselves, for the exact scores of candidates
  gone/segment=S             (doc_id): what segments before S no longer hold

Centres and centroids are fitted on a bounded sample; every vector is coded. A search builds a table of distances for each query
and visited cell, adds up one number for each part of a code, and looks up the vectors of the best candidates only. Codes
may miss a neighbour; an exact search then visits the vectors of every cell that can hold a nearer one. Adding and removing writes new segments. `drifted` tells when what comes in lies farther from the centroids than what the index was fitted on, and
`rebuilt` fits it anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import kept, place
from .lexical import maybe_broadcast, top
from .nearest import STEP, Best, _asked, _matrix, _probes, _scores, _unit

SAMPLE, PARTS, CENTROIDS, FEW = 20_000, 8, 256, 1_000_000
#: Candidates that are scored exactly, for each asked neighbour.
DEPTH = 20
#: Queries whose tables of distances a task holds at a time.
ASKED = 128
_CODES = "doc_id long, code binary, far double, segment int, cell int"
_VECTORS = "doc_id long, vec array<double>, segment int, cell int"


@dataclass
class Coded:
    spark: SparkSession
    path: str
    centres: np.ndarray
    centroids: np.ndarray  # (parts, centroids, length of a part)
    error: float  # mean squared distance of the sample from what its codes stand for
    probes: int  # cells that a query has to visit for the recall that the index was fitted for

    def _read(self, name: str, schema: str) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def live(self, name: str, schema: str) -> DataFrame:
        """Rows of codes or vectors that no later segment has taken away."""
        gone = self._read("gone", "doc_id long, segment int").groupBy("doc_id").agg(F.max("segment").alias("upto"))
        return self._read(name, schema).join(maybe_broadcast(gone, FEW), "doc_id", "left").where("upto is null or segment >= upto").drop("upto")

    def vectors(self) -> DataFrame:
        return self.live("vectors", _VECTORS)

    def codes(self) -> DataFrame:
        return self.live("codes", _CODES)

    def next_segment(self) -> int:
        last = [self._read(n, s).agg(F.max("segment")).first()[0] for n, s in (("codes", _CODES), ("gone", "doc_id long, segment int"))]
        return max(-1 if x is None else x for x in last) + 1


def _means(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        sums, size = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


def fit(vectors: DataFrame, centres: int = 32, parts: int = PARTS, seed: int = 42, sample: int = SAMPLE, path: str | None = None, recall: float = 0.96) -> Coded:
    """Centres and centroids from the `sample` vectors with the least hashes; the index is empty. Parts are of equal length, but for the last."""
    rows = vectors.where("vec is not null and size(vec) > 0").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).select("vec").collect()
    dim = max((len(r.vec) for r in rows), default=1)
    x = _unit(np.array([r.vec for r in rows if len(r.vec) == dim], np.float64).reshape(-1, dim))
    x = x if len(x) else np.zeros((1, dim))
    rng = np.random.default_rng(seed)
    c = _means(x, centres, rng)
    rest = _split(x - c[_nearest(x, c)], parts)
    books = np.stack([np.pad(b := _means(rest[:, p], CENTROIDS, rng), ((0, CENTROIDS - len(b)), (0, 0)), constant_values=1e3) for p in range(rest.shape[1])])
    return Coded(vectors.sparkSession, path or place(vectors.sparkSession, "codes"), c, books, _error(rest, books), _probes(x, c, recall, 10))


def _split(x: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, length of a part), padded with zeros."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)


def _codes(rest: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.stack([_nearest(rest[:, p], books[p]) for p in range(len(books))], axis=1).astype(np.uint8)


def _error(rest: np.ndarray, books: np.ndarray) -> float:
    code = _codes(rest, books)
    return float(((rest - books[np.arange(len(books))[None, :], code]) ** 2).sum(axis=(1, 2)).mean()) if len(rest) else 0.0


def add(index: Coded, vectors: DataFrame) -> None:
    """Codes vectors (doc_id, vec), in place of those with their ids: one segment more. Null vectors and other lengths are not held."""
    segment, dim = index.next_segment(), index.centres.shape[1]
    c, books = index.centres, index.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.equal(pc.list_value_length(b.column(1)), dim))
            if b.num_rows:
                x = _unit(_matrix(b.column(1), dim))
                cell = _nearest(x, c)
                code = _codes(_split(x - c[cell], len(books)), books)
                far = np.linalg.norm(x - c[cell], axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in code], pa.binary()), pa.array(far), pa.array(cell.astype(np.int32))], ["doc_id", "vec", "code", "far", "cell"])

    rows = vectors.where("vec is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec"))
    placed = kept(rows.mapInArrow(run, "doc_id long, vec array<double>, code binary, far double, cell int").withColumn("segment", F.lit(segment)), "placed")
    if segment:
        remove(index, placed.join(index._read("codes", _CODES).select("doc_id"), "doc_id", "left_semi"), segment)
    for name, columns in (("codes", ["code", "far"]), ("vectors", ["vec"])):
        placed.select("doc_id", *columns, "segment", "cell").repartition("cell").sortWithinPartitions("cell", "doc_id").write.mode("append").partitionBy("segment", "cell").parquet(f"{index.path}/{name}")


def remove(index: Coded, ids: DataFrame, segment: int | None = None) -> None:
    segment = index.next_segment() if segment is None else segment
    ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(segment).alias("segment")).write.mode("append").partitionBy("segment").parquet(f"{index.path}/gone")


def build(vectors: DataFrame, centres: int = 32, parts: int = PARTS, path: str | None = None) -> Coded:
    index = fit(vectors, centres, parts, path=path)
    add(index, vectors)
    return index


def drifted(index: Coded, most: float = 1.5, sample: int = SAMPLE) -> bool:
    """Whether what the index holds now lies `most` times as far from what its codes stand for as what it was fitted on."""
    rows = index.vectors().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample).select("vec").collect()
    if not rows:
        return False
    x = _unit(np.array([r.vec for r in rows], np.float64))
    rest = _split(x - index.centres[_nearest(x, index.centres)], len(index.centroids))
    return _error(rest, index.centroids) > most * max(index.error, 1e-9)


def rebuilt(index: Coded) -> Coded:
    """Fitted on what the index holds now, in a folder of its own."""
    return build(index.vectors().select("doc_id", "vec"), len(index.centres), len(index.centroids))


def search(index: Coded, queries: DataFrame, k: int = 10, probes: int | None = None, depth: int = DEPTH, exact: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank) by cosine: the k best, by exact scores, of the k * depth best by codes in the cells next to a query.

    With `exact` these are the k nearest of all: they bound how far a nearer vector can lie, and so the cells that are visited again.
    """
    out, dim = None, index.centres.shape[1]
    codes = index.codes()
    for ids, vecs in _asked(queries):
        good = np.array([i for i, v in enumerate(vecs) if len(v) == dim and np.any(v)], np.int64)
        q = _unit(np.stack([vecs[i] for i in good])) if len(good) else np.zeros((0, dim))
        near = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")[:, : probes or index.probes]
        of = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        cells = codes.where(F.col("cell").isin(list(of))).select("doc_id", "code", "cell")
        found = top(cells.mapInArrow(_approximate(index, ids[good], q, of, k * depth), "qid long, doc_id long, score double"), k * depth)
        part = found.select("qid", "doc_id")
        out = part if out is None else out.unionByName(part)
    met = out.join(index.vectors().select("doc_id", "vec"), "doc_id").join(maybe_broadcast(queries.select("qid", F.col("vec").cast("array<double>").alias("asked")), 100_000), "qid")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot("vec", "vec")) * F.sqrt(dot("asked", "asked"))
    score = F.when(size > 0, dot("vec", "asked") / F.when(size > 0, size)).otherwise(0.0)
    hits = top(met.select("qid", "doc_id", score.alias("score")), k)
    return _settled(index, queries, kept(hits, "hits"), k) if exact else hits


def _settled(index: Coded, queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The k nearest of all vectors: those of each cell for the queries to which one of its vectors can be as near as their k-th hit.

    By the triangle inequality a cell's vectors lie no nearer to a query than its centre does, less the farthest of them from the centre.
    """
    radius = {r.cell: r.far for r in index.codes().groupBy("cell").agg(F.max("far").alias("far")).collect()}  # a row a cell
    out, dim = None, index.centres.shape[1]
    for ids, vecs in _asked(queries):
        good = np.array([i for i, v in enumerate(vecs) if len(v) == dim and np.any(v)], np.int64)
        if not len(good) or not radius:
            continue
        ids, q = ids[good], np.stack([vecs[i] for i in good])
        block = F.broadcast(index.spark.createDataFrame([(int(i),) for i in ids], "qid long"))
        last = {r.qid: r.score for r in hits.where(F.col("rank") == k).join(block, "qid").collect()}
        reach = np.sqrt(np.maximum(0, 2 - 2 * np.array([last.get(int(i), -1.0) for i in ids]))) + 1e-6  # all, where there are fewer than k hits
        away = np.linalg.norm(_unit(q)[:, None] - index.centres[None], axis=2)
        of = {c: may for c, far in radius.items() if len(may := np.flatnonzero(away[:, c] - far <= reach))}
        part = index.vectors().where(F.col("cell").isin(list(of))).select("doc_id", "vec", "cell").mapInArrow(_visited(ids, q, of, k), "qid long, doc_id long, score double")
        out = part if out is None else out.unionByName(part)
    return hits if out is None else top(out, k)


def _visited(ids: np.ndarray, q: np.ndarray, of: dict[int, np.ndarray], k: int):
    """The k best of each query among the vectors of the cells that it visits, by exact scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for b in batches:
            cell = b.column(2).to_numpy()
            for one in np.unique(cell).tolist():
                here = b.take(pa.array(np.flatnonzero(cell == one)))
                for i in range(0, here.num_rows, STEP):
                    some = here.slice(i, STEP)
                    best.add(of[one], some.column(0).to_numpy(), _scores(_matrix(some.column(1), q.shape[1]), q[of[one]], "cosine"))
        yield best.batch(ids)

    return run


def _tables(rest: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(queries, parts, centroids): squared distances of what a cell's centre leaves over of each query."""
    return np.stack([((rest[:, p, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(len(books))], axis=1)


def _approximate(index: Coded, ids: np.ndarray, q: np.ndarray, of: dict[int, np.ndarray], k: int):
    """The k best of each query by codes: minus the squared distance from what a code stands for."""
    centres, books = index.centres, index.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for b in batches:
            cell = b.column(2).to_numpy()
            for one in np.unique(cell).tolist():
                here = b.take(pa.array(np.flatnonzero(cell == one)))
                doc = here.column(0).to_numpy()
                code = np.frombuffer(b"".join(here.column(1).to_pylist()), np.uint8).reshape(here.num_rows, len(books))
                for j in range(0, len(of[one]), ASKED):  # no more tables than those of ASKED queries and one cell at a time
                    who = of[one][j : j + ASKED]
                    table = _tables(_split(q[who] - centres[one], len(books)), books)
                    for i in range(0, here.num_rows, 1024):
                        some = code[i : i + 1024]
                        d = sum(table[:, p, :][:, some[:, p]] for p in range(len(books)))
                        best.add(who, doc[i : i + 1024], -d)
        yield best.batch(ids)

    return run
