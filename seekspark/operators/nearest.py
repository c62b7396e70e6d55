"""Nearest neighbours of a block of queries: exact, and by an index of cells.

A block of queries travels to the tasks; each task folds its vectors into the k best of every query, a bounded product at a
time, and passes on k rows for each query, whatever the number of its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .lexical import top

#: Queries that travel to the tasks at a time; more are answered block by block, each block over all vectors.
BLOCK = 4096
#: Vectors that meet the queries in one product.
STEP = 1024
_HITS = "qid long, doc_id long, score double"


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Higher is nearer, (queries, vectors)."""
    if metric == "dot":
        return q @ x.T
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.divide(q @ x.T, n, out=np.zeros_like(n), where=n > 0)
    if metric == "euclidean":
        return -np.stack([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in q])
    if metric == "manhattan":
        return -np.stack([np.abs(x - v).sum(axis=1) for v in q])
    raise ValueError(f"unknown metric {metric!r}")


class Best:
    """The k best of each query so far, by score to nine digits and then by id, as all top lists are ordered."""

    def __init__(self, queries: int, k: int):
        self.k, self.n = k, queries
        self.least = np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, which: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """Scores of the queries `which` against vectors `ids`."""
        limit = self.least[which]
        if s.shape[1] > self.k:
            limit = np.maximum(limit, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
        r, c = np.nonzero(s >= limit[:, None] - 1e-8)
        self.held.append((which[r], ids[c], s[r, c]))
        self.rows += len(r)
        if self.rows > 4 * self.k * self.n + 10_000:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        q, i, s = map(np.concatenate, zip(*self.held, strict=True))
        order = np.lexsort((i, -np.round(s, 9), q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        last = place == self.k - 1
        self.least[q[last]] = s[last]
        self.held, self.rows = [(q[keep], i[keep], s[keep])], int(keep.sum())

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        self.settle()
        q, i, s = self.held[0] if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(i), pa.array(s)], ["qid", "doc_id", "score"])


def _asked(queries: DataFrame) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Blocks of ids and vectors of queries."""
    asked = queries.where("vec is not null").select("qid", "vec")
    first = asked.limit(BLOCK + 1).collect()
    if len(first) <= BLOCK:
        yield np.array([r.qid for r in first], np.int64), [np.array(r.vec, np.float64) for r in first]
        return
    block = []
    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            yield np.array([r.qid for r in block], np.int64), [np.array(r.vec, np.float64) for r in block]
            block = []
    if block:
        yield np.array([r.qid for r in block], np.int64), [np.array(r.vec, np.float64) for r in block]


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(-1, d)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", min_score: float | None = None) -> DataFrame:
    """(qid, doc_id, score, rank) from vectors (doc_id, vec) and queries (qid, vec). Null vectors and other lengths match nothing.

    For distances, score is the distance with a minus. What is shuffled is k rows for each query and task.
    """
    out = None
    for ids, vecs in _asked(queries):
        part = _exact(vectors, ids, vecs, k, metric)
        out = part if out is None else out.unionByName(part)
    if min_score is not None:
        out = out.where(~F.isnan("score") & (F.col("score") >= min_score))
    return top(out, k)


def within(vectors: DataFrame, queries: DataFrame, least: float, metric: str = "cosine") -> DataFrame:
    """(qid, doc_id, score): every vector that is near enough to a query, however many those are."""
    out = None
    for ids, vecs in _asked(queries):
        part = _exact(vectors, ids, vecs, None, metric, least)
        out = part if out is None else out.unionByName(part)
    return out


def _exact(vectors: DataFrame, ids: np.ndarray, vecs: list[np.ndarray], k: int | None, metric: str, least: float = 0.0) -> DataFrame:
    """The k best of each task, or without k all of at least `least`."""
    size = np.array([len(v) for v in vecs])
    of = {d: (np.flatnonzero(size == d), np.stack([v for v in vecs if len(v) == d])) for d in sorted(set(size.tolist())) if d}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k or 0)
        for b in batches:
            length = pc.fill_null(pc.list_value_length(b.column(1)), -1).to_numpy()
            for d, (which, q) in of.items():
                here = np.flatnonzero(length == d)
                part = b if len(here) == b.num_rows else b.take(pa.array(here))
                for i in range(0, part.num_rows, STEP):
                    some = part.slice(i, STEP)
                    s = _scores(_matrix(some.column(1), d), q, metric)
                    if k is None:
                        r, c = np.nonzero(s >= least)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[which[r]]), pa.array(some.column(0).to_numpy()[c]), pa.array(s[r, c])], ["qid", "doc_id", "score"])
                    else:
                        best.add(which, some.column(0).to_numpy(), s)
        if k is not None:
            yield best.batch(ids)

    return vectors.select(F.col("doc_id").cast("long"), "vec").where("vec is not null").mapInArrow(run, _HITS)


# --- a near vector that is preferred -------------------------------------------


#: Vectors of a cell that one task holds; those that come to visit pass by in batches.
HOME = 4096


def outshone(rows: DataFrame, least: float, centres: int = 64, sample: int = 20_000) -> DataFrame:
    """doc_id of the vectors (doc_id, vec, use) to which another of higher use, or of equal use and smaller doc_id, has a cosine of at least `least`.

    Of equal vectors all but one go at once. The others meet in cells: a vector lives with its nearest centre, and visits every
    cell whose farthest member could be near enough, as angles obey the triangle inequality. Cells of more than HOME vectors
    are split. Only the homes that are outshone leave a task, so nothing grows with the number of near pairs. Null vectors, zeros and
    those with a component that is no number are near nothing.
    """
    good = rows.where("vec is not null and exists(vec, x -> x <> 0) and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    good = kept(good.select(F.col("doc_id").cast("long"), F.col("vec").cast("array<double>"), F.col("use").cast("double")), "outshone")
    first = good.groupBy("vec").agg(F.min(F.struct((-F.col("use")).alias("u"), "doc_id")).alias("best")).select("vec", F.col("best.doc_id").alias("doc_id"), (-F.col("best.u")).alias("use"))
    first = kept(first, "distinct")
    copies = good.join(first.select("doc_id"), "doc_id", "left_anti").select("doc_id")
    near = float(np.arccos(np.clip(least, -1.0, 1.0))) + 1e-9
    centre = {d: c for d, c in _centres_by_length(first, centres, sample).items()}

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x, angle, base in _angles(batches, centre):
            yield pa.RecordBatch.from_arrays([pa.array(base + angle.argmin(axis=1), pa.int64()), pa.array(angle.min(axis=1))], ["cell", "angle"])

    sizes = {r.cell: (r.n, r.radius) for r in first.select("doc_id", "vec", "use").mapInArrow(homes, "cell long, angle double").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # a row for each cell
    blocks = {c: -(-n // HOME) for c, (n, _) in sizes.items()}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x, angle, base in _angles(batches, centre):
            who, where, block, role = [], [], [], []
            home = angle.argmin(axis=1)
            ids = b.column(0).to_numpy()
            for c in range(angle.shape[1]):
                n, radius = sizes.get(base + c, (0, 0.0))
                if n:
                    guests = np.flatnonzero(angle[:, c] <= radius + near)
                    for k in range(blocks[base + c]):
                        who.append(guests), where.append(np.full(len(guests), base + c)), block.append(np.full(len(guests), k)), role.append(np.ones(len(guests), np.int64))
            who.append(np.arange(len(ids))), where.append(base + home), role.append(np.zeros(len(ids), np.int64))
            block.append(ids % np.array([blocks[base + c] for c in home]))
            who, where, block, role = map(np.concatenate, (who, where, block, role))
            for i in range(0, len(who), STEP):  # copies of vectors leave in bounded batches
                j = slice(i, i + STEP)
                yield pa.RecordBatch.from_arrays([pa.array(where[j]), pa.array(block[j]), pa.array(role[j]), *b.take(pa.array(who[j])).columns], ["cell", "block", "role", *b.schema.names])

    met = first.select("doc_id", "vec", "use").mapInArrow(places, "cell long, block long, role long, doc_id long, vec array<double>, use double")
    met = met.repartition("cell", "block").sortWithinPartitions("cell", "block", "role")
    return met.mapInArrow(_outshone(least), "doc_id long").unionByName(copies)


def _centres_by_length(rows: DataFrame, centres: int, sample: int) -> dict[int, np.ndarray]:
    """Centres for the vectors of each length, from a bounded sample; only the work depends on them, not the result."""
    lengths = [r[0] for r in rows.select(F.size("vec").alias("d")).distinct().collect()]
    out = {}
    for d in sorted(lengths):
        some = rows.where(F.size("vec") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("vec").collect()
        x = _unit(np.array([r.vec for r in some], np.float64))
        out[d] = x[np.random.default_rng(42).choice(len(x), min(centres, len(x)), replace=False)]
    return out


def _angles(batches: Iterator[pa.RecordBatch], centre: dict[int, np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Vectors of one length with their angles to its centres, and the number of its first cell."""
    for b in batches:
        length = pc.list_value_length(b.column(1)).to_numpy()
        for k, (d, c) in enumerate(sorted(centre.items())):
            here = b.take(pa.array(np.flatnonzero(length == d)))
            for i in range(0, here.num_rows, STEP):
                some = here.slice(i, STEP)
                x = _unit(_matrix(some.column(1), d))
                yield some, x, np.arccos(np.clip(x @ c.T, -1.0, 1.0)), k * 1_000_000


def _outshone(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, homes, x, gone = None, [], None, None

        def done() -> Iterator[pa.RecordBatch]:
            if gone is not None and gone.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[0] for h in homes])[gone])], ["doc_id"])

        for b in batches:
            cell, block, role = (b.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                some = b.slice(i, j - i)
                ids, v, use = some.column(3).to_numpy(), np.stack(some.column(4).to_numpy(zero_copy_only=False)), some.column(5).to_numpy()
                if (cell[i], block[i]) != at:
                    yield from done()
                    at, homes, x, gone = (cell[i], block[i]), [], None, None
                if role[i] == 0:
                    homes.append((ids, v, use))
                    continue
                if not homes:
                    continue
                if x is None:
                    x, gone = np.concatenate([h[1] for h in homes]), np.zeros(sum(len(h[0]) for h in homes), bool)
                own, mine = np.concatenate([h[0] for h in homes]), np.concatenate([h[2] for h in homes])
                for k in range(0, len(ids), 256):
                    s = _scores(x, v[k : k + 256], "cosine")
                    better = (use[k : k + 256, None] > mine[None, :]) | ((use[k : k + 256, None] == mine[None, :]) & (ids[k : k + 256, None] < own[None, :]))
                    gone |= ((s >= least) & better).any(axis=0)
        yield from done()

    return run


# --- cells -------------------------------------------------------------------


@dataclass
class Cells:
    """Vectors stored by cell, the cells' centres, and how many cells a query has to visit for the recall it was built for."""

    stored: DataFrame
    centres: np.ndarray
    probes: int


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cells(vectors: DataFrame, centres: int = 32, recall: float = 0.96, k: int = 10, seed: int = 42, sample: int = 20_000) -> Cells:
    """Builds the index: every vector goes to its nearest centre, and a cell is a folder of its own.

    Centres come from a few k-means rounds on the `sample` vectors with the least hashes; so does the number of cells to visit:
    the least with which every sixteenth vector of the sample finds that share of its k nearest within the sample.
    """
    rows = vectors.where("vec is not null and size(vec) > 0").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).select("vec").collect()
    dim = max((len(r.vec) for r in rows), default=1)
    x = _unit(np.array([r.vec for r in rows if len(r.vec) == dim], np.float64).reshape(-1, dim))
    c = _spherical(x, min(centres, len(x)), seed)
    probes = _probes(x, c, recall, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            here = np.flatnonzero(pc.list_value_length(b.column(1)).to_numpy() == dim)
            if len(here):
                b = b.take(pa.array(here))
                cell = (_unit(_matrix(b.column(1), dim)) @ c.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["doc_id", "vec", "cell"])

    kind = vectors.schema["vec"].dataType.simpleString()
    placed = vectors.select(F.col("doc_id").cast("long"), "vec").where("vec is not null").mapInArrow(run, f"doc_id long, vec {kind}, cell int")
    return Cells(kept(placed, "cells", by="cell"), c, probes)


def _probes(x: np.ndarray, c: np.ndarray, recall: float, k: int) -> int:
    """How many cells the vectors of the sample must visit."""
    asked = np.arange(0, len(x), 16)
    cell, order = (x @ c.T).argmax(axis=1), np.argsort(-(x[asked] @ c.T), axis=1)
    place = np.argsort(order, axis=1)  # of each cell: when a query visits it
    late = []
    for i in range(0, len(asked), 256):
        s = x[asked[i : i + 256]] @ x.T
        n = min(k, s.shape[1])
        best = np.argpartition(-s, n - 1, axis=1)[:, :n]
        late.append(np.take_along_axis(place[i : i + 256], cell[best], axis=1).reshape(-1))
    late = np.sort(np.concatenate(late)) if late else np.zeros(1, np.int64)
    return int(late[min(int(np.ceil(recall * len(late))), len(late) - 1)]) + 1


def search_cells(index: Cells, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """(qid, doc_id, score, rank) by cosine within the cells that each query visits.

    Only folders of visited cells are read, and a query meets only the vectors of its own cells.
    """
    out = None
    for ids, vecs in _asked(queries):
        part = _visited(index, ids, vecs, k, probes or index.probes)
        out = part if out is None else out.unionByName(part)
    return top(out, k)


def _visited(index: Cells, ids: np.ndarray, vecs: list[np.ndarray], k: int, probes: int) -> DataFrame:
    dim = index.centres.shape[1]
    good = np.array([i for i, v in enumerate(vecs) if len(v) == dim], np.int64)
    q = np.stack([vecs[i] for i in good]) if len(good) else np.zeros((0, dim))
    visits = np.argsort(-(q @ index.centres.T), axis=1)[:, :probes]
    of = {int(cell): np.flatnonzero((visits == cell).any(axis=1)) for cell in np.unique(visits)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for b in batches:
            cell = b.column(2).to_numpy()
            for one in np.unique(cell):
                here = b.take(pa.array(np.flatnonzero(cell == one)))
                who = of[int(one)]
                for i in range(0, here.num_rows, STEP):
                    some = here.slice(i, STEP)
                    best.add(good[who], some.column(0).to_numpy(), _scores(_matrix(some.column(1), dim), q[who], "cosine"))
        yield best.batch(ids)

    return index.stored.where(F.col("cell").isin(list(of))).select("doc_id", "vec", "cell").mapInArrow(run, _HITS)


# --- how many cells, and how many visits --------------------------------------


def visit_curve(vectors: DataFrame, queries: DataFrame, counts: list[int], k: int = 10, sample: int = 20_000) -> DataFrame:
    """(centres, probes, recall, share): what an index of so many cells finds if each query visits so many, and how many rows it reads.

    recall is the share of the queries' true k nearest vectors that lie in the visited cells, share the mean part of all vectors in them.
    Exact search runs once. Then each true neighbour has a number: which visit reaches it; a count of these gives the recall of
    every number of visits at once, so no configuration is searched by itself. Vectors without a length, or of another than the
    most, are in no cell and are left out; ties are those of `knn`. Without vectors or queries there is no row.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("doc_id").cast("long"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null and exists(vec, x -> x <> 0)")
    rows = good.orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id").limit(sample).select("vec").collect()
    dim = max((len(r.vec) for r in rows), default=0)
    if not dim:
        return spark.createDataFrame([], "centres int, probes int, recall double, share double")
    x = _unit(np.array([r.vec for r in rows if len(r.vec) == dim], np.float64))
    books = {n: _spherical(x, n) for n in dict.fromkeys(min(n, len(x)) for n in counts)}
    same = good.where(F.size("vec") == dim)
    asked = queries.select(F.col("qid").cast("long"), F.col("vec").cast("array<double>").alias("vec")).where((F.size("vec") == dim) & F.exists("vec", lambda v: v != 0))
    true = kept(knn(same, asked, k).select("qid", "doc_id"), "true")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, STEP):
                some = b.slice(i, STEP)
                v = _unit(_matrix(some.column(1), dim))
                for n, c in books.items():
                    cell = (v @ c.T).argmax(axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(v), n, np.int32)), pa.array(cell)], ["doc_id", "centres", "cell"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, STEP):
                some = b.slice(i, STEP)
                v = _unit(_matrix(some.column(1), dim))
                for n, c in books.items():
                    order = np.argsort(-(v @ c.T), axis=1, kind="stable").astype(np.int32)
                    size = order.shape[1]
                    columns = [some.column(0).take(pa.array(np.repeat(np.arange(len(v)), size))), pa.array(np.full(order.size, n, np.int32)), pa.array(order.reshape(-1)), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(v)))]
                    yield pa.RecordBatch.from_arrays(columns, ["qid", "centres", "cell", "probes"])

    cell = kept(same.select("doc_id", "vec").mapInArrow(placed, "doc_id long, centres int, cell int"), "placed")
    visit = kept(asked.select("qid", "vec").mapInArrow(visits, "qid long, centres int, cell int, probes int"), "visits")
    found = true.join(cell, "doc_id").join(visit, ["qid", "centres", "cell"]).groupBy("centres", "probes").agg(F.count("*").alias("found"))
    read = visit.join(F.broadcast(cell.groupBy("centres", "cell").agg(F.count("*").alias("n"))), ["centres", "cell"]).groupBy("centres", "probes").agg(F.sum("n").alias("read"))
    # from here on there is a row for each number of cells and visits, some hundreds
    w = Window.partitionBy("centres").orderBy("probes").rowsBetween(Window.unboundedPreceding, 0)
    each = visit.select("centres", "probes").distinct().join(found, ["centres", "probes"], "left").join(read, ["centres", "probes"], "left").na.fill(0)
    n = same.agg(F.count("*").alias("all")).join(F.broadcast(asked.agg(F.count("*").alias("asked")))).join(F.broadcast(true.agg(F.count("*").alias("true"))))
    upto = each.select("centres", "probes", F.sum("found").over(w).alias("found"), F.sum("read").over(w).alias("read")).join(F.broadcast(n))
    return upto.select("centres", "probes", (F.col("found") / F.col("true")).alias("recall"), (F.col("read") / F.col("asked") / F.col("all")).alias("share"))


def chosen(curve: DataFrame, recall: float = 0.95) -> DataFrame:
    """Of each number of cells the fewest visits with that recall, with their place by the share of rows read; 1 is the one to take."""
    first = Window.partitionBy("centres").orderBy("probes")
    some = curve.where(F.col("recall") >= recall).withColumn("f", F.row_number().over(first)).where("f = 1").drop("f")
    # as many rows as numbers of cells were asked for
    return some.withColumn("place", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.round("share", 9), "centres")))


def _spherical(x: np.ndarray, n: int, seed: int = 42, rounds: int = 8) -> np.ndarray:
    """n centres of unit vectors, by k-means."""
    c = x[np.random.default_rng(seed).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(n)])) if n else c
    return c
