"""Near-duplicate vectors by an epsilon grid order join.

Valid vectors of a label, scaled to length 1, are near (cosine >= c) exactly if their distance is at most
eps = sqrt(2 - 2c), and then no projection of theirs differs by more. Vectors equal in all components are one class. Classes
are projected on the leading principal dimensions (fitted on a bounded sample; any orthonormal directions give right
results), and sorted by label and the cells of an eps grid on them, over range partitions. The sorted sequence is cut to
blocks of at most `BLOCK` classes, and these to a tree of intervals of `FAN` each with bounding boxes. The join begins with
each label's top intervals and goes down: of each pair of intervals, the pairs of their children whose boxes are within
eps. Pairs of blocks that are left are dealt to tiles, the pairs of two bands of consecutive blocks: a block travels once to each
tile that it has a pair in, and not once for each pair. Blocks are compared by matrix product. A tile yields link counts and
spanning forests of its links, never the links themselves.

Defined results: null or empty arrays, null or non-finite components, zero vectors and null labels: no link, component is
the own vec_id. Vectors of unlike lengths never link. Equal vec_ids are vectors of their own. An empty table gives no row. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components

LEAST, DIMS, BLOCK, FAN, SAMPLE = 0.93, 4, 256, 8, 4096
#: Blocks in a band: the square root of a label's blocks, within these bounds. A tile holds two bands in memory.
BANDS = 32, 128


def _axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions for each length of vectors, from the SAMPLE classes with the least keys."""
    rows = classes.orderBy("key").limit(SAMPLE).select("v").collect()
    out: dict[int, np.ndarray] = {}
    for n in {len(r[0]) for r in rows}:
        x = np.array([r[0] for r in rows if len(r[0]) == n], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        _, w = np.linalg.eigh(np.cov(x.T) if len(x) > 1 and n > 1 else np.eye(n))
        out[n] = w[:, ::-1][:, :DIMS]
    return out


def _unit(lists: pa.Array, n: int) -> np.ndarray:
    x = np.array(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, n)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _celled(axes: dict[int, np.ndarray], eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = np.array([len(x) for x in b.column(3)])
            for n in np.unique(dim):
                part = b.filter(pa.array(dim == n))
                w = axes.get(int(n), np.eye(int(n))[:, :DIMS])
                cells = np.zeros((part.num_rows, DIMS), np.int32)
                x = _unit(part.column(3), int(n)) @ w
                cells[:, : x.shape[1]] = np.floor(x / eps)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, n, np.int32)), *(pa.array(cells[:, k]) for k in range(DIMS))], [*b.schema.names, "n", *(f"c{k}" for k in range(DIMS))])

    return run


_BLOCKS = "label string, n int, id long, keys array<long>, counts array<long>, v binary, low array<double>, high array<double>"


def _blocks(axes: dict[int, np.ndarray]):
    """Consecutive sorted rows of a label and length as one row, with the box of their projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            label, dim = b.column(1).to_pylist(), b.column(4).to_numpy()
            cuts = [0, *(i for i in range(1, b.num_rows) if label[i] != label[i - 1] or dim[i] != dim[i - 1]), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                for i in range(s, e, BLOCK):
                    part = b.slice(i, min(BLOCK, e - i))
                    n = int(dim[i])
                    x = _unit(part.column(3), n)
                    y = x @ axes.get(n, np.eye(n)[:, :DIMS])
                    low, high = (np.pad(f(axis=0), (0, DIMS - y.shape[1])).tolist() for f in (y.min, y.max))
                    values = [[label[i]], [n], [base + made], [part.column(0).to_pylist()], [part.column(2).to_pylist()], [x.tobytes()], [low], [high]]
                    types = pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())
                    made += 1
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in _BLOCKS.split(", ")])

    return run


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what the true cells connect, fewer than rows + columns."""
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    todo, edges = set(rows.tolist()), []
    free = np.zeros(near.shape[1], bool)
    free[cols] = True
    while todo:
        stack = [todo.pop()]
        while stack:
            r = stack.pop()
            for c in np.flatnonzero(near[r] & free).tolist():
                free[c] = False
                edges.append((r, c))
                for q in np.flatnonzero(near[:, c]).tolist():
                    if q in todo:
                        todo.discard(q)
                        edges.append((q, c))
                        stack.append(q)
    return edges


_FOUND = "kind int, u long, v long"


def _linked(least: float, x: dict, y: dict, same: bool) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of two blocks: of each class the vectors linked (kind 0: key, number) and a spanning forest (kind 1: u, v)."""
    near = x["v"] @ y["v"].T >= least
    if same:
        np.fill_diagonal(near, False)
    rows = near.any(axis=1)
    out = [(0, x["keys"][rows], (near @ y["counts"])[rows])]
    if not same:
        cols = near.any(axis=0)
        out.append((0, y["keys"][cols], (x["counts"] @ near)[cols]))
    e = _spanning(near)
    if e:
        out.append((1, x["keys"][[r for r, _ in e]], y["keys"][[c for _, c in e]]))
    return out


def _tile(least: float):
    """Of a tile's blocks and pairs (each row: a block, and with which blocks it is the left one of a pair)."""

    def run(table: pa.Table) -> pa.Table:
        blocks = {}
        for r in range(table.num_rows):
            at, n, keys, counts, v, pairs = (table.column(c)[r].as_py() for c in ("id", "n", "keys", "counts", "v", "others"))
            blocks[at] = {"keys": np.array(keys, np.int64), "counts": np.array(counts, np.int64), "v": np.frombuffer(v).reshape(-1, n), "others": pairs or []}
        found = [x for a, block in blocks.items() for b in block["others"] for x in _linked(least, block, blocks[b], a == b)]
        # sums of a class over the tile's pairs, so that what is shuffled next does not grow with the pairs
        key, number = (np.concatenate([x[k] for x in found if x[0] == 0] or [np.zeros(0, np.int64)]) for k in (1, 2))
        key, back = np.unique(key, return_inverse=True)
        number = np.bincount(back, number, len(key)).astype(np.int64)
        u, v = (np.concatenate([x[k] for x in found if x[0] == 1] or [np.zeros(0, np.int64)]) for k in (1, 2))
        kind = np.repeat(np.int32([0, 1]), [len(key), len(u)])
        return pa.table({"kind": pa.array(kind), "u": pa.array(np.concatenate([key, u])), "v": pa.array(np.concatenate([number, v]))})

    return run


def _numbered(boxes: DataFrame) -> DataFrame:
    """Adds `k`, each block's place in its label's sequence. Ids grow along the sequence, and without a gap in a partition; what is
    put in order is a row for each label and partition."""
    part = F.shiftright("id", 33)
    runs = boxes.groupBy("label", "n", part.alias("part")).agg(F.count("*").alias("rows"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("label", "n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("label", "n", "part", "first", before.alias("before"))
    return boxes.withColumn("part", part).join(runs, ["label", "n", "part"]).withColumn("k", F.col("before") + F.col("id") - F.col("first")).drop("part", "first", "before")


def _tiles(boxes: DataFrame, scratch: Scratch, eps: float) -> DataFrame:
    """(label, n, ta, tb, id, others): blocks by tile, and of which pairs with near boxes they are the left one.

    The pairs come from a recursion over intervals of the sequence.
    """
    tree = [_numbered(boxes.select("label", "n", "id", "low", "high"))]
    tree[0] = scratch.save(tree[0].withColumn("up", F.floor(F.col("k") / FAN)), "boxes")
    dims = range(DIMS)
    while (tree[-1].groupBy("label", "n").count().agg(F.max("count")).first()[0] or 0) > FAN:
        ends = [F.array(*(f(F.element_at(c, d + 1)) for d in dims)).alias(c) for c, f in (("low", F.min), ("high", F.max))]
        above = tree[-1].groupBy("label", "n", F.col("up").alias("k")).agg(*ends)
        tree.append(scratch.save(above.withColumn("up", F.floor(F.col("k") / FAN)), f"boxes{len(tree)}"))

    def far(x: str, y: str):
        apart = lambda d: F.greatest(F.lit(0.0), F.element_at(f"{x}low", d) - F.element_at(f"{y}high", d), F.element_at(f"{y}low", d) - F.element_at(f"{x}high", d))
        return sum((F.pow(apart(d + 1), 2) for d in dims), F.lit(0.0))

    side = lambda t, x: t.select("label", "n", *(F.col(c).alias(f"{x}{c}") for c in ("k", "up", "low", "high")))
    top = side(tree[-1], "a").join(side(tree[-1], "b"), ["label", "n"])
    near = top.where((F.col("ak") <= F.col("bk")) & (far("a", "b") <= eps * eps + 1e-9))
    for level in tree[-2::-1]:
        parents = scratch.save(near.selectExpr("label", "n", "ak aup", "bk bup"), "pairs")
        near = parents.join(side(level, "a"), ["label", "n", "aup"]).join(side(level, "b"), ["label", "n", "bup"])
        near = near.where((F.col("ak") <= F.col("bk")) & (far("a", "b") <= eps * eps + 1e-9))
    ids = tree[0].select("label", "n", "k", "id")
    size = tree[0].groupBy("label", "n").agg(F.count("*").alias("blocks"))
    band = F.greatest(F.lit(BANDS[0]), F.least(F.lit(BANDS[1]), F.ceil(F.sqrt("blocks"))))
    near = near.select("label", "n", "ak", "bk").join(size.select("label", "n", band.alias("band")), ["label", "n"])
    near = near.join(ids.selectExpr("label", "n", "k ak", "id a"), ["label", "n", "ak"]).join(ids.selectExpr("label", "n", "k bk", "id b"), ["label", "n", "bk"])
    near = near.select("label", "n", F.floor(F.col("ak") / F.col("band")).alias("ta"), F.floor(F.col("bk") / F.col("band")).alias("tb"), "a", "b")
    near = scratch.save(near, "blockpairs")
    tile = ["label", "n", "ta", "tb"]
    none = F.array().cast("array<long>")
    lefts = near.groupBy(*tile, F.col("a").alias("id")).agg(F.collect_list("b").alias("others"))
    rights = near.select(*tile, F.col("b").alias("id")).distinct().withColumn("others", none)
    both = lefts.unionByName(rights).groupBy(*tile, "id").agg(F.flatten(F.collect_list("others")).alias("others"))
    return scratch.save(both, "tiles")


def near_vectors(vectors: DataFrame, scratch: Scratch, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors of a label linked at cosine >= least, and their components."""
    spark = vectors.sparkSession
    eps = float(np.sqrt(max(2 - 2 * least, 0)) + 1e-9)
    good = F.coalesce(
        F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    # keys tell classes apart; -0.0 is 0.0
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").withColumn("good", good)
    rows = rows.withColumn("key", F.when(F.col("good"), F.xxhash64("label", v)))
    classes = scratch.save(rows.where("good").groupBy("key").agg(F.first("label").alias("label"), F.count("*").alias("count"), F.first(v).alias("v"), F.min("vec_id").alias("low")), "classes")
    axes = _axes(classes)
    cells = [f"c{k}" for k in range(DIMS)]
    celled = classes.select("key", "label", "count", "v").mapInArrow(_celled(axes, eps), "key long, label string, count long, v array<double>, n int, " + ", ".join(f"{c} int" for c in cells))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "n", *cells, "key"]
    blocks = scratch.save(celled.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks(axes), _BLOCKS), "blocks")
    tiles = _tiles(blocks, scratch, eps)
    full = tiles.join(blocks.select("id", "keys", "counts", "v"), "id")
    found = scratch.save(full.groupBy("label", "n", "ta", "tb").applyInArrow(_tile(least), _FOUND), "found")
    links = found.where("kind = 0").groupBy(F.col("u").alias("key")).agg(F.sum("v").alias("links"))
    roots = components(found.where("kind = 1").select("u", "v"), scratch)
    at = roots.join(classes.selectExpr("key node", "low"), "node")
    low = at.join(at.groupBy("root").agg(F.min("low").alias("component")), "root").selectExpr("node key", "component")
    of = classes.select("key", "count", "low").join(links, "key", "left").join(low, "key", "left").selectExpr("key", "count - 1 + coalesce(links, 0) n_links", "coalesce(component, low) component")
    out = rows.select("vec_id", "key").join(of, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component")).cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
u as (select *, sqrt(list_dot_product(e, e)) as norm from v),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select vec_id, (select count(*) from l where l.a = vec_id) as n_links,
  least(vec_id, coalesce((select min(b) from r where r.a = vec_id), vec_id)) as component_id,
  vec_id <= coalesce((select min(b) from r where r.a = vec_id), vec_id) as kept
from v
"""
