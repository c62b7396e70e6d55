"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents are sets of distinct five-word shingles. Equal sets collapse to one class before anything else, so exact copies
cost one row whatever their number. Each class has `TREES` signatures of `DEPTH` minima; for each tree the classes are
sorted by signature, and neighbours in that order whose longest common prefix is at least `SHALLOW` minima are candidates.
A region, the rows of one shallow prefix, of at most `window` + 1 rows lies in one partition and is compared in full. In a denser
one the neighbours are those with a longer prefix in common; they join most of it, and all pairs that are still apart are then
counted on their full sets, block against block (`_parts`, `_linked`), so nothing depends on which neighbours were met first, nor on
where partitions end. A candidate whose estimated similarity is far below the threshold (by over four standard errors) is
dropped; all others are confirmed on the full shingle sets. Two documents at similarity 0.8 share a shallow prefix in none of
the trees with probability 3e-6.

Defined results: null or wordless text: empty set, linked with nothing, its own component. Fewer than five words: the
whole sequence is the one shingle. Equal doc_ids with unlike texts are separate documents. A null doc_id takes part; a
component of none but null ids has a null id. Texts of any length are taken whole. Repeated rows are all returned; `one_each` keeps one of them. An empty table gives no
row. Other columns are ignored, and pass through `one_each`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, longs, mix, slices, spare, word_hashes

TREES, DEPTH, SHALLOW, WORDS = 24, 6, 4, 5
#: What a block of a crowded region holds at most, about.
ROWS, SHINGLES = 1024, 4 << 20
_R = np.random.default_rng(20240607)
_A = (_R.integers(0, 1 << 32, TREES * DEPTH, np.uint32) | np.uint32(1))[:, None]
_B = _R.integers(0, 1 << 32, TREES * DEPTH, np.uint32)[:, None]


def shingle_sets(column: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each row's k-word shingles."""
    h, begin = word_hashes(column)
    n = len(h)
    s = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(s)]
    s = mix(s)
    for i, j in zip(begin[:-1], begin[1:], strict=True):
        if j - i >= k:
            yield np.unique(s[i : j - k + 1])
        elif j > i:
            x = np.uint64([j - i])
            for w in h[i:j]:
                x = mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + w)
            yield x
        else:
            yield s[:0]


def _signature(s: np.ndarray) -> np.ndarray:
    x, out = (s >> np.uint64(32)).astype(np.uint32), np.empty(TREES * DEPTH, np.uint32)
    step = max(1, min(TREES * DEPTH, (1 << 16) // max(len(x), 1)))
    for i in range(0, TREES * DEPTH, step):
        out[i : i + step] = ((x ^ _B[i : i + step]) * _A[i : i + step]).min(axis=1)
    return out


_SETS = "doc_id long, tkey long, n_shingles long, cid long, c2 long, sig binary, sk binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _SETS.split(", ")]
    for b in slices(batches, "text"):
        n, c1, c2, sig, sk = [], [], [], [], []
        for s in shingle_sets(b.column(2)):
            n.append(len(s))
            c1.append(int(mix(s ^ np.uint64(len(s))).sum(dtype=np.uint64).view(np.int64)))
            c2.append(int(mix(s + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).view(np.int64)))
            x = _signature(s) if len(s) else None
            sig.append(None if x is None else x.astype(">u4").tobytes())
            sk.append(None if x is None else ((x * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sig, pa.binary()), pa.array(sk, pa.binary())], names)


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: the tree's number and its minima, big-endian, so that bytes sort as signatures do."""
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, TREES, DEPTH * 4)
            keys = np.concatenate([np.broadcast_to(np.arange(TREES, dtype=np.uint8)[None, :, None], (b.num_rows, TREES, 1)), sig], axis=2)
            flat = np.ascontiguousarray(keys).reshape(-1)
            at = np.arange(0, len(flat) + 1, DEPTH * 4 + 1, dtype=np.int32)
            key = pa.Array.from_buffers(pa.binary(), b.num_rows * TREES, [None, pa.py_buffer(at), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), TREES)), key], ["cid", "key"])


def _neighbours(window: int):
    """Of rows sorted by key: pairs at most `window` apart that share the shallow prefix with all between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, heads = np.zeros(0, np.int64), np.zeros(0, f"V{1 + 4 * SHALLOW}")
        for b in batches:
            if not b.num_rows:
                continue
            key = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            head = np.ascontiguousarray(key[:, : 1 + 4 * SHALLOW]).view(f"V{1 + 4 * SHALLOW}")[:, 0]
            old = len(ids)
            ids, heads = np.concatenate([ids, b.column(0).to_numpy()]), np.concatenate([heads, head])
            us, vs = [], []
            for w in range(1, min(window, len(ids) - 1) + 1):
                at = np.flatnonzero(heads[:-w] == heads[w:])
                at = at[at + w >= old]
                us.append(ids[at]), vs.append(ids[at + w])
            ids, heads = ids[-window:], heads[-window:]
            u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return run


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of texts, eight bytes a shingle."""
    for b in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1))], pa.binary())], ["cid", "shingles"])


def _linked(percent: int, block: int = 256, step: int = 8192):
    """Of rows (root, shingles): the components that any of their pairs links, as a forest of roots.

    All pairs of unlike components are counted on their full sets, by matrix products over the shingles two blocks have in common.
    """

    def run(table: pa.Table) -> pa.Table:
        root = table.column("root").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        order = np.argsort([len(x) for x in sets], kind="stable")
        root, sets = root[order], [sets[i] for i in order]
        n = np.array([len(x) for x in sets], np.int64)
        blocks = [slice(i, i + block) for i in range(0, len(sets), block)]
        flat = [(np.repeat(np.arange(len(n[at])), n[at]), np.concatenate(sets[at])) for at in blocks]
        known = [np.unique(x) for _, x in flat]
        up, us, vs = {}, [], []

        def find(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        def ones(k: int, some: np.ndarray) -> np.ndarray:
            r, x = flat[k]
            c = np.minimum(np.searchsorted(some, x), len(some) - 1)
            ok = some[c] == x
            out = np.zeros((len(n[blocks[k]]), len(some)), np.float32)
            out[r[ok], c[ok]] = 1
            return out

        for i, x in enumerate(blocks):
            for j, y in enumerate(blocks[: i + 1]):
                apart = root[x, None] != root[None, y]
                if 100 * n[y][-1] < percent * n[x][0] or not apart.any():  # sizes ascend
                    continue
                shared = np.intersect1d(known[i], known[j], assume_unique=True)
                both = np.zeros(apart.shape, np.int64)
                for k in range(0, len(shared), step):
                    some = shared[k : k + step]
                    both += (ones(i, some) @ ones(j, some).T).astype(np.int64)
                r, c = np.nonzero(apart & (100 * both >= percent * (n[x, None] + n[None, y] - both)))
                if len(r):
                    for u, v in np.unique(np.stack([root[x][r], root[y][c]]), axis=1).T.tolist():
                        u, v = sorted((find(u), find(v)))
                        if u != v:
                            up[v] = u
                            us.append(u), vs.append(v)
                    some, at = np.unique(root, return_inverse=True)
                    root = np.array([find(r) for r in some.tolist()], np.int64)[at]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _parts(dense: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """(head, a, b, cid, root): the rows of crowded regions (head, cid), dealt to parts so that any two rows of unlike components of a region meet in one.

    A region's largest component need not be held against itself. The others, and it, are dealt by hash to so many blocks that
    none has much over ROWS rows or SHINGLES shingles, and each two blocks that must meet, (a, b), are one part.
    """
    rows = dense.join(roots.selectExpr("node cid", "root"), "cid", "left").join(sizes, "cid").selectExpr("head", "cid", "coalesce(root, cid) root", "n_shingles")
    each = rows.groupBy("head", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    regions = each.groupBy("head").agg(F.max(F.struct("n", "size", "root")).alias("lead"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > lead.n")
    blocks = "cast(ceil(greatest({0} / %d, {1} / %d)) as int)" % (ROWS, SHINGLES)
    regions = regions.selectExpr("head", "lead.root lead", blocks.format("(n - lead.n)", "(size - lead.size)") + " few", blocks.format("lead.n", "lead.size") + " many")
    rows = rows.join(regions, "head").withColumn("h", F.xxhash64("cid"))
    rows = rows.selectExpr("head", "cid", "root", "if(root = lead, few + pmod(h, many), pmod(h, few)) k", "explode(sequence(0, if(root = lead, few, few + many) - 1)) j")
    return rows.selectExpr("head", "least(k, j) a", "greatest(k, j) b", "cid", "root")


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            same = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same)], ["u", "v", "est"])


def _confirmed(percent: int):
    """Which of the pairs (u, v, their texts) have at least that similarity on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "tu", "tv"):
            linked = []
            for x, y in zip(shingle_sets(b.column(2)), shingle_sets(b.column(3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["u", "v", "linked"])

    return run


def _place():
    """A document's place in order: ids before none, smallest first, then by hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = 80, window: int = 4) -> DataFrame:
    """doc_id, tkey (hash of the text), n_shingles, component_id, kept, first for every row of `docs`.

    Documents are linked at 100 * intersection >= percent * union. `kept` tells whether doc_id is the component's; `first`, whether
    the row is the component's first by doc_id (nulls last) and hash of the text, which rows that repeat another one share with it.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    sets = scratch.save(keyed.mapInArrow(_sets, _SETS), "sets")
    classes = scratch.save(
        sets.where("n_shingles > 0").groupBy("cid", "c2").agg(F.min(F.struct("doc_id", "tkey")).alias("first"), F.min(_place()).alias("place"), F.min("doc_id").alias("low"), F.first("sig").alias("sig"), F.first("sk").alias("sk"), F.first("n_shingles").alias("n_shingles")), "classes"
    )
    branches = classes.select("cid", "sig").mapInArrow(_branches, "cid long, key binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Regions with more rows than the window. Their neighbours are only a beginning: what these leave apart is compared in full below.
    head = F.substring("key", 1, 1 + 4 * SHALLOW)
    crowded = scratch.save(branches.groupBy(head.alias("head")).count().where(F.col("count") > window + 1).select("head"), "crowded")
    branches = branches.withColumn("head", head)
    dense = scratch.save(branches.join(crowded, "head").select("cid", "key", "head"), "dense")
    # The others lie in one partition each, and all their pairs are within the window.
    loose = branches.join(crowded, "head", "left_anti").repartition(n, "head").select("cid", "key")
    near = [x.sortWithinPartitions("key", "cid").mapInArrow(_neighbours(window), "u long, v long") for x in (loose, dense.select("cid", "key").repartitionByRange(n, "key", "cid"))]
    pairs = near[0].unionByName(near[1]).where("u <> v").distinct()
    sk = classes.select("cid", "sk")
    pairs = pairs.join(sk.selectExpr("cid u", "sk ku"), "u").join(sk.selectExpr("cid v", "sk kv"), "v").select("u", "v", "ku", "kv")
    least = percent / 100 - 4.2 * (percent / 100 * (1 - percent / 100) / (TREES * DEPTH)) ** 0.5
    pairs = scratch.save(pairs.mapInArrow(_estimates, "u long, v long, est double").where(F.col("est") >= least), "pairs")
    ends = pairs.selectExpr("u cid").unionByName(pairs.selectExpr("v cid")).unionByName(dense.select("cid")).distinct()
    wanted = ends.join(classes.selectExpr("cid", "first.doc_id", "first.tkey"), "cid")
    texts = scratch.save(keyed.dropDuplicates(["doc_id", "tkey"]).join(wanted, keyed.doc_id.eqNullSafe(wanted.doc_id) & (keyed.tkey == wanted.tkey)).select("cid", "text"), "texts")

    def confirm(some: DataFrame) -> DataFrame:
        full = some.join(texts.selectExpr("cid u", "text tu"), "u").join(texts.selectExpr("cid v", "text tv"), "v").select("u", "v", "tu", "tv")
        return full.mapInArrow(_confirmed(percent), "u long, v long, linked boolean")

    # First one promising pair for each class: most classes find their component with it, and need no other.
    best = pairs.groupBy("v").agg(F.max_by("u", F.struct("est", "u")).alias("u")).unionByName(pairs.groupBy("u").agg(F.max_by("v", F.struct("est", "v")).alias("v"))).selectExpr("least(u, v) u", "greatest(u, v) v").distinct()
    first = scratch.save(confirm(best), "first")
    roots = scratch.save(components(first.where("linked"), scratch), "roots")
    at = lambda x: roots.selectExpr(f"node {x}", f"root r{x}")
    open_pairs = pairs.join(first.select("u", "v"), ["u", "v"], "left_anti").join(at("u"), "u", "left").join(at("v"), "v", "left").where("coalesce(ru, u) <> coalesce(rv, v)")
    tried = first.unionByName(scratch.save(confirm(open_pairs.select("u", "v")), "second"))
    roots = scratch.save(components(tried.where("linked"), scratch), "roots2")
    # Whatever is still apart in a crowded region is compared in full.
    parts = scratch.save(_parts(dense.select("cid", "head"), roots, classes.select("cid", "n_shingles")), "parts")
    full = scratch.save(texts.join(parts.select("cid").distinct(), "cid", "left_semi").select("cid", "text").mapInArrow(_set_rows, "cid long, shingles binary"), "full")
    met = parts.join(full, "cid").groupBy("head", "a", "b").applyInArrow(_linked(percent), "u long, v long")
    third = scratch.save(met, "third")
    roots = components(roots.selectExpr("node u", "root v").unionByName(third), scratch)
    whole = roots.join(classes.select(F.col("cid").alias("node"), "low", "place"), "node")
    least_of = whole.groupBy("root").agg(F.min("low").alias("component"), F.min("place").alias("head"))
    low = whole.join(least_of, "root").selectExpr("node cid", "component", "head")
    low = classes.select("cid", "c2", "low", "place").join(low, "cid", "left")
    low = low.selectExpr("cid", "c2", "coalesce(component, low) component", "coalesce(head, place) head")
    out = sets.drop("sig", "sk").join(low, ["cid", "c2"], "left")
    any_ = F.col("n_shingles") > 0
    out = out.withColumn("component_id", F.when(any_, F.col("component")).otherwise(F.col("doc_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "tkey", "n_shingles", "component_id", kept.alias("kept"), (~any_ | F.col("head").eqNullSafe(_place())).alias("first"))


def one_each(docs: DataFrame, scratch: Scratch, percent: int = 80) -> DataFrame:
    """Rows of `docs`, all columns: of each component the first document, once. Rows without a word all stay."""
    groups = scratch.save(near_duplicates(docs, scratch, percent).select("doc_id", "tkey", "n_shingles", "first"), "groups")
    gone = scratch.save(groups.where("not first").select("doc_id", "tkey").distinct(), "gone")
    again = scratch.save(groups.where("first and n_shingles > 0").groupBy("doc_id", "tkey").count().where("count > 1").select("doc_id", "tkey"), "again")
    tkey, did, dkey, key = (spare(x, docs) for x in ("tkey", "did", "dkey", "whole"))
    keyed = docs.withColumn(tkey, F.xxhash64("text"))
    of = lambda x: x.withColumnsRenamed({"doc_id": did, "tkey": dkey})
    same = F.col("doc_id").eqNullSafe(F.col(did)) & (F.col(tkey) == F.col(dkey))
    left = keyed.join(of(gone), same, "left_anti")
    # rows that repeat one that stays: the least of them by hash of the row
    repeats = left.join(of(again), same, "left_semi")
    row = F.struct(*docs.columns)
    one = repeats.groupBy("doc_id", tkey).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(key)).select(f"{key}.*")
    return left.join(of(again), same, "left_anti").select(*docs.columns).unionByName(one)


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: The same rows from the definition.
ORACLE = f"""
with recursive w as (select doc_id, coalesce({WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
g as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p where 100 * c >= 85 * (na + nb - c)),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as b from r group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(b, doc_id)) as component_id, doc_id <= coalesce(b, doc_id) as kept
from s left join c on doc_id = a
"""
