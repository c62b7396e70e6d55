"""What the operators share: scratch tables in the cluster's shared folder, word hashing, connected components."""

from __future__ import annotations

import atexit
import ctypes
import os
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- memory of Python workers: freed arrays go back to the system at once, so that workers that are reused stay small ---

if hasattr(libc := ctypes.CDLL(None), "mallopt"):
    libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: larger blocks are mapped, and unmapped when they are freed
    libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
pa.set_memory_pool(pa.system_memory_pool())


# --- scratch tables ----------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on one machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
    return f"file:///tmp/checkpoints/seekspark-{os.getpid()}"


class Scratch:
    """Parquet tables that cut lineage; they live in the shared folder until the session ends or drop() is called."""

    live: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.made, self.last = 0, ""
        Scratch.live.append(self)
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        self.made += 1
        self.last = f"{self.at}/{self.made}-{name}"
        return self.last

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the table and returns one that reads it. Shuffle files of the write are removed with it: nothing reads them again."""
        path, conf, key = self.path(name), self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key)
        conf.set(key, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str | None = None) -> None:
        try:
            sc = self.spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path or self.at)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended; what is left then is in the shared folder, under our name
            pass


# --- joins with keys of any frequency ----------------------------------------

#: Keys that hold more than one row in so many are joined by a broadcast: there are fewer of them than this number.
HEAVY = 1000


def met(rows: DataFrame, counted: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` (`total` of them) joined with `counted`, which has each key once and how many of the rows have it as `n`.

    A key with more than total / HEAVY rows stays where its rows are: fewer than HEAVY keys can be so frequent, whatever the
    input, so their side of the join is small enough to be sent to every task. The other keys meet by a shuffle.
    """
    heavy = counted.where(F.col("n") > total / HEAVY)
    here = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(counted.where(F.col("n") <= total / HEAVY), key)
    return here.unionByName(rest)


def spare(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- words of whole texts, as 64-bit hashes ----------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and where each row begins (one more at the end); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last+1 byte of each word [^\\x20\\x09-\\x0D]+, and each row's first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    text = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = text.copy(), text.copy()
    first[1:] &= ~text[:-1] | edge[1:-1]
    last[:-1] &= ~text[1:] | edge[1:-1]
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    return first, last, np.searchsorted(first, at)


def hash_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))
    size = last - first
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (eight[first] & _MASK[np.minimum(size, 8)]))
    rows, done = np.flatnonzero(size > 8), 8
    while len(rows):
        h[rows] = mix(h[rows] * np.uint64(0xD6E8FEB86659FD93) + (eight[first[rows] + done] & _MASK[np.minimum(size[rows] - done, 8)]))
        done += 8
        rows = rows[size[rows] > done]
    return h


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, A-Z in lower case if asked, and each row's first word (one more at the end)."""
    data, at = utf8(column)
    if lower:
        data = LOWER[data]
    first, last, begin = words(data, at)
    return hash_spans(data, first, last), begin


def slices(batches: Iterator[pa.RecordBatch], *texts: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, so that memory does not depend on Spark's batch size."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.zeros(b.num_rows, np.int64)
        for t in texts:
            c = b.column(b.schema.get_field_index(t))
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(i, j - i)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


# --- connected components ----------------------------------------------------


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges stop changing, which takes about the logarithm of the
    longest shortest path. Every step is a sum per node and a join back, so nodes with very many edges are pre-aggregated
    on the map side and their join is open to skew splitting.
    """
    e = scratch.save(edges.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), "edges")
    seen, at = None, scratch.last
    for _ in range(most):
        both = e.unionByName(e.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.join(low, "u").where("v > u").selectExpr("v u", "m v").where("u <> v").distinct()
        large = scratch.save(large, "large")
        old = [at, scratch.last]
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").selectExpr("v u", "m v").unionByName(low.selectExpr("u", "m v"))
        e = scratch.save(small.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), "small")
        at = scratch.last
        for x in old:  # nothing reads the rounds before this one again
            scratch.drop(x)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point after {most} rounds")
    return e.selectExpr("u node", "v root").unionByName(e.selectExpr("v node", "v root").distinct())


# --- packed arrays ---------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    out = []
    for x in arrays:
        out += [x.dtype.str.encode().ljust(4), np.uint64([len(x)]).tobytes(), np.ascontiguousarray(x).tobytes()]
    return b"".join(out)


def unpack(b: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(b):
        kind, n = np.dtype(b[at : at + 4].strip().decode()), int(np.frombuffer(b, np.uint64, 1, at + 4)[0])
        out.append(np.frombuffer(b, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def squeezed(*arrays: np.ndarray) -> bytes:
    """The arrays packed and compressed, with their lengths before and after; more bytes may follow."""
    plain = pack(*arrays)
    small = pa.compress(plain, codec="zstd", asbytes=True)
    return np.uint64([len(plain), len(small)]).tobytes() + small


def unsqueezed(b: bytes) -> tuple[list[np.ndarray], bytes]:
    """The arrays of `squeezed`, and the bytes that follow."""
    plain, small = np.frombuffer(b, np.uint64, 2).tolist()
    return unpack(pa.decompress(b[16 : 16 + small], decompressed_size=plain, codec="zstd", asbytes=True)), b[16 + small :]


def least(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))
