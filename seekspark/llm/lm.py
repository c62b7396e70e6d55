"""An interpolated modified Kneser-Ney model: counted in Spark, kept as sorted hash arrays, memory-mapped for scoring.

Texts are lower-cased (A-Z) and split to words [^\\x20\\x09-\\x0D]+; one end token follows, and `order` - 1 start tokens
stand before the first word as context only. Every task counts its own n-grams first, so a word or pair of any frequency
is one row per task; rows then meet by n-gram. Each partition of the highest order is written as one pair of sorted
arrays (keys, counts) by the task that holds it; the lower orders are sums over those (continuation counts), and
the statistics of contexts are kept beside the keys of the contexts.

Interpolation, for a word w after context c of length n - 1:
    p(w | c) = max(count - D(count), 0) / total(c) + gamma(c) * p(w | shorter c),   gamma(c) = sum D_i N_i(c) / total(c)
with D1, D2, D3+ from counts of counts at each order; the unigram level uses continuation counts and is interpolated with
1 / (V + 1), which is what an unseen word gets. Where an order has no counts of counts to estimate from (tiny
corpora), its discounts are 0.5, 1 and 1.5.

A lower-order gram that begins with a start token has its plain count: nothing but start tokens can stand before it, so the number of
words before it says nothing.

Defined results: null or empty text: the end token alone. Null doc_id: never held out (there is no id to hash). Repeated rows are counted
and scored as often as they occur. An empty table gives no row; without a training row every word is unseen. Texts of any length are
whole, one slice each if they are long. Other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, least, mix, pack, slices, unpack, word_hashes

END, START = (np.uint64(x) for x in (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B))
_MUL = np.uint64(0x9E3779B97F4A7C15)
SPREAD = 8


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (key >> np.uint64(40)).astype(np.int64) * parts >> 24


def top_part(context: np.ndarray, last: np.ndarray, order: int, parts: int) -> np.ndarray:
    """The part of an n-gram of the highest order."""
    if order == 1:
        return part_of(mix(last), parts)
    return (part_of(context, parts) + (mix(last) % np.uint64(SPREAD)).astype(np.int64)) % parts


def tokens(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Start tokens, hashes of words and the end token of each row in turn; each row's first place (one more at the end)."""
    h, begin = word_hashes(column)
    n = np.diff(begin)
    at = np.concatenate([[0], np.cumsum(n + order)])
    out = np.empty(at[-1], np.uint64)
    for j in range(order - 1):
        out[at[:-1] + j] = START
    out[at[1:] - 1] = END
    if len(h):
        out[np.arange(len(h)) + np.repeat(at[:-1] + order - 1 - begin[:-1], n)] = h
    return out, at


def grams(t: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n tokens that end at each place from n - 1 on."""
    x = np.zeros(len(t) - n + 1, np.uint64)
    for j in range(n):
        x = mix(x * _MUL + t[j : j + len(x)])
    return x


def _places(at: np.ndarray, order: int) -> np.ndarray:
    """Places of words and end tokens."""
    real = np.ones(at[-1], bool)
    for j in range(order - 1):
        real[at[:-1] + j] = False
    return np.flatnonzero(real)


def _counted(order: int, parts: int):
    """Rows (part, data) of the n-grams of a slice of texts: a list of its tokens, their places in the grams, the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", most=16 << 20):
            t, at = tokens(b.column(0), order)
            i = _places(at, order)
            _, first, count = np.unique(grams(t, order)[i - order + 1], return_index=True, return_counts=True)
            i = i[first]
            context = grams(t, order - 1)[i - order + 1] if order > 1 else np.zeros(len(i), np.uint64)
            part = top_part(context, t[i], order, parts)
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(np.diff(cuts)):
                mine = by[cuts[p] : cuts[p + 1]]
                seen, place = np.unique(np.concatenate([t[i[mine] - j] for j in range(order)]), return_inverse=True)
                rows.append((int(p), pack(seen, least(place), least(count[mine]))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "data"])

    return run


def _key(t: np.ndarray) -> np.ndarray:
    """Of grams as rows of tokens, last token first: their hashes, as `grams` makes them."""
    key = np.zeros(t.shape[1], np.uint64)
    for row in t[::-1]:
        key = mix(key * _MUL + row)
    return key


def _summed(key: np.ndarray, t: np.ndarray, *values: np.ndarray) -> tuple:
    """Distinct keys in order, their tokens, and sums of the values."""
    u, first, back = np.unique(key, return_index=True, return_inverse=True)
    return u, t[:, first], [np.bincount(back, v, len(u)).astype(np.int64) for v in values]


# --- files ---------------------------------------------------------------------


def _write(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Each array to a file of the shared folder, whole or not at all: attempts of a task write the same bytes."""
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    for k, x in enumerate(arrays):
        part = f"{at}/{name}.{k}.{os.getpid()}-{os.urandom(4).hex()}"
        with fs.open_output_stream(part) as f:
            f.write(np.ascontiguousarray(x).data)
        fs.move(part, f"{at}/{name}.{k}")


def _mapped(folder: str, name: str, k: int, dtype, rows: int = 0) -> np.ndarray:
    """The array, memory-mapped: in place where the folder is mounted, else from an unlinked local copy.

    Whole numbers without a type are `rows` in as many bytes as the largest of the part needs."""
    fs, at = pafs.FileSystem.from_uri(f"{folder}/{name}.{k}")
    size = fs.get_file_info(at).size
    if not size:
        return np.zeros(0, dtype or np.uint8)
    dtype = dtype or np.dtype(f"u{size // rows}")
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(at, dtype, "r")
    with tempfile.NamedTemporaryFile() as f:
        with fs.open_input_stream(at) as g:
            while block := g.read(8 << 20):
                f.write(block)
        f.flush()
        return np.memmap(f.name, dtype, "r")


# --- fitting ---------------------------------------------------------------------


_STATS = "kind int, part int, data binary"


def _packed(kind: int, parts: int, key: np.ndarray, t: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """Rows (kind, part, data) of sums by key, keys in order."""
    cuts = np.searchsorted(part_of(key, parts), np.arange(parts + 1))
    return [(kind, int(p), pack(key[i:j], *t[:, i:j], *(least(v[i:j]) for v in values))) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]


def _unpacked(frame: pd.DataFrame, tokens: int) -> tuple:
    """What rows of one kind and part hold, summed by key."""
    columns = [np.concatenate(c) for c in zip(*(unpack(x) for x in frame["data"]), strict=True)]
    t = np.stack(columns[1 : 1 + tokens]) if tokens else np.zeros((0, len(columns[0])), np.uint64)
    return _summed(columns[0], t, *columns[1 + tokens :])


def _below(t: np.ndarray, count: np.ndarray, n: int, parts: int, plain: np.ndarray | None = None) -> pd.DataFrame:
    """What is learned from the n-grams: kind n, of each context its total and how many words follow it once, twice, more
    often; kind 1 - n, of each gram one shorter how many words stand before it, and how often it stands in all; kind 200 + n,
    how many n-grams were counted once to four times."""
    u, none, v = _summed(_key(t[1:]), t[:0], count, count == 1, count == 2, count > 2)
    rows = _packed(n, parts, u, none, *v)
    if n > 1:
        before = np.where(t[n - 2] == START, count, 1) if n > 2 else np.ones(t.shape[1])
        u, tail, v = _summed(_key(t[: n - 1]), t[: n - 1], before, np.zeros(t.shape[1]) if plain is None else plain)
        rows += _packed(1 - n, parts, u, tail, *v)
    rows.append((200 + n, 0, pack(np.array([int((count == i).sum()) for i in (1, 2, 3, 4)]))))
    return pd.DataFrame(rows, columns=["kind", "part", "data"])


def _merged(order: int, parts: int, folder: str):
    """Sums a part's grams, writes its arrays, and passes on what contexts and lower orders need."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        ts, counts = [], []
        for seen, place, count in map(unpack, frame["data"]):
            ts.append(seen[place].reshape(order, -1)), counts.append(count)
        t = np.concatenate(ts, axis=1)
        u, t, (count,) = _summed(_key(t), t, np.concatenate(counts))
        _write(folder, f"top-{int(key[0])}", u, least(count))
        out = _below(t, count, order, parts, count if order == 2 else None)
        if order != 2:  # plain counts of words; with pairs they come with the tails
            u, none, v = _summed(t[0], t[:0], count)
            out = pd.concat([out, pd.DataFrame(_packed(100, parts, u, none, *v), columns=out.columns)])
        return out

    return run


def _lower(n: int, parts: int, folder: str, words: bool):
    """A part of the n-grams below the highest order, from rows of kind -n. `words`: their plain counts are those of words."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        u, t, (count, plain) = _unpacked(frame, n)
        p = int(key[0])
        _write(folder, f"mid{n}-{p}", u, least(count))
        out = _below(t, count, n, parts)
        if words:  # words are looked up by their own hash
            out = pd.concat([out, pd.DataFrame(_packed(100, parts, *_in_order(t[0], plain)), columns=out.columns)])
        return out

    return run


def _in_order(key: np.ndarray, value: np.ndarray) -> tuple:
    o = np.argsort(key)
    return key[o], np.zeros((0, len(o)), np.uint64), value[o]


def _stored(name: str, folder: str):
    """Writes a part of the sums by key; passes on how many keys there are, and the total of the first value."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        u, _, values = _unpacked(frame, 0)
        _write(folder, f"{name}-{int(key[0])}", u, *map(least, values))
        return pd.DataFrame({"n": [len(u)], "total": [int(values[0].sum())]})

    return run


class Model:
    """Where the arrays lie, in how many parts, and the numbers that hold for all of it. Small; tasks open the arrays."""

    def __init__(self, folder: str, order: int, parts: int, discounts: dict[int, list[float]], total: int, types: int):
        self.folder, self.order, self.parts, self.discounts, self.total, self.types = folder, order, parts, discounts, total, types
        self.open: dict[str, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def look(self, table: str, key: np.ndarray, values: int = 1, part: np.ndarray | None = None) -> list[np.ndarray]:
        """The table's values for the keys, 0 where it has none."""
        u, first, back = np.unique(key, return_index=True, return_inverse=True)
        out = [np.zeros(len(u), np.int64) for _ in range(values)]
        part = part_of(u, self.parts) if part is None else part[first]
        by = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[by], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            name = f"{table}-{p}"
            if name not in self.open:
                try:
                    keys = _mapped(self.folder, name, 0, np.uint64)
                    self.open[name] = (keys, *(_mapped(self.folder, name, k + 1, None, len(keys)) for k in range(values)))
                except FileNotFoundError:  # no row fell to this part
                    self.open[name] = (np.zeros(0, np.uint64), *(np.zeros(0, np.uint8) for _ in range(values)))
            keys, *arrays = self.open[name]
            mine = by[cuts[p] : cuts[p + 1]]
            at = np.searchsorted(keys, u[mine])
            hit = np.flatnonzero(at < len(keys))
            hit = hit[keys[at[hit]] == u[mine[hit]]]
            for x, v in zip(out, arrays, strict=True):
                x[mine[hit]] = v[at[hit]]
        return [x[back] for x in out]

    def score(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """Of each row: tokens, known tokens, base score and the model's log10 probability."""
        t, at = tokens(column, self.order)
        i = _places(at, self.order)
        (count,) = self.look("word", t[i])
        p = np.full(len(i), 1.0 / (self.types + 1))
        for n in range(1, self.order + 1):
            x = grams(t, n)[i - n + 1]
            context = np.zeros(len(i), np.uint64) if n == 1 else grams(t, n - 1)[i - n + 1]
            if n == self.order:
                (c,) = self.look("top", x, part=top_part(context, t[i], n, self.parts))
            else:
                (c,) = self.look(f"mid{n}", x)
            total, n1, n2, n3 = self.look(f"ctx{n}", context, 4)
            d = np.array([0.0, *self.discounts[n]])
            seen = total > 0
            safe = np.maximum(total, 1)
            new = np.maximum(c - d[np.minimum(c, 3)], 0) / safe + (d[1] * n1 + d[2] * n2 + d[3] * n3) / safe * p
            p = np.where(seen, new, p)
        base = np.log10((count + 0.1) / (self.total + 0.1 * (self.types + 1)))
        row = np.repeat(np.arange(len(at) - 1), np.diff(at) - self.order + 1)
        add = lambda v: np.bincount(row, v, len(at) - 1)
        return np.diff(at) - self.order + 1, add(count > 0).astype(np.int64), add(base), add(np.log10(p))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    if min(n1, n2, n3) == 0:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(x, 0.05), k) for x, k in zip(d, (1.0, 2.0, 3.0), strict=True)]


def fit(docs: DataFrame, scratch: Scratch, order: int = 2) -> Model:
    """Counts all texts of `docs`. What reaches the driver is four numbers for each order and two for the whole."""
    spark = docs.sparkSession
    folder = scratch.path("arrays")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    blobs = docs.select("text").mapInArrow(_counted(order, parts), "part int, data binary")
    every = [scratch.save(blobs.groupBy("part").applyInPandas(_merged(order, parts, folder), _STATS), "stats")]
    for n in range(order - 1, 0, -1):
        rows = every[-1].where(F.col("kind") == -n)
        every.append(scratch.save(rows.groupBy("part").applyInPandas(_lower(n, parts, folder, order == 2), _STATS), f"stats{n}"))
    of: dict[int, np.ndarray] = {}
    for x in every:  # a few numbers for each part
        for kind, _, data in x.where("kind > 200").toLocalIterator():
            of[kind - 200] = of.get(kind - 200, np.zeros(4, np.int64)) + unpack(data)[0]

    def store(kind: int, name: str) -> tuple[int, int]:
        rows = None
        for x in every:
            x = x.where(F.col("kind") == kind)
            rows = x if rows is None else rows.unionByName(x)
        n, total = rows.groupBy("part").applyInPandas(_stored(name, folder), "n long, total long").agg(F.sum("n"), F.sum("total")).first()
        return n or 0, total or 0

    types, total = store(100, "word")
    for n in range(1, order + 1):
        store(n, f"ctx{n}")
    return Model(folder, order, parts, {n: _discounts(*map(int, of.get(n, np.zeros(4)))) for n in range(1, order + 1)}, total, types)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n, known, base, p = model.score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.total)), pa.array(base), pa.array(p)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_score(docs: DataFrame, scratch: Scratch, order: int = 2, folds: int = 10) -> DataFrame:
    """Fits on the documents whose crc32(doc_id as text) mod folds is not 0, and scores all."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    scored = score(docs, fit(docs.where(~held), scratch, order))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Who is held out: crc32, a bit a step.
CRC = """crc(doc_id, bytes, i, x) as (select doc_id, cast(doc_id as varchar), 0, xor(4294967295::bigint, ascii(cast(doc_id as varchar)[1])::bigint) from documents where doc_id is not null union all
  select doc_id, bytes, i + 1, case when (i + 1) % 8 = 0 and i + 1 < 8 * length(bytes) then xor(case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end, ascii(bytes[(i + 1) // 8 + 1])::bigint)
    else case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end end from crc where i < 8 * length(bytes)),
held as (select documents.doc_id, coalesce(xor(x, 4294967295::bigint) % 10 = 0, false) as held_out from documents left join (select doc_id, x from crc where i = 8 * length(bytes)) c on c.doc_id = documents.doc_id)"""
#: The same rows at order 2, from the definition.
ORACLE = f"""
with recursive {CRC},
w as (select doc_id, held_out, list_append(coalesce({WORDS.format(LOWER)}, []), ' ') as ws from documents join held using (doc_id)),
t as (select doc_id, held_out, i, w, coalesce(lag(w) over (partition by doc_id order by i), chr(9)) as a from (select doc_id, held_out, unnest(ws) as w, generate_subscripts(ws, 1) as i from w)),
c2 as (select a, w, count(*) as c from t where not held_out group by a, w),
c1 as (select w, count(*) as c, sum(c) as plain from c2 group by w),
v as (select sum(plain) as n, count(*) as v, sum(c) as total, sum(cast(c = 1 as int)) as n1, sum(cast(c = 2 as int)) as n2, sum(cast(c > 2 as int)) as n3 from c1),
k(o, n1, n2, n3, n4) as (select 2, count(*) filter (c = 1), count(*) filter (c = 2), count(*) filter (c = 3), count(*) filter (c = 4) from c2 union all
  select 1, count(*) filter (c = 1), count(*) filter (c = 2), count(*) filter (c = 3), count(*) filter (c = 4) from c1),
y as (select *, n1 / (n1 + 2 * n2) as y, least(n1, n2, n3) = 0 as few from k),
d as (select o, case when few then [0.5, 1.0, 1.5] else [least(greatest(1 - 2 * y * n2 / n1, 0.05), 1.0), least(greatest(2 - 3 * y * n3 / n2, 0.05), 2.0), least(greatest(3 - 4 * y * n4 / n3, 0.05), 3.0)] end as d from y),
x2 as (select a, sum(c) as total, count(*) filter (c = 1) as n1, count(*) filter (c = 2) as n2, count(*) filter (c > 2) as n3 from c2 group by a),
p as (select t.doc_id, coalesce(c1.plain, 0) as plain, v.n, v.v,
    greatest(coalesce(c1.c, 0) - case when c1.c is null then 0 else d1.d[least(c1.c, 3)] end, 0) / v.total + (d1.d[1] * v.n1 + d1.d[2] * v.n2 + d1.d[3] * v.n3) / v.total / (v.v + 1) as p1,
    x2.total, greatest(coalesce(c2.c, 0) - case when c2.c is null then 0 else d2.d[least(c2.c, 3)] end, 0) as top, d2.d[1] * x2.n1 + d2.d[2] * x2.n2 + d2.d[3] * x2.n3 as rest
  from t cross join v cross join (select d from d where o = 1) d1 cross join (select d from d where o = 2) d2 left join c1 on c1.w = t.w left join x2 on x2.a = t.a left join c2 on c2.a = t.a and c2.w = t.w)
select p.doc_id, held_out, count(*) as n_tokens, count(*) filter (plain > 0) as n_known, cast(any_value(n) as bigint) as train_tokens,
  round(sum(log10((plain + 0.1) / (n + 0.1 * (v + 1)))), 6) as base_score, round(sum(log10(case when total is null then p1 else top / total + rest / total * p1 end)), 6) as score
from p join held using (doc_id) group by p.doc_id, held_out
"""
