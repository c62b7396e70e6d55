"""Spelling variants: words that one inserted, deleted or replaced code point turns into each other, grouped by their commonest form.

The dictionary is all words with their counts. One edit leaves the first or the second half of a word intact, so a pair shares a prefix
in the forward dictionary or a suffix in the reversed one. Words are put in blocks by the part they share and the length of the
shorter word (`l`): blocks of replacements hold words of one length, blocks of insertions words of two. A block is a range of words in
order of its key, which a task scans from memory. A block of more than SMALL words is subdivided instead: of what its words do
not share yet, one half must be intact again, so each word goes to two blocks that share more. An edit at one position takes one way
through all subdivisions, so a pair meets in one block only, and is verified there on the words themselves. Where nothing is left to
divide, a block holds the words that differ at one position: no more than there are letters, so no block is ever too large.

A word's form is its near word of largest count, if that is `ratio` times its own; roots follow the forms. Counts grow at least by `ratio` with
every step, so chains are short and have no cycles; each round of joins doubles how far a word has followed its chain.

Defined results. Null and empty texts have no words. Texts and words of any length are taken whole. Repeated rows count each by itself. A null
doc_id is an empty one where runs are edited. Ties in count go to the word that is smaller in code-point order. Other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_runs import crc_spans, runs
from .common import LOWER, Scratch, met, slices, utf8

#: Blocks of more words are subdivided while they can be.
SMALL = 32
#: Common beginnings of longer words are found by halving, not byte by byte.
LONG = 256


# --- the dictionary ------------------------------------------------------------


def _slice_counts(ids: pa.Array, texts: pa.Array, every: int, least: int) -> tuple[pa.Array, pa.Array]:
    """The words of the rows and how often they occur; of one run in `every`, by its hash, a code point is deleted."""
    data, at = utf8(texts)
    data = LOWER[data]
    lead = data == 0xC3  # U+00C0 to U+00FF are 0xC3 and one more byte
    letter = (data >= 0x61) & (data <= 0x7A) | lead
    letter[1:] |= lead[:-1]
    first, last, begin = runs(letter, at)
    name = np.array([zlib.crc32(b":" if i is None else b"%d:" % i) for i in ids.to_pylist()], np.uint32)
    h = crc_spans(data, first, last, np.repeat(name, np.diff(begin))).astype(np.int64)
    starts = letter.copy()
    starts[1:] &= ~lead[:-1]
    before = np.concatenate([[0], np.cumsum(starts)])
    points = before[last] - before[first]
    hit = np.flatnonzero(h % every == 0)
    gone = np.flatnonzero(starts)[before[first[hit]] + h[hit] % points[hit]]
    points[hit] -= 1
    size = last - first
    size[hit] -= 1 + lead[gone]
    drop = np.zeros(len(data) + 1, bool)
    drop[gone] = True
    drop[gone[lead[gone]] + 1] = True
    kept = points >= least
    inside = np.flatnonzero(letter)
    body = data[inside[np.repeat(kept, last - first) & ~drop[inside]]]
    offsets = np.concatenate([[0], np.cumsum(size[kept])])
    counts = pa.LargeStringArray.from_buffers(int(kept.sum()), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)).value_counts()
    return counts.field(0), counts.field(1)


def dictionary(docs: DataFrame, every: int = 97, least_points: int = 5, least_count: int = 3) -> DataFrame:
    """word, freq, len: the words of at least `least_points` code points that occur `least_count` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("freq", "sum")]).rename_columns(["word", "freq"])

        for b in slices(batches, "text"):
            word, n = _slice_counts(b.column(0), b.column(1), every, least_points)
            held.append(pa.table({"word": word, "freq": n}))
            rows += len(n)
            if rows > 1 << 19:
                held = [summed()]
                rows = held[0].num_rows
                if rows > 1 << 18:
                    yield from held[0].combine_chunks().to_batches()
                    held, rows = [], 0
        if rows:
            yield from summed().combine_chunks().to_batches()

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, freq long")
    return counts.groupBy("word").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= least_count).withColumn("len", F.length("word"))


# --- blocks --------------------------------------------------------------------

_KEY = "xxhash64(kind, l, a, b, substring(word, 1, a), right(word, b)) key"
_BLOCK = ["word", "freq", "len", "kind", "l", "a", "b"]


def _divided(rows: DataFrame) -> DataFrame:
    """Each row in the two blocks that share one more half of what is not shared yet: the first a and the last b code points are."""
    free = rows.withColumn("f", F.expr("l - a - b")).withColumn("m", F.expr("if(kind = 'r', f div 2, (f + 1) div 2)"))
    parts = F.explode(F.expr("array(struct(int(a + m) a, b b), struct(a a, int(b + f - m + if(kind = 'r', 0, 1)) b))"))
    return free.select("word", "freq", "len", "kind", "l", parts.alias("at")).select("word", "freq", "len", "kind", "l", "at.a", "at.b").selectExpr("*", _KEY)


def links(words: DataFrame, scratch: Scratch, small: int = SMALL) -> DataFrame:
    """word, freq, near, near_freq: every pair of near words, in both directions, each once."""
    kinds = "array(struct('r' kind, len l), struct('i' kind, len l), struct('i' kind, len - 1 l))"
    rows = words.selectExpr("word", "freq", "len", f"explode({kinds}) k").select("word", "freq", "len", "k.kind", "k.l").selectExpr("*", "0 a", "0 b")
    found = None
    for depth in range(64):  # what is not shared halves each time
        rows = _divided(rows)
        counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.expr("int(len > l)")).alias("longer"))
        counts = counts.where("n > 1 and (longer = 0 or n > longer)").select("key", "n")
        level = scratch.save(met(rows, counts, "key", rows.count()), f"blocks{depth}")
        here = F.expr(f"n <= {small} or l - a - b <= if(kind = 'r', 1, 0)")
        block = level.where(here).repartition("key").sortWithinPartitions("key", "kind", "l", "a", "b", "word").select("key", *_BLOCK)
        near = block.mapInArrow(_scan, "word string, freq long, near string, near_freq long")
        near = scratch.save(near, f"links{depth}")
        found = near if found is None else found.unionByName(near)
        rows = level.where(~here).select(*_BLOCK)
        if rows.isEmpty():
            return found
    raise RuntimeError("links: blocks are left after 64 subdivisions")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the words of each block; the last block of a batch waits for the next batch."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        key = t.column("key").to_numpy()
        cut = int(np.searchsorted(key != key[-1], False)) if key[0] == key[-1] else len(key) - int(np.argmax(key[::-1] != key[-1]))
        rest = t.slice(cut)
        if cut:
            yield from _pairs(t.slice(0, cut))
    if rest is not None and rest.num_rows:
        yield from _pairs(rest)


def _pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
    word = t.column("word").combine_chunks()
    data, at = utf8(word)
    lead = data == 0xC3
    letters = np.where(np.concatenate([[False], lead[:-1]]), data + 0x40, data)[~lead]  # code points: none is beyond U+00FF
    first = at - np.concatenate([[0], np.cumsum(lead)])[at]
    size = np.diff(first)
    key, l, a, b = (t.column(c).to_numpy() for c in ("key", "l", "a", "b"))
    swap = pc.equal(t.column("kind"), "r").to_numpy()
    left, right = [], []
    for d in range(1, len(key)):
        i = np.flatnonzero(key[:-d] == key[d:])
        if not len(i):
            break
        j = i + d
        may = (swap[i] == swap[j]) & (l[i] == l[j]) & (a[i] == a[j]) & (b[i] == b[j]) & (swap[i] | (size[i] != size[j]))
        i, j = i[may], j[may]
        less, more = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        head = _shared(letters, first[i], first[j], less, 1)
        tail = _shared(letters, first[i] + size[i] - 1, first[j] + size[j] - 1, less, -1)
        # a pair of insertions may be edited at several places: it belongs to the block of the last
        near = (head + tail >= more - 1) & (head >= a[i]) & (head <= l[i] - b[i])
        left.append(i[near]), right.append(j[near])
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        x, y = np.concatenate([i, j]), np.concatenate([j, i])
        freq = t.column("freq").combine_chunks()
        yield pa.RecordBatch.from_arrays([word.take(x), freq.take(x), word.take(y), freq.take(y)], ["word", "freq", "near", "near_freq"])


def _shared(letters: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many letters from p and from q on, by `step`, are equal; no more than `most`."""
    n = np.zeros(len(p), np.int64)
    for k in np.flatnonzero(most > LONG):
        low, high = 0, int(most[k])
        while low < high:
            mid = (low + high + 1) // 2
            x, y = (slice(s[k], s[k] + mid) if step > 0 else slice(s[k] - mid + 1, s[k] + 1) for s in (p, q))
            low, high = (mid, high) if np.array_equal(letters[x], letters[y]) else (low, mid - 1)
        n[k] = low
    rows, k = np.flatnonzero((most > 0) & (most <= LONG)), 0
    while len(rows):
        rows = rows[letters[p[rows] + step * k] == letters[q[rows] + step * k]]
        n[rows] += 1
        k += 1
        rows = rows[most[rows] > k]
    return n


# --- forms and roots -------------------------------------------------------------


def forms(words: DataFrame, near: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n_near, form, form_n for every word with a near word."""
    best = near.groupBy("word").agg(F.max("freq").alias("freq"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_freq")).alias("n"), F.col("near").alias("w"))).alias("best"))
    chosen = -F.col("best.n") >= ratio * F.col("freq")
    return best.select("word", "n_near", F.when(chosen, F.col("best.w")).alias("form"), F.when(chosen, -F.col("best.n")).alias("form_n"))


def roots(formed: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root for every word with a form: the end of the chain of forms."""
    now = scratch.save(formed.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    for _ in range(64):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = scratch.save(now.join(on, "root", "left").selectExpr("word", "coalesce(further, root) root", "further is not null moved"), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")
    raise RuntimeError("roots: chains do not end")


def variants(docs: DataFrame, scratch: Scratch, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of the dictionary."""
    words = scratch.save(dictionary(docs), "words")
    formed = scratch.save(forms(words, links(words, scratch), ratio), "formed")
    out = words.select("word", F.col("freq").alias("n")).join(formed, "word", "left").join(roots(formed, scratch), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


ORACLE = r"""
with recursive crc_table as (select list(x order by i) as t from (select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as x from range(256) r(i))),
runs as (select doc_id, run, count(*) as c from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents) group by all),
hexed as (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from runs),
hashed as (select run, c, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(x), 2), lambda i: (16 * (strpos('0123456789ABCDEF', x[i]) - 1) + strpos('0123456789ABCDEF', x[i + 1]) - 1)::bigint)),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) as h from hexed, crc_table),
edited as (select c, case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed),
words as (select word, sum(c)::bigint as n from edited where length(word) >= 5 group by word having sum(c) >= 3),
cuts as (select word, n, length(word) as l, i, left(word, i) || substr(word, i + 2) as rest from words, range(0, 100000) r(i) where i < length(word)),
near as (select distinct * from (
  select a.word, a.n, b.word as near, b.n as near_n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union all select a.word, a.n, w.word, w.n from cuts a join words w on a.rest = w.word
  union all select w.word, w.n, a.word, a.n from cuts a join words w on a.rest = w.word)),
best as (select word, any_value(n) as n, count(*) as n_near, first(near order by near_n desc, near) as form, max(near_n) as form_n from near group by word),
up as (select word, form, form_n from best where form_n >= 2 * n),
chain as (select word, form as root, 1 as step from up union all select chain.word, up.form, step + 1 from chain join up on up.word = chain.root),
ends as (select word, max_by(root, step) as root from chain group by word)
select w.word, u.form, coalesce(e.root, w.word) as root, w.n, coalesce(b.n_near, 0) as n_near, u.form_n
from words w left join best b using (word) left join up u using (word) left join ends e using (word)
"""
