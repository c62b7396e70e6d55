"""Removal of repeated 50-byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of `SPAN` bytes covers it that also starts in a document with a smaller doc_id. Finding these is
divided among tasks by content: every SPAN-byte string selects one gram of its own (a minimizer), so equal strings select
equal grams, and the stretch of a text whose strings select the same gram goes to the gram's part as one piece. Grams of
a single document are dropped there, and equal pieces become one class with their smallest doc_id. Where a gram has more
than one class, the classes' texts are fetched and compared:

* A class is read as symbols of `SYMBOL` bytes, one at each place, in `SYMBOL` interleaved cyclic strings that step by
  whole symbols; SPAN bytes are then `DEPTH` symbols.
* Classes are dealt to shards, and each shard's suffixes are sorted to its Burrows-Wheeler transform.
* The shards' transforms are merged by interleave refinement: an interleave of the shards that is right for k symbols
  becomes right for k + 1 by one stable pass over the merged transform, and the pass that first tells two neighbours apart
  gives their common prefix. No suffix of one shard is compared with one of another.
* After DEPTH passes the intervals that have not been told apart are the repeated strings; each gets its smallest doc_id.

A class's strings with a smaller doc_id elsewhere are marked in all members of the class, marks are joined by document and
cut out. Pieces travel as packed arrays, a row for each slice of documents and part; places are compressed, hashes cannot be.

Defined results: null text: empty. A null doc_id is neither smaller nor larger than another: nothing is removed for or from
such a row. Rows with equal doc_ids remove nothing from one another. Texts of
any length are taken whole: pieces of a long one go to many parts. An empty table gives no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, least, mix, pack, slices, squeezed, unpack, unsqueezed, utf8

SPAN, GRAM, SYMBOL, CHUNK, SHARDS, PACKED, MEMBERS = 50, 20, 10, 1024, 4, 16 << 20, 32_768
#: Grams that divide the classes of one gram where these are more than CHUNK, and bytes of their texts that are divided at a time.
LONGER, SLICE = (32, 44, SPAN), 1 << 20
DEPTH = SPAN // SYMBOL
_T = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = np.uint64(0xD1342543DE82EF95)


def anchors(data: np.ndarray, at: np.ndarray, gram: int = GRAM, bits: int = 0) -> tuple[np.ndarray, ...]:
    """Runs of SPAN-byte strings inside rows that select the same `gram` bytes: first and last start, place and hash of the gram.

    Of each string the gram with the least hash is selected, the leftmost of equals, so equal strings select equal grams at
    equal distances. Places take `bits` bits of the comparison, as many as the data need if none are given.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, none.view(np.uint64)
    if gram == GRAM:
        padded = np.zeros(n + 16, np.uint8)
        padded[:n] = data
        eight = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
        h = eight[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) ^ eight[8 : n - GRAM + 9] * np.uint64(0xC2B2AE3D27D4EB4F)
        h = mix(h ^ eight[GRAM - 8 : n - 7] * np.uint64(0xD6E8FEB86659FD93))
    else:
        begin = np.arange(n - gram + 1)
        h = span_hashes(data, begin, begin + gram)
    bits = np.uint64(bits or n.bit_length())
    m = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    width, want = 1, SPAN - gram + 1
    while width < want:
        step = min(width, want - width)
        m = np.minimum(m[:-step], m[step:])
        width += step
    place = (m & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    bad = np.zeros(n + 1, np.int32)
    inner = np.unique(at[1:-1])
    np.add.at(bad, np.maximum(inner - SPAN + 1, 0), 1)
    np.add.at(bad, inner, -1)
    good = np.cumsum(bad)[: len(place)] == 0
    place[~good] = -1
    cut = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate([[0], cut])
    last = np.append(cut, len(place)) - 1
    keep = place[first] >= 0
    first, last = first[keep], last[keep]
    place = place[first]
    return first, last, place, h[place]


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from sums over the whole."""
    power = np.cumprod(np.full(len(data) + 1, _ODD, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_T[data] * power[:-1])])
    inverse = np.cumprod(np.full(len(data) + 1, np.uint64(pow(int(_ODD), -1, 1 << 64)), np.uint64))
    return mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))


# --- pieces by part ------------------------------------------------------------


def _pieces(parts: int):
    """Of some megabytes of documents at a time, a row for each part: its pieces, in order of document and place."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        pid, tkey, row, start, run, h, text = map(np.concatenate, zip(*held, strict=True))
        h = mix(h)  # selected grams have small hashes, which would all fall to the first parts
        part = ((h >> np.uint64(40)).astype(np.int64) * parts >> 24).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        blobs = []
        for p in np.flatnonzero(np.diff(cuts)):
            i = order[cuts[p] : cuts[p + 1]]
            docs, count = np.unique(row[i], return_counts=True)
            step = np.diff(start[i], prepend=0)
            heads = np.cumsum(count) - count
            step[heads] = start[i][heads]
            blobs.append((int(p), squeezed(pid[docs], tkey[docs], least(count), step.astype(np.uint8), least(step >> 8), run[i]) + pack(h[i].astype(np.uint32), text[i])))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], ["part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs = [], 0, 0
        for b in slices(batches, "text", most=1 << 20):
            data, at = utf8(b.column(2))
            first, last, _, h = anchors(data, at)
            row = np.searchsorted(at, first, "right") - 1
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), row + docs, first - at[row], (last - first).astype(np.uint8), h, span_hashes(data, first, last + SPAN)))
            docs += b.num_rows
            size += len(data)
            if size >= PACKED:
                yield packed(held)
                held, size, docs = [], 0, 0
        if held:
            yield packed(held)

    return run


_FOUND = "kind int, part int, pid long, tkey long, data binary"


def _found_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "part", "pid", "tkey", "data"])


def _classes(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Kind 0: the part's repeated pieces by class. Kind 1: what texts of a document are wanted, for classes to be compared."""
    part = int(key[0])
    pid, tkey, doc, start, run, gram, text = ([] for _ in range(7))
    docs = 0
    for blob in frame["data"]:
        (p, t, count, low, high, length), rest = unsqueezed(blob)
        k, x = unpack(rest)
        step = low.astype(np.int64) | high.astype(np.int64) << 8
        d = np.repeat(np.arange(len(p)), count)
        total = np.cumsum(step)
        heads = np.cumsum(count.astype(np.int64)) - count
        pid.append(p), tkey.append(t), doc.append(d + docs), run.append(length), gram.append(k), text.append(x)
        start.append(total - (total[heads] - step[heads])[d])
        docs += len(p)
    pid, tkey, doc, start, run, gram, text = map(np.concatenate, (pid, tkey, doc, start, run, gram, text))
    order = np.argsort(gram, kind="stable")
    new = np.flatnonzero(np.diff(gram[order], prepend=np.uint32(~gram[order[0]])))
    low, high = np.minimum.reduceat(doc[order], new), np.maximum.reduceat(doc[order], new)
    order = order[np.repeat(low != high, np.diff(np.append(new, len(order))))]
    if not len(order):
        return _found_frame([])
    doc, start, run, gram, text = (x[order] for x in (doc, start, run, gram, text))
    # classes in order of gram
    order = np.lexsort((text, gram))
    doc, start, run, gram, text = (x[order] for x in (doc, start, run, gram, text))
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])])
    cls, at = np.cumsum(new) - 1, np.flatnonzero(new)
    smallest = np.minimum.reduceat(pid[doc], at)
    of_gram = gram[at]
    several = np.repeat((n := np.unique(of_gram, return_counts=True)[1]) > 1, n)
    used, doc = np.unique(doc, return_inverse=True)
    pid, tkey = pid[used], tkey[used]
    rows = [(0, part, 0, 0, pack(pid, tkey, least(doc), least(start), run, least(cls), of_gram, smallest, several.astype(np.uint8)))]
    want = at[several]
    order = np.argsort(doc[want], kind="stable")
    want = want[order]
    cuts = np.append(np.flatnonzero(np.diff(doc[want], prepend=-1)), len(want))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        w = want[i:j]
        rows.append((1, part, pid[doc[w[0]]], tkey[doc[w[0]]], pack(least(start[w]), run[w], least(cls[w]))))
    return _found_frame(rows)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents and what is wanted of them: the classes' texts, a row for each part and slice. Kind 2."""
    for b in slices(batches, "text", most=4 << 20):
        out: dict[int, list] = {}
        for raw, wanted in zip(b.column(0).cast(pa.large_binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in wanted:
                start, run, cls = unpack(w["data"])
                got = out.setdefault(w["part"], [])
                got += [(c, raw[s : s + r + SPAN]) for c, s, r in zip(cls.tolist(), start.tolist(), run.tolist(), strict=True)]
        rows = [(p, pack(least(np.array([c for c, _ in got])), np.frombuffer(b"".join(x for _, x in got), np.uint8))) for p, got in out.items()]
        yield pa.RecordBatch.from_arrays([pa.array([2] * len(rows), pa.int32()), pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["kind", "part", "data"])


# --- transforms ----------------------------------------------------------------


def _transform(symbol: np.ndarray, after: np.ndarray, before: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places `mine` (one shard) sorted by their next DEPTH symbols, and the symbol before each."""
    keys, at = [], mine
    for _ in range(DEPTH):
        keys.append(symbol[at])
        at = after[at]
    order = np.arange(len(mine))
    for k in reversed(keys):
        order = order[np.argsort(k[order], kind="stable")]
    return mine[order], symbol[before[mine[order]]]


def _merge(sorted_: list[np.ndarray], transforms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All places, shard by shard in their own order, and the interval of each: equal where the next DEPTH symbols are."""
    source = np.repeat(np.arange(len(sorted_), dtype=np.uint8), [len(x) for x in sorted_])
    whole = np.concatenate(transforms)
    block = np.zeros(len(whole), np.int64)
    merged = np.empty_like(whole)
    for _ in range(DEPTH):
        merged[np.argsort(source, kind="stable")] = whole  # the t-th place that the interleave gives a shard is its t-th suffix
        order = np.argsort(merged, kind="stable")
        source, symbol, old = source[order], merged[order], block[order]
        block = np.cumsum(np.concatenate([[False], (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])]))
    return np.concatenate(sorted_), block[np.argsort(source, kind="stable")]


def repeated_strings(data: np.ndarray, at: np.ndarray, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings data[at[i]:at[i+1]]: starts of SPAN-byte substrings, and the number of each one's content."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    eight = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    size, owner = np.diff(at), np.repeat(np.arange(len(at) - 1), np.diff(at))
    offset = np.arange(n) - at[owner]
    places = np.flatnonzero(offset + SYMBOL <= size[owner])
    x = mix(eight[places] * np.uint64(0x9E3779B97F4A7C15) ^ eight[places + 2] * np.uint64(0xC2B2AE3D27D4EB4F))
    kinds, rank = np.unique(x, return_inverse=True)
    # every string has an end of its own, symbol 0, for each of its interleaved strings; strings are cyclic
    lanes = np.minimum(size - SYMBOL + 1, SYMBOL).clip(0)
    ends = len(places) + np.cumsum(lanes) - lanes
    m = len(places) + int(lanes.sum())
    symbol = np.zeros(m, np.uint16 if len(kinds) < 65535 else np.uint32)
    symbol[: len(places)] = rank + 1
    number = np.zeros(n, np.int64)
    number[places] = np.arange(len(places))
    who, off = owner[places], offset[places]
    after, before = np.empty(m, np.int64), np.empty(m, np.int64)
    final, initial = off + 2 * SYMBOL > size[who], off < SYMBOL
    end = ends[who] + off % SYMBOL
    k = np.arange(len(places))
    after[: len(places)] = np.where(final, end, number[np.minimum(places + SYMBOL, n - 1)])
    before[: len(places)] = np.where(initial, end, number[np.maximum(places - SYMBOL, 0)])
    before[end[final]], after[end[initial]] = k[final], k[initial]
    shard = np.concatenate([who, np.repeat(np.arange(len(size)), lanes)]) * shards // max(len(size), 1)
    each = [np.flatnonzero(shard == s) for s in range(shards)]
    built = [_transform(symbol, after, before, x) for x in each if len(x)]
    if not built:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, block = _merge([x for x, _ in built], [y for _, y in built])
    full = np.zeros(m, bool)
    full[: len(places)] = off + SPAN <= size[who]
    keep = full[where]
    return places[where[keep]], block[keep]


def _taken(raw: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts raw[at:at + length] one after the other, and where each begins (one more at the end)."""
    begin = np.concatenate([[0], np.cumsum(length)])
    return raw[np.arange(begin[-1]) - np.repeat(begin[:-1] - at, length)], begin


def _compare(raw: np.ndarray, at: np.ndarray, length: np.ndarray, gram: np.ndarray, low: np.ndarray, value: np.ndarray, window: np.ndarray, longer: tuple[int, ...] = LONGER) -> None:
    """Of texts raw[at:at + length] in order of their grams: for each SPAN-byte string the smallest `low` of the gram's texts that
    hold it, into `value` from the text's `window` on.

    Whole grams of up to CHUNK texts are compared together. A gram that has more is divided by longer grams, so what is compared
    at a time is bounded however often a gram occurs.
    """
    new = np.append(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])), len(gram))
    i = 0
    while i < len(gram):
        k = np.searchsorted(new, i + CHUNK, "right") - 1
        j = int(new[k])
        if j <= i:
            j = int(new[k + 1])
            if longer:
                _divide(raw, at[i:j], length[i:j], low[i:j], value, window[i:j], longer)
                i = j
                continue
        data, begin = _taken(raw, at[i:j], length[i:j])
        places, content = repeated_strings(data, begin)
        who = np.searchsorted(begin, places, "right") - 1
        least_ = np.full(int(content.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least_, content, low[i:j][who])
        value[window[i:j][who] + places - begin[who]] = least_[content]
        i = j


def _divide(raw: np.ndarray, at: np.ndarray, length: np.ndarray, low: np.ndarray, value: np.ndarray, window: np.ndarray, longer: tuple[int, ...]) -> None:
    """`_compare` of the texts of one gram: by grams of longer[0] bytes they become pieces, and equal pieces one class again."""
    part = np.cumsum(length) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(at)]
    pieces = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        data, begin = _taken(raw, at[i:j], length[i:j])
        first, last, _, h = anchors(data, begin, longer[0], bits=24)  # the same for all slices, so that equal strings select equal grams
        who = np.searchsorted(begin, first, "right") - 1
        off = first - begin[who]
        pieces.append((at[i:j][who] + off, last - first, window[i:j][who] + off, low[i:j][who], h, span_hashes(data, first, last + SPAN)))
    start, run, to, low, h, text = map(np.concatenate, zip(*pieces, strict=True))
    order = np.lexsort((text, h))
    start, run, to, low, h, text = (x[order] for x in (start, run, to, low, h, text))
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
    cls, one = np.cumsum(new) - 1, np.flatnonzero(new)
    least_ = np.minimum.reduceat(low, one)
    size = run[one] + 1
    own = np.concatenate([[0], np.cumsum(size)])
    found = np.repeat(least_, size)
    many = np.repeat((n := np.unique(h[one], return_counts=True)[1]) > 1, n)
    if many.any():
        _compare(raw, start[one][many], size[many] + SPAN - 1, h[one][many], least_[many], found, own[:-1][many], longer[1:])
    for i in range(0, len(cls), MEMBERS):
        c, n = cls[i : i + MEMBERS], size[cls[i : i + MEMBERS]]
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        value[np.repeat(to[i : i + MEMBERS], n) + j] = found[np.repeat(own[c], n) + j]


def _marks(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Of a part's classes and their texts: the stretches of documents that begin with strings of smaller doc_ids, a row for each
    bucket of documents."""
    hits = frame.loc[frame["kind"] == 0, "data"]
    if not len(hits):
        return pd.DataFrame({"bucket": [], "data": []})
    pid, tkey, doc, start, run, cls, gram, smallest, several = unpack(hits.iloc[0])
    doc, cls, start = doc.astype(np.int64), cls.astype(np.int64), start.astype(np.int64)
    size = np.zeros(len(gram), np.int64)
    size[cls] = run.astype(np.int64) + 1
    window = np.concatenate([[0], np.cumsum(size)])  # of each class: its strings
    value = np.repeat(smallest, size)
    got, raw = [], []
    for blob in frame.loc[frame["kind"] == 2, "data"]:
        c, x = unpack(blob)
        got.append(c.astype(np.int64)), raw.append(x)
    if got:
        got, raw = np.concatenate(got), np.concatenate(raw)
        length = size[got] + SPAN - 1
        at = np.cumsum(length) - length
        order = np.argsort(got)  # classes are numbered by gram
        got, at, length = got[order], at[order], length[order]
        _compare(raw, at, length, gram[got], smallest[got], value, window[got])
    found = []
    for i in range(0, len(cls), MEMBERS):
        c, d = cls[i : i + MEMBERS], doc[i : i + MEMBERS]
        count = size[c]
        member = np.repeat(np.arange(len(c)), count)
        j = np.arange(len(member)) - np.repeat(np.cumsum(count) - count, count)
        hit = value[window[c][member] + j] < pid[d][member]
        # runs of marked strings, by member
        first = np.flatnonzero(hit & ((j == 0) | ~np.concatenate([[False], hit[:-1]])))
        last = np.flatnonzero(hit & ((j == count[member] - 1) | ~np.append(hit[1:], False)))
        at = start[i : i + MEMBERS]
        found.append((d[member[first]], at[member[first]] + j[first], at[member[last]] + j[last] + SPAN))
    of, begin, stop = map(np.concatenate, zip(*found, strict=True))
    bucket = (mix(pid.view(np.uint64) ^ mix(tkey.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)[of]
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)):
        o = order[cuts[b] : cuts[b + 1]]
        rows.append((int(b), pack(pid[of[o]], tkey[of[o]], least(begin[o]), least(stop[o]))))
    return pd.DataFrame(rows, columns=["bucket", "data"])


def _by_document(key, frame: pd.DataFrame) -> pd.DataFrame:
    """A row for each document of a bucket: all its marks."""
    pid, tkey, begin, stop = (np.concatenate(c) for c in zip(*map(unpack, frame["data"]), strict=True))
    order = np.lexsort((tkey, pid))
    pid, tkey, begin, stop = (x[order] for x in (pid, tkey, begin, stop))
    new = np.flatnonzero(np.concatenate([[True], (pid[1:] != pid[:-1]) | (tkey[1:] != tkey[:-1])]))
    cuts = np.append(new, len(pid))
    return pd.DataFrame({"pid": pid[new], "tkey": tkey[new], "marks": [pack(least(begin[i:j]), least(stop[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]})


def covered(marks: bytes | None) -> list[tuple[int, int]]:
    """The maximal stretches that the marks cover."""
    if not marks:
        return []
    begin, stop = (x.astype(np.int64) for x in unpack(marks))
    order = np.argsort(begin, kind="stable")
    begin, stop = begin[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > stop[:-1]]))
    return list(zip(begin[new].tolist(), stop[np.append(new[1:], len(begin)) - 1].tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        out = []
        for raw, marks in zip(b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw, spans = raw or b"", covered(marks)
            at, kept = 0, []
            for i, j in spans:
                kept.append(raw[at:i])
                at = j
            kept.append(raw[at:])
            out.append((len(raw), sum(j - i for i, j in spans), spans, b"".join(kept)))
        spans = pa.array([[{"first": i, "last": j} for i, j in x[2]] for x in out], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)), spans, pa.array([x[3] for x in out], pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def cut_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (first byte, byte after the last), kept (bytes) for every row of `docs`."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    named = keyed.where("doc_id is not null and text is not null").withColumnRenamed("doc_id", "pid")
    pieces = named.select("pid", "tkey", "text").mapInArrow(_pieces(parts), "part int, data binary")
    found = scratch.save(pieces.groupBy("part").applyInPandas(_classes, _FOUND), "classes")
    wanted = found.where("kind = 1").groupBy("pid", "tkey").agg(F.collect_list(F.struct("part", "data")).alias("wanted"))
    texts = named.join(wanted, ["pid", "tkey"]).select("text", "wanted").mapInArrow(_texts, "kind int, part int, data binary")
    texts = scratch.save(texts, "texts")  # so that the shuffle of whole texts is gone before that of the pieces
    pieces = found.where("kind = 0").select("kind", "part", "data").unionByName(texts)
    marks = pieces.groupBy("part").applyInPandas(lambda key, frame: _marks(frame, parts), "bucket int, data binary")
    marks = scratch.save(marks.groupBy("bucket").applyInPandas(_by_document, "pid long, tkey long, marks binary"), "marks")
    both = keyed.join(marks, (keyed.doc_id == marks.pid) & (keyed.tkey == marks.tkey), "left").select("doc_id", "text", "marks")
    return both.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<first: long, last: long>>, kept binary")


def remove_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `docs`."""
    out = cut_repeats(docs, scratch)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows from the definition.
ORACLE = """
with d as (select doc_id, coalesce(hex(encode(text)), '') as h, coalesce(octet_length(encode(text)), 0) as n from documents),
k as (select doc_id, n, j, substr(h, 2000 * j + 1, 2098) as part from (select *, unnest(range(n // 1000 + 1)) as j from d)),
g as (select doc_id, 1000 * j + i as i, substr(part, 2 * i + 1, 100) as g from (select *, unnest(range(least(1000, greatest(0, n - 49 - 1000 * j)))) as i from k)),
low as (select g, min(doc_id) as low from g group by g having min(doc_id) <> max(doc_id)),
hit as (select doc_id, i from g join low using (g) where low < doc_id),
run as (select doc_id, i, sum(cast(coalesce(i - before > 50, true) as int)) over (partition by doc_id order by i) as run from (select *, lag(i) over (partition by doc_id order by i) as before from hit)),
span as (select doc_id, run, min(i) as s, max(i) + 50 as e from run group by doc_id, run),
cut as (select span.doc_id, s, e, substr(h, 2 * coalesce(lag(e) over w, 0) + 1, 2 * (s - coalesce(lag(e) over w, 0))) as kept from span join d using (doc_id) window w as (partition by span.doc_id order by s)),
out as (select doc_id, sum(e - s) as n_removed, count(*) as n_spans, string_agg(kept, '' order by s) as kept, max(e) as last from cut group by doc_id)
select d.doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) as kept_sha256
from d left join out on d.doc_id = out.doc_id
"""
