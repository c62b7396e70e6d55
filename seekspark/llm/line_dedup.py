"""Line dedup by winnowing.

A run is a stretch of consecutive lines with at least `min_words` words; one long line can be a run. Lines are compared without
surrounding spaces, and lines that are blank then are not counted. Every line goes that belongs to a run which also occurs at an
earlier place, in order of (doc_id, text hash, line), in another text or in the same.

* Windows. At each line begins, and at each line ends, the shortest run that fits into its text. Each of these windows selects the
  line with the least hash (the leftmost of equals). A repeated run contains the same windows at both places, and they select the
  same lines at the same distances: its selected lines are guaranteed fingerprints, however short or long its lines are.
* Positions of equal fingerprints meet. A selected line that is selected once in the whole corpus ends here with all its windows.
* Matches are extended. From a position that has met others the match is extended both ways over the line hashes, as far as the
  windows around it reach, and each extension is held against the first place where the same lines stand around the same
  fingerprint. A longer repeated run is covered by those of its selected lines; lines that stand together at no earlier
  place are in no extension that is found again, even if each of their halves is.
* The lines of extensions found at an earlier place are deleted, and blank lines between two of them. Extensions are told apart by
  128 bits of their lines, so that among 10^12 of them a false match is not to be expected.

A fingerprint or run of any frequency is one row a task before it is shuffled, and the most frequent ones are joined by a
broadcast of bounded size (`common.met`).

Defined results: null text stays null, empty text stays empty. A null doc_id comes before all others. Rows equal in
doc_id and text are one place: they lose the same lines, and none because of each other. Of equal texts with unlike doc_ids all
but the first lose everything that is long enough. Texts of any length are taken whole, in batches of bounded size
by document. An empty table gives no row. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, met, mix, slices, spare, utf8, words

MIN_WORDS = 20
_KEY = "coalesce(doc_id, -9223372036854775808) pid", "xxhash64(text) tkey"
_FOUND = "pid long, tkey long, fp long, runs array<struct<start: int, stop: int, run: binary>>"
_ODD = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def lines_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-blank lines of texts: row, first byte, byte after the last (both without spaces), number of words."""
    first, last, _ = words(data, at)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    feed = np.searchsorted(np.flatnonzero(data == 10), first)
    row = np.searchsorted(at, first, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (feed[1:] != feed[:-1]) | (row[1:] != row[:-1])]))
    stop = np.append(new[1:], len(first))
    return row[new], first[new], last[stop - 1], stop - new


def windows(row: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and line after the last of the shortest runs of `least` words that begin or end at a line, inside rows."""
    total = np.concatenate([[0], np.cumsum(n)])
    i = np.arange(len(n))
    stop = np.searchsorted(total, total[:-1] + least)
    ok = stop <= np.searchsorted(row, row, "right")
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    good = start >= np.searchsorted(row, row, "left")
    # no window has more than `least` lines, as each has a word
    code = np.unique(np.concatenate([i[ok] * (least + 1) + stop[ok] - i[ok], start[good] * (least + 1) + i[good] + 1 - start[good]]))
    start = code // (least + 1)
    return start, start + code % (least + 1)


def selected(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The line with the least hash of each window, the leftmost of equals."""
    bits = np.uint64(len(h).bit_length())
    level = [(h >> bits << bits) | np.arange(len(h), dtype=np.uint64)]
    size = stop - start
    while 2 << (len(level) - 1) <= size.max(initial=0):
        half = 1 << (len(level) - 1)
        level.append(np.minimum(level[-1][:-half], level[-1][half:]))
    k = np.frexp(size.astype(np.float64))[1] - 1  # the largest power of two within the window
    out = np.zeros(len(start), np.uint64)
    for j in range(len(level)):
        at = np.flatnonzero(k == j)
        out[at] = np.minimum(level[j][start[at]], level[j][stop[at] - (1 << j)])
    return (out & np.uint64((1 << int(bits)) - 1)).astype(np.int64)


def chained(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of the lines of each window, from hashes of the lines."""
    power = np.cumprod(np.full(len(h) + 1, _ODD, np.uint64))
    inverse = np.cumprod(np.full(len(h) + 1, _INVERSE, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1])])
    return mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))


def _fingerprints(least: int):
    """A row for each selected line: its hash, and the windows that select it, as lines of its text with their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, at = utf8(b.column(2))
            row, first, last, n = lines_of(data, at)
            raw = data.tobytes()
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip(first.tolist(), last.tolist(), strict=True)), ">u8").astype(np.uint64).reshape(-1, 2)
            h = both[:, 1]
            start, stop = windows(row, n, least)
            if not len(start):
                continue
            place = selected(h, start, stop)
            order = np.argsort(place, kind="stable")
            start, stop, place = start[order], stop[order], place[order]
            each = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            line = np.searchsorted(row, row)  # the first line of each line's row
            names = np.stack([chained(mix(both[:, k]), start, stop) for k in (0, 1)], axis=1)
            names = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(16 * np.arange(len(start) + 1, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(names))])
            runs = pa.StructArray.from_arrays([pa.array((start - line[start]).astype(np.int32)), pa.array((stop - line[start]).astype(np.int32)), names], ["start", "stop", "run"])
            of = pa.array(row[place[each]])
            fp = pa.array(mix(h[place[each]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), fp, pa.ListArray.from_arrays(pa.array(np.append(each, len(place)), pa.int32()), runs)], ["pid", "tkey", "fp", "runs"])

    return run


def _without(raw: bytes | None, runs: list[dict] | None) -> tuple[bytes | None, int]:
    """The text without its repeated runs, and how many non-blank lines went."""
    if not runs:
        return raw, 0
    lines = raw.split(b"\n")
    real = [i for i, x in enumerate(lines) if x.strip()]
    out = np.zeros(len(real) + 1, np.int64)
    for r in runs:
        out[r["start"]] += 1
        out[r["stop"]] -= 1
    out = np.cumsum(out)[:-1] > 0
    gone = np.zeros(len(lines), bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
    for i, j in zip(edge[::2], edge[1::2], strict=True):
        gone[real[i] : real[j - 1] + 1] = True
    return b"\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g), int(out.sum())


def line_dedup(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of `docs`, text without the runs of lines that occur earlier, with lines_removed (int, replaced if there is one)."""
    docs = docs.drop("lines_removed")
    found = scratch.save(docs.selectExpr(*_KEY, "text").where("text is not null").mapInArrow(_fingerprints(min_words), _FOUND), "fingerprints")
    several = found.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")
    near = met(found, several, "fp", found.count()).select("pid", "tkey", F.explode("runs").alias("x")).select("pid", "tkey", "x.*")
    near = scratch.save(near, "extensions")
    first = near.groupBy("run").agg(F.min(F.struct("pid", "tkey", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = met(near, first, "run", near.count()).where(F.struct("pid", "tkey", "start") > F.col("first"))
    # rows equal in doc_id and text put each run there twice: one place
    later = scratch.save(later.groupBy("pid", "tkey").agg(F.collect_set(F.struct("start", "stop")).alias("runs")), "later")
    names, at = docs.columns, docs.columns.index("text")
    pid, tkey, runs = (spare(x, docs) for x in ("pid", "tkey", "runs"))
    plain = docs.select("*", F.coalesce("doc_id", F.lit(-(2**63))).alias(pid), F.xxhash64("text").alias(tkey))
    # a merge join at any size: a broadcast would hold only while few documents have anything to lose
    both = plain.join(later.withColumnsRenamed({"pid": pid, "tkey": tkey, "runs": runs}).hint("merge"), [pid, tkey], "left").select(*names, runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            raw = b.column(at).cast(pa.large_binary()).to_pylist()
            kept = [_without(x, r) for x, r in zip(raw, b.column(b.num_columns - 1).to_pylist(), strict=True)]
            columns = b.columns[:-1]
            columns[at] = pa.array([x for x, _ in kept], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in kept], pa.int32())], [*names, "lines_removed"])

    return both.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lines_removed", T.IntegerType())]))


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: The same rows from the definition.
ORACLE = f"""
with x as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents where text is not null),
l as (select *, len({WORDS.format("line")}) as n, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from x),
r as (select doc_id, k, n, bare, row_number() over (partition by doc_id order by k) as i, sum(n) over (partition by doc_id order by k) as upto from l where n > 0),
ends as (select a.doc_id, a.i as s, min(b.i) as e from r a join r b on a.doc_id = b.doc_id and b.i between a.i and a.i + 19 and b.upto - a.upto + a.n >= 20 group by a.doc_id, a.i
  union select b.doc_id, max(a.i), b.i from r b join r a on a.doc_id = b.doc_id and a.i between b.i - 19 and b.i and b.upto - a.upto + a.n >= 20 group by b.doc_id, b.i),
runs as (select ends.doc_id, s, e, string_agg(bare, chr(10) order by i) as run from ends join r on r.doc_id = ends.doc_id and r.i between s and e group by ends.doc_id, s, e),
again as (select doc_id, s, e from runs qualify row_number() over (partition by run order by doc_id, s) > 1),
gone as (select distinct again.doc_id, i from again join r on r.doc_id = again.doc_id and r.i between s and e),
z as (select l.doc_id, l.k, l.line, r.i, coalesce(max(r.i) over (partition by l.doc_id order by l.k), 0) as before from l left join r on r.doc_id = l.doc_id and r.k = l.k),
kept as (select z.*, a.i is not null and (z.i is not null or b.i is not null) as drop from z left join gone a on a.doc_id = z.doc_id and a.i = z.before left join gone b on b.doc_id = z.doc_id and b.i = z.before + 1),
t as (select doc_id, coalesce(string_agg(line, chr(10) order by k) filter (not drop), '') as text, count(*) filter (drop and i is not null) as lines_removed from kept group by doc_id)
select documents.doc_id, coalesce(lines_removed, 0) as lines_removed, cast(octet_length(encode(t.text)) as bigint) as n_bytes, sha256(t.text) as kept_sha256 from documents left join t on t.doc_id = documents.doc_id
"""
