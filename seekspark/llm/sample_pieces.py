"""Sampled SentencePiece segmentation: forward filtering and backward sampling over the lattice of pieces.

A text is cut to units: a line feed, or a run of spaces and the run of other characters after it. In the vocabularies
this reads, spaces begin a piece or are a piece of spaces and a line feed is in no longer piece (both are verified), so no
piece spans two units and the lattice of a text is the chain of its units' lattices. Forward weights are computed once for
each distinct unit of a slice of rows, for all units at the same time, a place a step; segmentations are then drawn backwards,
all units at the same time, a piece a step, from the exact posterior of the lattice.

The weight of a piece is exp(theta * log p) with p(piece) proportional to 1 / (1 + its rank in the vocabulary), as the
files of BPE models hold ranks and no probabilities. A character that is no piece is spelled in byte pieces of weight
1 / (1 + number of pieces) for each byte; so is a literal U+2581, which otherwise stands for a space. Random numbers come
from a counter hashed with the row's key, so a row gets the same pieces whatever the batch, task or attempt.

Decoding joins the pieces' bytes, and gives back exactly the text.

Defined results: null or empty text: no pieces. Texts of any length are taken whole, in bounded batches of rows; one text is the
unit of memory. Repeated rows equal in doc_id and text get the same pieces, a row each. An empty table gives no row. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_spans, mix, slices

_SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Vocabulary:
    """Pieces with their weights, and all beginnings of pieces as sorted hashes."""

    def __init__(self, model: str, theta: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        rank = iter(range(n))
        self.bytes = np.full(256, -1, np.int32)
        self.surface: list[bytes] = [b""] * n
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.bytes[value], self.surface[i] = i, bytes([value])
                continue
            piece = sp.id_to_piece(i)
            text = piece.replace(_SPACE, " ")
            if not re.fullmatch(r" *[^ \n]*|\n", text):
                raise ValueError(f"the piece {piece!r} has a space inside: units of this vocabulary are not independent")
            self.pieces[text] = (i, (1.0 + next(rank)) ** -theta)
            self.surface[i] = text.encode()
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary lacks byte pieces: some texts could not be encoded without loss")
        self.log_byte = -theta * math.log(1.0 + n)
        known: dict[int, tuple[int, float]] = {}
        for text, (i, w) in self.pieces.items():
            h = 0
            for c in text:
                h = _step(h, ord(c))
                known.setdefault(h, (-1, 0.0))
            if known[h][0] >= 0:
                raise ValueError("two pieces have one hash")
            known[h] = i, math.log(w)
        self.heads = np.array(sorted(known), np.uint64)
        self.piece = np.array([known[int(h)][0] for h in self.heads], np.int64)
        self.log_weight = np.array([known[int(h)][1] for h in self.heads])
        self.bucket = np.searchsorted(self.heads >> np.uint64(64 - _BITS), np.arange((1 << _BITS) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are beginnings of pieces, and their places; few share a bucket."""
        b = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        k, stop = self.bucket[b], self.bucket[b + 1]
        found = (k < stop) & (self.heads[np.minimum(k, len(self.heads) - 1)] == h)
        open_ = np.flatnonzero(~found & (k + 1 < stop))
        while len(open_):
            k[open_] += 1
            hit = self.heads[k[open_]] == h[open_]
            found[open_[hit]] = True
            open_ = open_[~hit]
            open_ = open_[k[open_] + 1 < stop[open_]]
        return found, np.minimum(k, len(self.heads) - 1)


_MUL, _WORD, _BITS = 0x9E3779B97F4A7C15, (1 << 64) - 1, 20


def _step(h: int, c: int) -> int:
    h = ((h ^ (c + 1)) * _MUL) & _WORD
    return h ^ (h >> 29)


def _steps(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ (c.astype(np.uint64) + np.uint64(1))) * np.uint64(_MUL)
    return h ^ (h >> np.uint64(29))


class Lattice:
    """The lattices of some units, given as code points and first places (one more at the end).

    A state is a place in a unit, from 0 to its length; a unit's states follow each other. Arcs are sorted by the state they end
    in: `cum` is that state plus the share of the arcs up to this one of its forward weight, `piece` an id or - 1 - code point of
    a spelled character, `back` the state it begins in.
    """

    def __init__(self, v: Vocabulary, points: np.ndarray, at: np.ndarray):
        unit = np.repeat(np.arange(len(at) - 1), np.diff(at))
        state = np.arange(len(points)) + unit  # of each character: the state before it
        stop = at[1:][unit]
        live, h, size = np.arange(len(points)), np.zeros(len(points), np.uint64), 0
        alone = np.zeros(len(points), bool)  # characters that are no piece
        begin, end, piece, weight = [], [], [], []
        while len(live):
            h = _steps(h, points[live + size])
            size += 1
            found, k = v.find(h)
            got = found & (v.piece[k] >= 0)
            if size == 1:
                alone[live[~got]] = True
            begin.append(state[live[got]]), end.append(state[live[got]] + size), piece.append(v.piece[k[got]]), weight.append(v.log_weight[k[got]])
            on = found & (live + size < stop[live])
            live, h = live[on], h[on]
        spelled = np.flatnonzero(alone)
        c = points[spelled].astype(np.int64)
        begin.append(state[spelled]), end.append(state[spelled] + 1), piece.append(-1 - c), weight.append(v.log_byte * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
        begin, end, piece, weight = map(np.concatenate, (begin, end, piece, weight))
        offset = end - (at[:-1] + np.arange(len(at) - 1))[_unit_of(begin, at)]
        order = np.argsort(offset * (len(points) + len(at)) + end, kind="stable")
        begin, end, piece, weight, offset = (x[order] for x in (begin, end, piece, weight, offset))
        scale = np.zeros(len(points) + len(at) - 1)
        share = np.empty(len(begin))
        cuts = np.searchsorted(offset, np.arange(1, int(offset[-1]) + 2)) if len(offset) else [0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):  # all states at one distance from their unit's begin
            if i == j:
                continue
            e = end[i:j]
            heads = np.flatnonzero(np.diff(e, prepend=-1))
            n = np.diff(np.append(heads, j - i))
            x = weight[i:j] + scale[begin[i:j]]
            top = np.maximum.reduceat(x, heads)
            x = np.exp(x - np.repeat(top, n))
            total = np.add.reduceat(x, heads)
            scale[e[heads]] = top + np.log(total)
            up = np.cumsum(x)
            share[i:j] = (up - np.repeat(up[heads] - x[heads], n)) / np.repeat(total, n)
        last = np.diff(end, append=-1) != 0
        share = np.minimum(share, 1.0)
        share[last] = 1.0
        order = np.argsort(end, kind="stable")
        self.cum, self.piece, self.back = (end + share)[order], piece[order], begin[order]
        self.arcs = np.searchsorted(end[order], np.arange(len(scale) + 1))  # of each state: its first arc
        self.last = at[1:] + np.arange(len(at) - 1)  # of each unit: the state of its end
        self.first = np.zeros(len(scale) + 1, bool)
        self.first[at[:-1] + np.arange(len(at) - 1)] = True


    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The arc into each state that u (0 to 1) falls to, by bisection among the state's own."""
        low, high, x = self.arcs[state], self.arcs[state + 1] - 1, state + u * (1 - 2.0**-20)
        while (low < high).any():
            middle = (low + high) >> 1
            up = self.cum[middle] <= x
            low, high = np.where(up, middle + 1, low), np.where(up, high, middle)
        return low


def _unit_of(state: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The unit of each state."""
    return np.searchsorted(at[:-1] + np.arange(len(at) - 1), state, "right") - 1


def unit_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First places of the units of texts (code points one after another, first places with one more at the end)."""
    n = len(points)
    start = np.zeros(n + 1, bool)
    start[at] = True
    feed, space = points == 10, points == 32
    start[:n] |= feed
    start[1:n] |= feed[:-1]
    start[1:n] |= space[1:] & ~space[:-1]
    return np.flatnonzero(start[:n])


def encode_texts(texts: list[str | None], keys: np.ndarray, v: Vocabulary, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' piece ids one after another, and where each row begins (one more at the end)."""
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])]).astype(np.int64)
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    start = unit_starts(points, at)
    stop = np.append(start[1:], len(points))
    _, one, unit = np.unique(hash_spans(points.view(np.uint8), 4 * start, 4 * stop), return_index=True, return_inverse=True)
    size = (stop - start)[one]
    own = np.concatenate([[0], np.cumsum(size)])
    lattice = Lattice(v, points[np.arange(own[-1]) + np.repeat(start[one] - own[:-1], size)], own)
    row = np.searchsorted(at, start, "right") - 1
    place = np.arange(len(start)) - np.searchsorted(start, at[:-1])[row]
    counter = mix(mix(keys.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & _WORD))[row] + place.astype(np.uint64))
    state = lattice.last[unit]
    live, who, got = np.arange(len(state)), [], []
    while len(live):
        u = (mix(counter[live] + np.uint64(len(who) * 0xD1342543DE82EF95 & _WORD)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        arc = lattice.draw(state[live], u)
        who.append(live), got.append(lattice.piece[arc])
        state[live] = lattice.back[arc]
        live = live[~lattice.first[state[live]]]
    # a unit's pieces came last first, one a step: each goes as many places before its unit's end
    size = np.zeros(len(start), np.int64)
    for x in who:
        size[x] += 1
    end = np.cumsum(size)
    ids = np.empty(end[-1], np.int64)
    for k, (x, y) in enumerate(zip(who, got, strict=True)):
        ids[end[x] - 1 - k] = y
    of = np.repeat(row, size)
    width = np.ones(len(ids), np.int64)
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        c = -1 - ids[odd]
        width[odd] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        begin = np.cumsum(width) - width
        out = np.zeros(int(width.sum()), np.int32)
        plain = ids >= 0
        out[begin[plain]] = ids[plain]
        kinds, kind = np.unique(c, return_inverse=True)
        for k, x in enumerate(kinds.tolist()):
            spelled = v.bytes[np.frombuffer(chr(x).encode("utf-8", "surrogatepass"), np.uint8)]
            for j, y in enumerate(spelled):
                out[begin[odd[kind == k]] + j] = y
        ids = out
    return ids.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(of, width, len(texts)))]).astype(np.int64)


_HELD: dict[tuple, Vocabulary] = {}


def _vocabulary(model: str, theta: float) -> Vocabulary:
    if (model, theta) not in _HELD:
        _HELD[model, theta] = Vocabulary(model, theta)
    return _HELD[model, theta]


def encode(docs: DataFrame, model: str = MODEL, theta: float = 1.0, seed: int = 7) -> DataFrame:
    """doc_id, text, pieces (ids) for every row; the row's key is doc_id with a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(model, theta)
        for b in slices(batches, "text", most=2 << 20):
            ids, begin = encode_texts(b.column(1).to_pylist(), b.column(2).to_numpy(), v, seed)
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["doc_id", "text", "pieces"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(run, "doc_id long, text string, pieces array<int>")


def decode_ids(ids: np.ndarray, surface: list[bytes]) -> bytes:
    return b"".join(map(surface.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, decoded: the text that the pieces spell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = _vocabulary(model, 1.0).surface
        for b in batches:
            texts = [None if x is None else b"".join(map(surface.__getitem__, x)).decode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, decoded string")


def encode_checked(docs: DataFrame, model: str = MODEL, theta: float = 1.0, seed: int = 7) -> DataFrame:
    """doc_id, n_pieces, pieces_crc (of the ids as little-endian 32-bit integers), lossless (decoding gives the text back)."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(model, theta)
        for b in slices(batches, "text", most=2 << 20):
            texts = b.column(1).to_pylist()
            ids, begin = encode_texts(texts, b.column(2).to_numpy(), v, seed)
            surface = v.surface
            crc, same = [], []
            for t, i, j in zip(texts, begin[:-1], begin[1:], strict=True):
                crc.append(zlib.crc32(ids[i:j].astype("<i4").tobytes()))
                same.append(decode_ids(ids[i:j], surface) == (t or "").encode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(begin)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "pieces_crc", "lossless"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(run, "doc_id long, n_pieces long, pieces_crc long, lossless boolean")
