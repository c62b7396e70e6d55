"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of `WINDOW` bytes of the whole text from both ends, and labels every position: a softmax over the
two hidden states at the byte. A document's probabilities are the mean over the positions of its letters (ASCII letters and
bytes of other characters). It is trained in numpy by backpropagation through time, on the driver, from windows of a sample
of labelled documents: the `SAMPLE` of them with the smallest hash of doc_id, at most `PER_DOC` windows of each. The bound
holds for any input; scoring reads all bytes of all rows.

Defined results: null text, or one without a letter: `und` with score 0. No labelled row to learn from, or an empty table: all are
`und`, or none. Texts shorter than a window are padded, and padding is no position; the longest text is windows like any other.
Languages that tie: the first by name. Repeated rows are each predicted, and alike; in the sample a row that repeats counts as often as
it occurs, within the bound. Other columns are ignored; those asked for with `keep` pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, slices, spare, utf8

WINDOW, HIDDEN, SAMPLE, PER_DOC, STEPS, BATCH = 64, 8, 2000, 6, 260, 160
_LETTER = re.compile(r"[^\W\d_]")
_IS_LETTER = np.zeros(257, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
PAD = 256


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) bytes with padding, and each window's row."""
    n = -(-np.diff(at) // WINDOW)
    row = np.repeat(np.arange(len(n)), n)
    start = at[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    place = start[:, None] + np.arange(WINDOW)
    inside = place < at[row + 1][:, None]
    out = np.full(place.shape, PAD, np.int64)
    out[inside] = data[place[inside]]
    return out, row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Weights of both directions: a row of input terms for each byte, the recurrent matrix, and the output layer."""

    def __init__(self, langs: list[str], seed: int = 5):
        r, h, k = np.random.default_rng(seed), HIDDEN, len(langs)
        self.langs = langs
        draw = lambda *n: (r.standard_normal(n) * 0.3).astype(np.float32)
        self.w = [x for _ in range(2) for x in (draw(257, 3 * h), draw(h, 3 * h))] + [draw(2 * h, k), np.zeros(k, np.float32)]

    def _run(self, x: np.ndarray, d: int, keep: bool):
        """States of one direction at every step, (WINDOW, n, HIDDEN); with `keep` also what the way back needs."""
        table, u = self.w[2 * d], self.w[2 * d + 1]
        n, h = len(x), HIDDEN
        state, out, kept = np.zeros((n, h), np.float32), np.empty((WINDOW, n, h), np.float32), []
        for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
            a, b = table[x[:, t]], state @ u
            gate = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            new = np.tanh(a[:, 2 * h :] + gate[:, :h] * b[:, 2 * h :])
            before, state = state, state + gate[:, h:] * (new - state)
            out[t] = state
            if keep:
                kept.append((t, before, gate, new, b[:, 2 * h :]))
        return out, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(WINDOW, n, languages): of every position of every window."""
        s = self._run(x, 0, False)[0] @ self.w[4][:HIDDEN] + self._run(x, 1, False)[0] @ self.w[4][HIDDEN:] + self.w[5]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        return s

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the letters of the windows, and its gradient, by backpropagation through time."""
        h = HIDDEN
        runs = [self._run(x, d, True) for d in range(2)]
        both = np.concatenate([r[0] for r in runs], axis=2)
        s = both @ self.w[4] + self.w[5]
        s -= s.max(axis=2, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=2, keepdims=True)
        real = _IS_LETTER[x].T
        total = max(int(real.sum()), 1)
        at = np.arange(len(x))
        loss = float(-np.log(p[:, at, y][real] + 1e-9).sum() / total)
        p[:, at, y] -= 1
        p *= real[:, :, None] / np.float32(total)
        g = [np.zeros_like(w) for w in self.w]
        g[4] = np.einsum("tnh,tnk->hk", both, p)
        g[5] = p.sum(axis=(0, 1))
        back = p @ self.w[4].T
        for d in range(2):
            u, later = self.w[2 * d + 1], np.zeros((len(x), h), np.float32)
            for t, before, gate, new, candidate in reversed(runs[d][1]):
                e = back[t, :, d * h : (d + 1) * h] + later
                r, z = gate[:, :h], gate[:, h:]
                dnew = e * z * (1 - new * new)
                da = np.concatenate([dnew * candidate * r * (1 - r), e * (new - before) * z * (1 - z), dnew], axis=1)
                db = np.concatenate([da[:, : 2 * h], dnew * r], axis=1)
                np.add.at(g[2 * d], x[:, t], da)
                g[2 * d + 1] += before.T @ db
                later = e * (1 - z) + db @ u.T
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 6) -> float:
        """Adam over batches with as many windows of each language."""
        r, k = np.random.default_rng(seed), len(self.langs)
        of = [np.flatnonzero(y == i) for i in range(k)]
        m, v, loss = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0.0
        for step in range(1, steps + 1):
            pick = np.concatenate([r.choice(i, max(batch // k, 1)) for i in of])
            loss, g = self.gradient(x[pick], y[pick])
            norm = float(np.sqrt(sum(float((q * q).sum()) for q in g)))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for w, q, a, b in zip(self.w, g, m, v, strict=True):
                q = q / max(norm, 1.0)
                a += 0.1 * (q - a)
                b += 0.01 * (q * q - b)
                w -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return loss

    def pooled(self, data: np.ndarray, at: np.ndarray, block: int = 4096) -> np.ndarray:
        """(rows, languages): mean probability over each row's letters; zeros where there are none."""
        x, row = windows(data, at)
        total, count = np.zeros((len(at) - 1, len(self.langs))), np.zeros(len(at) - 1)
        for i in range(0, len(x), block):
            part = x[i : i + block]
            real = _IS_LETTER[part].T
            p = np.einsum("tnk,tn->nk", self.probabilities(part), real.astype(np.float32))
            for k in range(p.shape[1]):
                total[:, k] += np.bincount(row[i : i + block], p[:, k], len(total))
            count += np.bincount(row[i : i + block], real.sum(axis=0), len(total))
        return total / np.maximum(count, 1)[:, None]

    def labels(self, text: str) -> list[str]:
        """The most probable language at every byte of one text."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        x, _ = windows(raw, np.array([0, len(raw)]))
        best = self.probabilities(x).argmax(axis=2).T.reshape(-1)[: len(raw)] if len(raw) else []
        return [self.langs[i] for i in best]


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Learns from text and lang of a bounded sample of the rows with a lang."""
    rows = labelled.where("lang is not null and text is not null")
    few = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(sample).agg(F.max("h")).first()[0]
    if few is None:
        return None
    # ids may repeat: at most `sample` rows with the least hashes, cut to windows before they come to the driver
    cut = rows.where(F.xxhash64("doc_id") <= few).select("lang", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(_cuts, "lang string, h long, cut binary")
    cut = cut.orderBy("h", "cut", "lang").limit(sample * PER_DOC).toPandas()
    langs = sorted(cut["lang"].unique())
    if not langs:
        return None
    data = np.frombuffer(b"".join(cut["cut"]), np.uint8)
    at = np.concatenate([[0], np.cumsum(cut["cut"].map(len).to_numpy())]).astype(np.int64)
    x, row = windows(data, at)
    y = np.searchsorted(np.array(langs), cut["lang"].to_numpy(str))[row]
    net = Network(langs)
    if len(langs) > 1:
        net.train(x, y)
    return net


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to PER_DOC windows of each row, at places that its key draws."""
    for b in slices(batches, "text"):
        data, at = utf8(b.column(2))
        key, lang = b.column(1).to_numpy().view(np.uint64), b.column(0).to_pylist()
        out = []
        for i, (start, stop) in enumerate(zip(at[:-1], at[1:], strict=True)):
            room = max(int(stop - start) - WINDOW, 0)
            places = sorted({int(x) % (room + 1) for x in mix(key[i] + np.arange(PER_DOC, dtype=np.uint64))})
            out += [(lang[i], int(key[i].view(np.int64)), data[start + p : min(start + p + WINDOW, stop)].tobytes()) for p in places if stop > start]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["lang", "h", "cut"])


def predict(docs: DataFrame, net: Network | None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id) with lang_pred and score for every row."""
    keep = keep or ["doc_id"]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    text = spare("text", docs.select(*keep))
    mine = docs.select(*keep, F.col("text").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            texts = b.column(b.num_columns - 1)
            letters = np.array([t is not None and bool(_LETTER.search(t)) for t in texts.to_pylist()])
            lang, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            if net and letters.any():
                p = net.pooled(*utf8(texts))
                best = p.argmax(axis=1)
                lang[letters] = np.array(net.langs, object)[best[letters]]
                score[letters] = np.clip(p[np.arange(len(p)), best], 0, 1)[letters]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return mine.mapInArrow(run, schema)


def fold(docs: DataFrame, folds: int = 3, held: int = 1):
    """True for rows of the held-out fold; a null doc_id is in none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))


def held_out_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from the other folds, predicts every row."""
    net = fit(docs.where(~fold(docs)).select("doc_id", "text", "lang"))
    return predict(docs, net).select("doc_id", fold(docs).alias("held_out"), "lang_pred", "score")
