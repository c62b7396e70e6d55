"""Quality rules by gradient-boosted trees over document statistics.

The statistics are counted over whole texts with array operations, a few megabytes of text at a time. The trees are grown in
numpy on the driver, by histograms, from at most `SAMPLE` labelled documents (those with the least hashes of doc_id), with
a logistic loss. Features in `FALLING` are constrained: a higher share of symbols, of repeated lines or of repeated
words never raises the score. A grown ensemble is flattened to node arrays (feature, threshold, left, right, value), and
documents go down all trees at the same time, a level a step.

A document is kept if it passes the base rules and the model's probability of good quality is at least `KEEP`.

Defined results: null or empty text: all statistics are 0 and the base rules fail. Without labelled rows of both kinds the
base rules decide alone. Rows with equal doc_ids are judged by their own texts. Texts of any length are
counted whole. An empty table gives no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, hash_spans, mix, slices, utf8, words

SAMPLE, TREES, LEVELS, BINS, RATE, KEEP = 20_000, 60, 3, 32, 0.15, 0.5
_SYMBOL, _UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b".,;:!?'\"()-")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "marks", "distinct", "line_words")
FALLING = ("symbols", "dup_lines", "repeat_words")


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of COUNTS and the matrix of FEATURES, for each row."""
    data, at = utf8(column)
    n = len(at) - 1
    first, last, begin = words(data, at)
    n_words = np.diff(begin)
    of_word = np.repeat(np.arange(n), n_words)
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    whole = ~SPACE[data] & ((data & 0xC0) != 0x80)
    word_chars, symbols = _per_row(whole, at), _per_row(_SYMBOL[data], at)
    # lines with a word, by row and hash
    feed = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([at[:-1][np.diff(at) > 0], feed + 1]))
    start = np.unique(start[start < len(data)])
    stop = np.minimum(np.append(feed, len(data))[np.searchsorted(feed, start)], at[np.searchsorted(at, start, "right")]) if len(start) else start
    has = np.searchsorted(first, stop) > np.searchsorted(first, start)
    start, stop = start[has], stop[has]
    of_line = np.searchsorted(at, start, "right") - 1
    lines = np.bincount(of_line, minlength=n)
    kinds = np.unique(hash_spans(data, start, stop) ^ salt[of_line], return_index=True)[1] if len(start) else start
    dup_lines = lines - np.bincount(of_line[kinds], minlength=n)
    # words in three-word windows that their text has twice or more
    h = hash_spans(data, first, last) if len(first) else np.zeros(0, np.uint64)
    repeat = np.zeros(len(h), bool)
    if len(h) > 2:
        g = mix(mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + h[2:])
        inside = np.flatnonzero(of_word[:-2] == of_word[2:])
        _, back, count = np.unique(g[inside] ^ salt[of_word[inside]], return_inverse=True, return_counts=True)
        hit = inside[count[back] > 1]
        for k in range(3):
            repeat[hit + k] = True
    repeats = np.bincount(of_word[repeat], minlength=n)
    distinct = np.bincount(of_word[np.unique(h ^ salt[of_word], return_index=True)[1]], minlength=n) if len(h) else np.zeros(n)
    share = lambda x, y: x / np.maximum(y, 1)
    x = np.stack(
        [
            np.log1p(n_words), share(word_chars, n_words), share(symbols, word_chars), share(dup_lines, lines), share(repeats, n_words),
            share(_per_row(_UPPER[data], at), word_chars), share(_per_row(_DIGIT[data], at), word_chars), share(_per_row(_MARK[data], at), n_words), share(distinct, n_words), np.log1p(share(n_words, lines)),
        ],
        axis=1,
    )
    return dict(zip(COUNTS, (n_words, word_chars, symbols, dup_lines, repeats), strict=True)), x.astype(np.float32)


@dataclass
class Trees:
    """Nodes of all trees in one run of arrays; a leaf is its own child. root: where each tree begins."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    base: float
    levels: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row."""
        node = np.broadcast_to(self.root, (len(x), len(self.root)))
        at = np.arange(len(x))[:, None]
        for _ in range(self.levels):
            node = np.where(x[at, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...], trees: int = TREES, levels: int = LEVELS, rate: float = RATE, ridge: float = 1.0, least: int = 5) -> Trees:
    """Boosting by second-order gains over histograms; both sides of a split on a falling feature keep their order below it."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)

        def leaf(rows: np.ndarray, low: float, high: float, g=g, h=h) -> float:
            return float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))

        def split(rows: np.ndarray, depth: int, low: float, high: float, g=g, h=h) -> int:
            me = len(nodes)
            nodes.append([0, np.float32(np.inf), me, me, 0.0])
            best = (1e-6, None, None, None)
            if depth < levels and len(rows) >= 2 * least:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                    wl, wr = (np.clip(v, low, high) for v in (-gl / (hl + ridge), -(gs - gl) / (hs - hl + ridge)))
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    if f in falling:
                        gain[wl < wr] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k, (wl[k] + wr[k]) / 2)
            if best[1] is None:
                nodes[me][4] = rate * leaf(rows, low, high)
                total[rows] += nodes[me][4]
                return me
            _, f, k, middle = best
            down = binned[rows, f] <= k
            bounds = ((middle, high), (low, middle)) if f in falling else ((low, high), (low, high))
            nodes[me][:4] = f, edges[f][k], split(rows[down], depth + 1, *bounds[0]), split(rows[~down], depth + 1, *bounds[1])
            return me

        roots.append(split(np.arange(len(y)), 0, -4.0, 4.0))
    f, t, left, right, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(f.astype(np.int64), t.astype(np.float32), left, right, v.astype(np.float64), np.array(roots), base, levels)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Learns quality (0 or 1) from the texts of a bounded sample of the labelled documents."""
    h = F.xxhash64("doc_id")
    few = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("__id"), "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    few = few.groupBy("__id").agg(F.min("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            _, x = statistics(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    # `few` has at most `sample` rows, so it is safe to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("__id")).select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x binary")
    got = rows.orderBy(h, "doc_id", "x").limit(sample).toPandas()
    if got["quality"].nunique() < 2:
        return None
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1)
    return grow(x, got["quality"].to_numpy(np.float64), tuple(FEATURES.index(f) for f in FALLING))


def quality(docs: DataFrame, trees: Trees | None, keep: float = KEEP) -> DataFrame:
    """doc_id, the counts, base_failed, quality (probability), kept."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, quality double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            counts, x = statistics(b.column(1))
            failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            p = trees.score(x) if trees else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(~failed & (p >= keep)), pa.array(p)], ["doc_id", *COUNTS, "base_failed", "kept", "quality"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
