"""Models, mixing, chat and pieces: identities, brute force, held-out accuracy and odd cases."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from seekspark.llm import chat, lang_id, lm, mixing, quality, sample_pieces
from seekspark.llm.common import Scratch

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, twin string"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (4, "a b c"), (5, "Wörter ▁ 日本語 𝄞\n\n x  y"), (None, "the end of the the end"), (7, "ab " * 9000)]


def odd(spark, lang="en"):
    return spark.createDataFrame([(i, t, lang, s, 0, "clash", "clash") for (i, t), s in zip(ODD, ["b", "a", None, "a", "a", "", "b", "c"], strict=True)], DOCS)


# --- language model ---


def brute_kn(train, texts, order):
    """Interpolated modified Kneser-Ney over tuples."""
    counts = {n: Counter() for n in range(1, order + 1)}
    words = lambda t: [w for w in (t or "").encode().lower().split()]
    for t in train:
        s = ["<s>"] * (order - 1) + words(t) + ["</s>"]
        for i in range(order - 1, len(s)):
            counts[order][tuple(s[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        for g, c in counts[n + 1].items():  # words before it; a gram that begins a text has its plain count
            counts[n][g[1:]] += c if n > 1 and g[1] == "<s>" else 1
    plain = Counter(w for t in train for w in [*words(t), "</s>"])
    total, types = sum(plain.values()), len(plain)
    d = {n: [0, *lm._discounts(*(sum(v == k for v in counts[n].values()) for k in (1, 2, 3, 4)))] for n in counts}
    after = {n: {} for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            after[n].setdefault(g[:-1], []).append(v)

    def p(context, w):
        n = len(context) + 1
        lower = 1 / (types + 1) if n == 1 else p(context[1:], w)
        seen = after[n].get(context)
        if not seen:
            return lower
        c = counts[n][(*context, w)]
        return (max(c - d[n][min(c, 3)], 0) + sum(d[n][min(v, 3)] for v in seen) * lower) / sum(seen)

    out = []
    for t in texts:
        s = ["<s>"] * (order - 1) + words(t) + ["</s>"]
        ws = s[order - 1 :]
        base = sum(math.log10((plain[w] + 0.1) / (total + 0.1 * (types + 1))) for w in ws)
        out.append((len(ws), sum(plain[w] > 0 for w in ws), total, base, sum(math.log10(p(tuple(s[i : i + order - 1]), w)) for i, w in enumerate(ws))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney(spark, order):
    r = random.Random(order)
    texts = [" ".join(r.choice("a b c d E f g the The x1 x2 x3 x4".split()) for _ in range(r.randint(0, 40))) for _ in range(60)]
    pairs = [*enumerate(texts), *((100 + (i or 0), t) for i, t in ODD), (None, "the b c unseen1")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in pairs], "doc_id long, text string, key string")
    got = [tuple(x) for x in lm.held_out_score(docs, Scratch(spark, "t"), order).collect()]
    held = [i is not None and crc32(str(i).encode()) % 10 == 0 for i, _ in pairs]
    want = [(i, h, *x) for (i, _), h, x in zip(pairs, held, brute_kn([t for (_, t), h in zip(pairs, held, strict=True) if not h], [t for _, t in pairs], order), strict=True)]
    for a, b in zip(sorted(got, key=lambda x: (str(x[0]), x[-1])), sorted(want, key=lambda x: (str(x[0]), x[-1])), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_model_without_training_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.held_out_score(docs, Scratch(spark, "t")).collect() == []


def test_model_beats_base(spark):
    rows = lm.held_out_score(spark.read.parquet(f"{DATA}/documents.parquet"), Scratch(spark, "t")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)


# --- languages ---


def test_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = lang_id.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 40 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    net = lang_id.fit(docs)
    x = odd(spark).withColumnRenamed("lang", "l")
    got = {(r.doc_id, r.lang_pred) for r in lang_id.predict(x, net).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and len(lang_id.predict(x, net).collect()) == len(ODD)
    assert all(0 <= r.score <= 1 for r in lang_id.predict(x, net).collect())
    assert len(net.labels("the öfen")) == len("the öfen".encode())
    assert {r.lang_pred for r in lang_id.held_out_languages(odd(spark, None)).collect()} == {"und"}
    assert lang_id.held_out_languages(docs.limit(0)).collect() == []


def test_predictions_against_the_recurrence():
    """The network a byte, a unit and a language at a time, from its equations."""
    net = lang_id.Network(["a", "b", "c"], seed=9)
    texts = ["a small text", "Ünï çode 123 ...", "x" * 70 + " and then more than one window of bytes", "", "12 34"]
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = net.pooled(data, at)
    sigmoid, h = lambda v: 1 / (1 + math.exp(-v)), lang_id.HIDDEN
    for t, p in zip(texts, got, strict=True):
        raw, votes = t.encode(), []
        for s in range(0, len(raw), lang_id.WINDOW):
            window = [*raw[s : s + lang_id.WINDOW]] + [lang_id.PAD] * (lang_id.WINDOW - len(raw[s : s + lang_id.WINDOW]))
            states = [{}, {}]
            for d in range(2):
                table, u, state = net.w[2 * d], net.w[2 * d + 1], [0.0] * h
                for k in range(len(window)) if d == 0 else reversed(range(len(window))):
                    a = table[window[k]]
                    b = [sum(state[i] * u[i][j] for i in range(h)) for j in range(3 * h)]
                    reset = [sigmoid(a[j] + b[j]) for j in range(h)]
                    update = [sigmoid(a[h + j] + b[h + j]) for j in range(h)]
                    new = [math.tanh(a[2 * h + j] + reset[j] * b[2 * h + j]) for j in range(h)]
                    state = [state[j] + update[j] * (new[j] - state[j]) for j in range(h)]
                    states[d][k] = state
            for k, byte in enumerate(window):
                if byte < 256 and (chr(byte).isascii() and chr(byte).isalpha() or byte >= 128):
                    both = [*states[0][k], *states[1][k]]
                    score = [math.exp(sum(both[i] * net.w[4][i][c] for i in range(2 * h)) + net.w[5][c]) for c in range(3)]
                    votes.append([x / sum(score) for x in score])
        assert p == pytest.approx(np.mean(votes, axis=0) if votes else np.zeros(3), abs=1e-5)


def test_gradient_through_time():
    """Backpropagation agrees with differences."""
    r = np.random.default_rng(1)
    net = lang_id.Network(["a", "b", "c"])
    net.w = [w.astype(np.float64) for w in net.w]
    x, y = r.integers(60, 130, (5, lang_id.WINDOW)), np.array([0, 1, 2, 1, 0])
    _, g = net.gradient(x, y)
    for k, w in enumerate(net.w):
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        old, losses = w[at], []
        for d in (1e-3, -1e-3):
            w[at] = old + d
            losses.append(net.gradient(x, y)[0])
        w[at] = old
        assert g[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=0.02, abs=2e-5)


# --- quality ---


def test_statistics():
    texts = ["a b c a b c x", None, "", "# line\n\n# line\n  \nö b", "one", "x y\nx y\nx y", "a b c d a b c"]
    counts, x = quality.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        rep = {k + j for k, y in enumerate(g) if g.count(y) > 1 for j in range(3)}
        lines = [y for y in t.split("\n") if y.strip()]
        assert [int(counts[c][i]) for c in quality.COUNTS] == [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep)]
    assert np.isfinite(x).all()


def test_trees_are_monotonic_and_flat():
    r = np.random.default_rng(2)
    x = r.random((3000, 4)).astype(np.float32)
    y = (x[:, 0] + np.sin(6 * x[:, 1]) + r.standard_normal(3000) * 0.3 > 1).astype(float)
    t = quality.grow(x, y, falling=(1,), trees=30)
    p = t.score(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.75
    grid = np.repeat(x[:50], 40, axis=0)
    grid[:, 1] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(t.score(grid).reshape(50, 40), axis=1) <= 1e-9).all()
    free = quality.grow(x, y, falling=(), trees=30).score(grid).reshape(50, 40)
    assert (np.diff(free, axis=1) > 1e-6).any()


def test_trees_score_as_a_walk_does():
    """Each row down each tree, a node at a time, against the vectorised pass; values on thresholds, infinite and not a number too."""
    r = np.random.default_rng(4)
    x = r.integers(0, 12, (400, 3)).astype(np.float32)
    t = quality.grow(x, (x[:, 0] > x[:, 1]).astype(float), falling=(2,), trees=12, levels=4)
    x[:3] = [np.inf, -np.inf, np.nan], [0, np.nan, 1], [-1e30, 1e30, 5]
    for row, p in zip(x, t.score(x), strict=True):
        total = t.base
        for k in t.root:
            while t.left[k] != k:
                k = t.left[k] if row[t.feature[k]] <= t.threshold[k] else t.right[k]
            total += t.value[k]
        assert p == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    trees = quality.fit(docs, labels)
    rows = quality.quality(docs, trees).select("doc_id", "base_failed", "kept").join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.8
    assert len(quality.quality(odd(spark), trees).collect()) == len(ODD)
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.quality(docs.limit(0), None).collect() == []


# --- mixing ---


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * int(r.paretovariate(1.6) * 10)), "en", r.choice(["a"] * 10 + ["b", "c", "B", "é", None, ""]), 0, "", "") for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(docs, Scratch(spark, "t")).collect()
    again = mixing.mix_sources(docs.repartition(7), Scratch(spark, "t")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(t.split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, held = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in held)) / sum(weight[s] for s in names if s not in held)
        more = {s for s in names if s not in held and weight[s] * level > 3 * size[s]}
        if not more:
            break
        held |= more
    target = {s: 3 * size[s] if s in held else weight[s] * level for s in names}
    taken = Counter()
    for x in got:
        assert x.target == pytest.approx(target[x.source]) and x.source_size == size[x.source] and 0 <= x.taken <= 3 * x["size"]
        taken[x.source] += x.taken
    for s in names:
        # sizes are heavy-tailed: a source can be off by what its largest document weighs against those that wait at the root
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], max(len(t.split()) for _, t, _, x, *_ in rows if x == s))
    mixed = mixing.mixture(docs, Scratch(spark, "t")).collect()
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 3
    for s in names:
        words = sum(len(r.text.split()) for r in mixed if r.source == s)
        assert abs(words - target[s]) <= max(0.02 * target[s], max(len(t.split()) for _, t, _, x, *_ in rows if x == s))


def test_transfers_keep_expectations_and_words():
    """Over 400 seeds: every document's mean is its probability; what pairs pass on and what the root settles stays the same in words."""
    r = np.random.default_rng(1)
    size, p, seen = np.array([900.0, 400, 90, 80, 70, 60, *r.integers(1, 50, 60)]), 0.37, []
    size[::-1].sort()
    for _ in range(400):
        q = mixing._pooled(size, np.full(len(size), p), r.random(len(size)), r.random(len(size)))
        assert set(q.tolist()) <= {0.0, 1.0} and abs(q @ size - p * size.sum()) <= size[1]
        seen.append(q)
    assert np.abs(np.mean(seen, axis=0) - p).max() < 4.5 * (p * (1 - p) / 400) ** 0.5
    for a, b, c, d in r.random((200, 4)):
        x, y, u = 1 + 50 * a, 1 + 50 * b, r.random(800)
        got = [mixing._transfer(c, x, d, y, v) for v in u]
        assert all(abs(m * x + n * y - c * x - d * y) < 1e-9 and ({m, n} & {0.0, 1.0}) for m, n in got)
        m, n = np.mean(got, axis=0)
        assert abs(m - c) < 0.09 and abs(n - d) < 0.09


def test_mixture_keeps_rows_that_differ_in_any_column(spark):
    rows = [(1, "a b c", "en", "s"), (1, "a b c", "de", "s"), (1, "a b c", "de", "s"), (None, "x y", "en", None), (2, None, "en", "s"), (3, "w " * 40, "en", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'k' tkey", "1 copies", "map('a', 1) m")
    got = mixing.mixture(df, Scratch(spark, "t"), weights=(1.0,), most=1)  # all words are wanted once
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.lang, r.source) for r in got.collect() if r.text) == Counter((i, x, s) for i, t, x, s in rows if t)
    assert mixing.mixture(df.limit(0), Scratch(spark, "t")).collect() == []


def test_mixing_keeps_expectations(spark):
    """Over seeds, a document is taken as often as its rate says."""
    docs = spark.createDataFrame([(i, "w " * (5 + i % 40), "en", "ab"[i % 4 == 0], 0, "", "") for i in range(400)], DOCS)
    runs = [mixing.mix_sources(docs, Scratch(spark, "t"), seed=s).toPandas().sort_values("doc_id") for s in range(5)]
    rate = runs[0]["target"] / runs[0]["source_size"]
    mean = np.mean([r["copies"] for r in runs], axis=0)
    assert abs((mean - rate).mean()) < 0.03 and np.var(mean - rate) < 0.12


def test_mixing_odd(spark):
    got = mixing.mix_sources(odd(spark), Scratch(spark, "t")).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix_sources(odd(spark).limit(0), Scratch(spark, "t")).collect() == []
    assert {r.taken for r in mixing.mix_sources(odd(spark).where("doc_id < 4"), Scratch(spark, "t")).collect()} == {0}


# --- chat ---


def test_chat(spark):
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", "bye")
    convs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, c], 5: [a, b, c], 6: [b], 9: [(None, None), a]}
    rows = [(k, i, r, t, "clash") for k, v in convs.items() for i, (r, t) in enumerate(v)]
    rows += [(3, 0, "user", "hi", "clash"), (None, 0, "user", "nobody", "clash"), (8, None, "system", "s", "clash")]
    rows += [(50, i, "user", f"t{i}", "clash") for i in range(9000)] + [(51, i, "user", f"t{i}", "clash") for i in range(5000)]
    got = {(r.conv_id, r.part): r for r in chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string"), Scratch(spark, "t")).collect()}
    assert {k for k, _ in got} == {3, 4, 6, 8, 9, 50, None}
    assert got[3, 0].rendered == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\nbye<|end|>\n"
    assert got[9, 0].rendered.startswith("<|user|>\n<|end|>\n")
    long = "".join(got[50, p].rendered for p in range(141))
    assert long == "".join(f"<|user|>\nt{i}<|end|>\n" for i in range(9000)) and sum(got[50, p].n_turns for p in range(141)) == 9000
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_format(empty, Scratch(spark, "t")).collect() == []


# --- pieces ---


def test_pieces_of_very_long_words_and_repeated_rows(spark):
    long = "pneumono" * 40_000
    rows = [(1, long), (1, long), (2, "a" * 5000 + " " * 5000), (3, "\n" * 300), (3, "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16") * 50)]
    got = sample_pieces.encode_checked(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' pieces", "1 key")).collect()
    assert len(got) == 5 and all(r.lossless for r in got) and len({(r.n_pieces, r.pieces_crc) for r in got if r.doc_id == 1}) == 1


def test_pieces_are_lossless_and_repeatable(spark):
    docs = odd(spark).unionByName(spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text", "lang", "source", "n_chars", "'' key", "'' twin"))
    one = {(r.doc_id, r.text): r.pieces for r in sample_pieces.encode(docs).collect()}
    two = {(r.doc_id, r.text): r.pieces for r in sample_pieces.encode(docs.repartition(5)).collect()}
    assert one == two
    back = sample_pieces.decode(sample_pieces.encode(docs)).collect()
    assert sorted((r.doc_id, r.decoded or "") for r in back if r.doc_id is not None) == sorted((d, t or "") for d, t in one if d is not None for _ in range(2 if d == 4 else 1))
    assert all(r.lossless for r in sample_pieces.encode_checked(docs).collect())
    assert sample_pieces.encode_checked(docs.limit(0)).collect() == []


def test_pieces_follow_the_posterior():
    v = sample_pieces.Vocabulary(sample_pieces.MODEL)
    n, word = 30_000, " cats"

    def ways(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in v.pieces:
                i, w = v.pieces[s[:k]]
                for rest, x in ways(s[k:]):
                    yield (i, *rest), w * x

    ids, begin = sample_pieces.encode_texts([word] * n, np.arange(n), v, 3)
    got = Counter(tuple(ids[i:j].tolist()) for i, j in zip(begin[:-1], begin[1:], strict=True))
    every = dict(ways(word))
    total = sum(every.values())
    assert set(got) <= set(every)
    for way, w in every.items():
        assert got[way] / n == pytest.approx(w / total, abs=0.015)
