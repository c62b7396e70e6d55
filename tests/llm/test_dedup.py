"""Line dedup, near-duplicates, near vectors and repeated strings against brute force, with every odd case."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from seekspark.llm import ego_join, line_dedup, near_dedup, suffix_dedup
from seekspark.llm.common import Scratch, components, utf8

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cid string, part string"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash") for i, t in pairs], DOCS)


def corpus(seed=1, n=120):
    """Texts with exact and near copies, shared passages, repeated lines, ties, nulls, empty and long texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(400)]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [line(30) for _ in range(3)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.15:
            rows.append(r.choice(rows))
        elif rows and kind < 0.4:
            words = r.choice(rows).split(" ")
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = "changed"
            rows.append(" ".join(words))
        else:
            rows.append("\n".join([line(r.randint(0, 30)) for _ in range(r.randint(1, 6))] + r.sample(shared, r.randint(0, 2))))
    pairs = [(7 * i % 211, t) for i, t in enumerate(rows)]
    return [*pairs, (1000, None), (1001, ""), (1002, " \n\t "), (1003, "Äpfel"), (1004, "x" * 30_000), (1005, "x" * 30_000), (1006, "One two"), (1007, "one  TWO"), (5, rows[3]), (None, rows[5]), (None, rows[5]), pairs[0], pairs[0]]


def brute_near(pairs, percent=85):
    sets = []
    for _, t in pairs:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset())
    at = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = at[i], at[j]
                at = [a if x == b else x for x in at]
    out = []
    for i, (d, _) in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if at[j] == at[i] and pairs[j][0] is not None]
        low = (min(ids) if ids else None) if sets[i] else d
        out.append((d, len(sets[i]), low, d == low))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    pairs = corpus()
    got = near_dedup.near_duplicates(docs_of(spark, pairs), Scratch(spark, "t"), percent)
    assert rows_of(got.select("doc_id", "n_shingles", "component_id", "kept")) == brute_near(pairs, percent)


def test_near_duplicates_in_a_crowd(spark):
    """More near copies of one text than the window holds: found by the wide pass."""
    r = random.Random(3)
    base = [f"w{r.randrange(10_000)}" for _ in range(150)]
    pairs = []
    for i in range(150):
        words = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 5, 9])):
            words[r.randrange(len(words))] = f"v{r.randrange(1000)}"
        pairs.append((i, " ".join(words)))
    got = near_dedup.near_duplicates(docs_of(spark, pairs), Scratch(spark, "t"), percent=85)
    assert rows_of(got.select("doc_id", "n_shingles", "component_id", "kept")) == brute_near(pairs)


@pytest.mark.parametrize("operator", [near_dedup.near_duplicates, suffix_dedup.remove_repeats, line_dedup.line_dedup])
def test_no_rows(spark, operator):
    assert operator(docs_of(spark, []), Scratch(spark, "t")).collect() == []


def brute_repeats(pairs):
    low = {}
    for d, t in pairs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                low[b[i : i + 50]] = min(d, low.get(b[i : i + 50], d))
    out = []
    for d, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and low[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeated_strings(spark):
    pairs = corpus(2)
    assert rows_of(suffix_dedup.remove_repeats(docs_of(spark, pairs), Scratch(spark, "t"))) == brute_repeats(pairs)


def test_frequent_gram_is_compared_in_bounded_groups(monkeypatch):
    """A line that stands in many unlike surroundings: no comparison takes more than CHUNK texts, and the marks are those of the definition."""
    r = random.Random(6)
    line = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    common, some = line(61), [line(25) for _ in range(5)]
    texts = [r.choice(some) + line(r.randint(0, 40)) + common[: r.choice([40, 61])] + line(r.randint(0, 40)) + r.choice(some) for _ in range(1500)]
    ids = np.random.default_rng(1).permutation(len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(range(len(texts))), pa.array(texts)], ["pid", "tkey", "text"])
    blobs = [b for out in suffix_dedup._pieces(1)(iter([batch])) for b in out.column(1).to_pylist()]
    found = suffix_dedup._classes((0,), suffix_dedup.pd.DataFrame({"data": blobs}))
    wanted = [[{"part": 0, "data": b} for b in found.loc[(found["kind"] == 1) & (found["tkey"] == i), "data"]] for i in range(len(texts))]
    both = pa.RecordBatch.from_arrays([batch.column(2), pa.array(wanted)], ["text", "wanted"])
    pieces = suffix_dedup.pd.concat([found[found["kind"] == 0], *(b.to_pandas() for b in suffix_dedup._texts(iter([both])))])
    groups, plain = [], suffix_dedup.repeated_strings
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    monkeypatch.setattr(suffix_dedup, "SLICE", 5000, raising=False)
    monkeypatch.setattr(suffix_dedup, "repeated_strings", lambda data, at: groups.append(len(at) - 1) or plain(data, at))
    marks = suffix_dedup._by_document(0, suffix_dedup._marks(pieces, 1))
    assert len(groups) > 5 and max(groups) <= 64
    got = dict(zip(marks["tkey"], map(suffix_dedup.covered, marks["marks"]), strict=True))
    want = {i: x for (i, x) in enumerate(brute_spans(list(zip(ids.tolist(), texts, strict=True)))) if x}
    assert len(want) > 700 and got == want


def brute_spans(pairs):
    low = {}
    for d, t in pairs:
        for i in range(len(t) - 49):
            low[t[i : i + 50]] = min(d, low.get(t[i : i + 50], d))
    out = []
    for d, t in pairs:
        spans = []
        for i in range(len(t) - 49):
            if low[t[i : i + 50]] < d:
                if spans and spans[-1][1] >= i:
                    spans[-1] = (spans[-1][0], i + 50)
                else:
                    spans.append((i, i + 50))
        out.append(spans)
    return out


def test_pieces_take_few_bytes():
    """Twelve bytes of hashes for a piece, and no more than three beside them, also in a long text dealt to many parts."""
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in [150_000, *[2000] * 100]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(101)), pa.array(range(101)), pa.array(texts)], ["pid", "tkey", "text"])
    blobs = [b for out in suffix_dedup._pieces(8)(iter([batch])) for b in out.column(1).to_pylist()]
    n = sum(len(suffix_dedup.anchors(*utf8(pa.array([t])))[0]) for t in texts)
    assert sum(map(len, blobs)) < 15 * n


def test_texts_of_classes_are_kept_apart(spark):
    """The shuffle of whole texts ends with a table, before the pieces meet: both never lie on disk at once."""
    scratch = Scratch(spark, "t")
    suffix_dedup.cut_repeats(docs_of(spark, corpus(2)), scratch)
    assert scratch.made == 3


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merged_transforms(shards):
    """Intervals of the merged transform are exactly the equal substrings, for any number of shards."""
    r = random.Random(shards)
    base = bytes(r.choice(b"ab") for _ in range(90))
    texts = [base[a : a + r.randint(40, 70)] for a in (0, 3, 3, 10, 11, 30)] + [bytes(r.choice(b"abc") for _ in range(66)) for _ in range(5)] + [b"", b"a" * 70]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    places, content = suffix_dedup.repeated_strings(data, at, shards)
    want = [p for i, t in enumerate(texts) for p in range(at[i], at[i] + len(t) - 49)]
    assert sorted(places.tolist()) == want
    strings = [data[p : p + 50].tobytes() for p in places]
    assert len(set(zip(strings, content.tolist(), strict=True))) == len(set(strings)) == len(set(content.tolist()))


def brute_lines(pairs, least=20):
    """From the definition: of each text, which non-blank lines belong to a run of `least` words that occurs at an earlier place."""
    lines = [[x.encode().strip() for x in (t or "").split("\n") if x.encode().strip()] for _, t in pairs]
    place = lambda i, a: (-(2**63) if pairs[i][0] is None else pairs[i][0], a)
    runs = [(i, a, b) for i, x in enumerate(lines) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if sum(len(y.split()) for y in x[a:b]) >= least]
    first = {}
    for i, a, b in runs:
        key = tuple(lines[i][a:b])
        first[key] = min(first.get(key, place(i, a)), place(i, a))
    gone = [[False] * len(x) for x in lines]
    for i, a, b in runs:
        if first[tuple(lines[i][a:b])] < place(i, a):
            gone[i][a:b] = [True] * (b - a)
    return gone


def without_lines(text, gone):
    """The text without the lines, and without blank lines between two of them that follow each other."""
    if text is None:
        return None
    lines = text.split("\n")
    real = [k for k, x in enumerate(lines) if x.encode().strip()]
    drop = {k for k, g in zip(real, gone, strict=True) if g}
    for n, (i, j) in enumerate(zip(real, real[1:])):  # noqa: B905
        if gone[n] and gone[n + 1]:
            drop |= set(range(i, j))
    return "\n".join(x for k, x in enumerate(lines) if k not in drop)


def short_lines(seed):
    """Texts whose lines have 1 to 25 words, of a few lines in all orders, so that runs overlap in every way."""
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdefgh") for _ in range(r.choice([1, 2, 3, 5, 8, 10, 19, 20, 25]))) for _ in range(9)]
    return [(i, "\n".join(r.choice([*pool, "", " "]) for _ in range(r.randint(0, 14)))) for i in range(40)]


@pytest.mark.parametrize("seed", [4, 5])
def test_line_dedup(spark, seed):
    # one text for each id: the order of texts under one id is that of hashes
    pairs = [p for p in corpus(seed) if p[0] not in (5, None)] + [(2000 + i, t) for i, t in short_lines(seed)] + [(None, "a " * 30), (3000, "a " * 30)]
    got = line_dedup.line_dedup(docs_of(spark, pairs), Scratch(spark, "t"))
    assert got.columns == [*(c.split()[0] for c in DOCS.split(", ")), "lines_removed"]
    gone = brute_lines(pairs)
    want = [(d, without_lines(t, g), sum(g)) for (d, t), g in zip(pairs, gone, strict=True)]
    assert sum(w[2] for w in want) > 100
    assert rows_of(got.select("doc_id", "text", "lines_removed")) == sorted(want, key=str)


def test_lines_that_stand_together_nowhere_earlier(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    pairs = [(1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (3, f"{a}\nx\n{b}\ny\n{c}")]
    assert {r.lines_removed for r in line_dedup.line_dedup(docs_of(spark, pairs), Scratch(spark, "t")).collect()} == {0}
    a, b, c = (" ".join(f"{x}{k}" for k in range(8)) for x in "abc")
    pairs = [(1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (3, f"{a}\n{b}\n{c}"), (4, f"{a}\n\n{b}\n{c}")]
    got = {r.doc_id: r.lines_removed for r in line_dedup.line_dedup(docs_of(spark, pairs), Scratch(spark, "t")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 3}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, "a", "b", 1, 2) for i, t in corpus(6, 30)], "doc_id long, text string, pid string, tkey string, runs int, dkey int")
    assert line_dedup.line_dedup(df, Scratch(spark, "t")).columns == [*df.columns, "lines_removed"]
    once = near_dedup.one_each(df, Scratch(spark, "t"))
    assert once.columns == df.columns and once.count() < df.count()


def test_one_of_each_component(spark):
    """Repeated rows, one id with several texts, null ids: exactly one row of each component stays."""
    text = " ".join(f"w{k}" for k in range(60))
    close = text.replace("w59", "other")
    rows = [(3, text, "x"), (3, text, "y"), (3, text, "y"), (None, close, "x"), (None, close, "x"), (5, "alone here", "x"), (5, text, "z"), (6, None, "x"), (6, None, "x"), (7, "", "x"), (None, "only null", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tkey string")
    got = near_dedup.one_each(df, Scratch(spark, "t")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(3, text), (5, "alone here"), (6, None), (6, None), (7, ""), (None, "only null")], key=str)


def test_near_vectors(spark):
    r = np.random.default_rng(4)
    centres = r.standard_normal((12, 16))
    rows = []
    for i in range(700):
        v = centres[r.integers(12)] + r.standard_normal(16) * r.choice([0.05, 0.2, 0.35, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(3)) if i % 50 else None))
    rows += [(700 + k, rows[3][1], rows[3][2]) for k in range(30)] + [(800, [0.0] * 16, 1), (801, None, 1), (802, [], 1), (803, [1.0, None], 1), (804, [float("nan")] * 16, 1), (805, [1.0, 2.0], 1), (806, [2.0, 4.0], 1), (807, [float("inf")] + [0.0] * 15, 1), (810, [3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'clash' key")
    got = rows_of(ego_join.near_vectors(df, Scratch(spark, "t")))
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) and label is not None for _, v, label in rows]
    links = {i: [] for i, _, _ in rows}
    for a, (i, v, x) in enumerate(rows):
        for b, (j, w, y) in enumerate(rows):
            if a != b and ok[a] and ok[b] and x == y and len(v) == len(w):
                p, q = np.array(v), np.array(w)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.93:
                    links[i].append(j)
    low = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low[i] = min(seen)
    assert got == sorted(((i, len(links[i]), low[i], low[i] == i) for i in links), key=str)
    assert ego_join.near_vectors(df.limit(0), Scratch(spark, "t")).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}
