"""Spelling variants, I-Match fingerprints and importance resampling against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from seekspark.llm import imatch, importance, variants
from seekspark.llm.byte_runs import crc_spans
from seekspark.llm.common import Scratch

DOCS = "doc_id long, text string, word string, l int, key long, bucket int, score long, n long"


def table(spark, pairs):
    """Documents with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, 1, 1, 1, 1) for i, t in pairs], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, docs=60):
    r = random.Random(seed)
    base = ["haus", "garten", "schüler", "straße", "colour", "color", "colors", "theater", "theatre", "ÀÉÎõü", "naïve", "naive", "aaaaa", "aaaaaa", "ab×cd÷e"]
    words = base + ["".join(r.choice("abé") for _ in range(r.randint(4, 7))) for _ in range(60)]
    out = [(i, " ".join(r.choices(words, [1 / (1 + k % 17) for k in range(len(words))], k=r.randint(0, 60)))) for i in range(docs)]
    long = "".join(r.choice("xyz") for _ in range(600))
    return [*out, (docs, None), (docs + 1, ""), (docs + 2, "1 2 ,."), (docs + 3, " ".join([long] * 3 + [long[:300] + long[301:]] * 3 + [long[:140] + "q" + long[141:]] * 4)), (5, out[5][1]), (None, out[7][1]), (None, None)]


# --- CRC-32 of spans ---


def test_crc_spans():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    first = np.array([0, 10, 10, 100, 0, 4999, 5000])
    last = np.array([0, 11, 74, 165, 5000, 5000, 5000])
    assert crc_spans(data, first, last).tolist() == [crc32(data[i:j].tobytes()) for i, j in zip(first, last, strict=True)]
    before = np.full(7, crc32(b"abc"), np.uint32)
    assert crc_spans(data, first, last, before).tolist() == [crc32(data[i:j].tobytes(), crc32(b"abc")) for i, j in zip(first, last, strict=True)]


# --- spelling variants ---


def near_words(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(pairs):
    n = Counter()
    for i, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if v != w and near_words(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


@pytest.mark.parametrize("small", [1, 32])
def test_variants(spark, monkeypatch, small):
    """All near pairs, whatever is subdivided: at small = 1 all blocks are, down to what cannot be."""
    monkeypatch.setattr(variants.links, "__defaults__", (small,))
    pairs = prose(3)
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in variants.variants(table(spark, pairs), Scratch(spark, "t")).collect())
    want = brute_variants(pairs)
    assert got == want
    assert sum(x[1] != "" for x in want) > 4 and any(len(x[0]) > 500 and x[4] for x in want)


def test_variants_of_one_hot_block(spark):
    """A dictionary that shares its first half: 2,000 words in one block of prefixes, which is subdivided."""
    r = random.Random(8)
    words = {"prefixes" + "".join(r.choice("abcdefgh") for _ in range(r.choice([4, 5]))) for _ in range(2000)}
    pairs = [(k, " ".join([w] * (3 + k % 9))) for k, w in enumerate(sorted(words))]
    got = {(r.word, r.near) for r in variants.links(variants.dictionary(table(spark, pairs)), Scratch(spark, "t")).collect()}
    dictionary = {x[0] for x in brute_dictionary(pairs)}
    rest = defaultdict(set)
    for w in dictionary:
        for i in range(len(w)):
            rest[i, w[:i] + w[i + 1 :]].add(w)
    want = {(a, b) for group in rest.values() for a in group for b in group if a != b}
    want |= {x for (_, cut), group in rest.items() if cut in dictionary for w in group for x in ((w, cut), (cut, w))}
    assert got == want and len(want) > 1000


def brute_dictionary(pairs):
    n = Counter()
    for i, text in pairs:
        for run in (text or "").split():
            h = crc32(f"{i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return [(w, c) for w, c in n.items() if c >= 3]


def test_variants_without_rows(spark):
    assert variants.variants(table(spark, []), Scratch(spark, "t")).count() == 0
    assert variants.variants(table(spark, [(1, None), (None, "a b c")]), Scratch(spark, "t")).count() == 0


# --- I-Match ---


def brute_edited(pairs):
    """Unique doc_ids: doc_id, characters and the edited text's hash."""
    rows = sorted(pairs, key=lambda x: (x[0] is not None, x[0] or 0))
    out = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b, k = a or "", b or "", len(a or "") // 2
        out.append((-1 if i is None else i, len(a), hashlib.sha256((a[: len(a) - k] + b[:k]).encode()).hexdigest()))
    return sorted(out)


def test_imatch_edits(spark):
    """Every document meets its next one, across all ranges; likeness tells the edited text from the next one."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgé𝄞") for _ in range(6)) for _ in range(3000)]
    pairs = [(3 * k - 700, " ".join(r.choices(words, k=r.choice([8, 60, 400])))) for k in range(500)]
    pairs += [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "word " * 300_000), (None, "no id here"), (20_000, pairs[3][1]), (20_001, pairs[3][1])]
    r.shuffle(pairs)
    got = imatch.match(table(spark, pairs), Scratch(spark, "t")).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_chars, x.edited_sha256) for x in got) == brute_edited(pairs)
    by = {x.doc_id: x for x in got}
    assert by[20_000].fingerprint == by[20_001].fingerprint == by[3 * 3 - 700].fingerprint and by[20_000].near_next == 1
    assert by[10_000].fingerprint == by[10_001].fingerprint == by[10_002].fingerprint and set(by[10_000].fingerprint) == {"0"}
    assert by[10_000].near_next == 1 and by[10_002].near_next == 0
    plain = [x for x in got if x.doc_id is not None and x.doc_id < 790 and x.n_chars > 300]
    assert np.mean([x.near_edited > x.near_next for x in plain]) > 0.9


def test_imatch_repeated_ids_and_empty_tables(spark):
    got = imatch.match(table(spark, [(1, "a b c d")]), Scratch(spark, "t")).collect()
    assert len(got) == 1 and got[0].near_next == 1
    assert got[0].edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    same = [(7, "one two three")] * 40 + [(7, "four five")] * 3 + [(None, "x")] * 5
    got = imatch.match(table(spark, same), Scratch(spark, "t"))
    assert Counter(x.doc_id for x in got.collect()) == {7: 43, None: 5}
    assert imatch.match(table(spark, []), Scratch(spark, "t")).count() == 0


def test_lexicon_is_the_band(spark):
    pairs = [(k, f"all {'third' if k % 3 == 0 else 'two'} w{k} {'rare' if k < 2 else ''}") for k in range(300)]
    got = imatch.lexicon(table(spark, pairs), Scratch(spark, "t"), 0.01, 0.35)
    assert got.tolist() == imatch.distinct_terms(pa.array(["third"]))[1].tolist()


def test_set_hashes_by_term():
    """A subset's hash depends on its terms alone, and each level halves the one before."""
    texts = pa.array(["a b c d e f", "f e d c b a a A", "a b c d e g", ""])
    prints = imatch.fingerprints(texts, np.zeros(0, np.uint64))
    assert (prints[0] == prints[1]).all() and (prints[0, :8] != prints[2, :8]).any() and not prints[3].any()
    subsets = prints[:, 8:].reshape(4, imatch.REPLICAS, imatch.LEVELS, 2).any(axis=3)
    assert not (subsets[:, :, 1:] & ~subsets[:, :, :-1]).any()


# --- importance resampling ---


def brute_resample(pairs, target):
    def feats(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]

    bucket = lambda f: crc32(f.encode()) % 10000
    docs = [(i, *feats(t)) for i, t in pairs]
    s = Counter(bucket(f) for _, _, fs in docs for f in fs)
    t = Counter(bucket(f) for x in target for f in feats(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, n, fs in docs:
        gain = [math.floor(1000 * math.log((t[bucket(f)] + 1) * (s_all + 10000) / ((s[bucket(f)] + 1) * (t_all + 10000)))) for f in fs]
        w = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), 0])
    fit = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[3], x[2]))
    for k, x in enumerate(fit[: 25 * len(fit) // 100]):
        x[5] = k + 1
    return sorted((-1 if x[0] is None else x[0], *x[2:]) for x in out)


def test_resample(spark):
    pairs = prose(5, docs=300) + [(400, "Ünï 9 x_y " * 40_000), (401, "z" * 200_000 + " q"), (401, "z" * 200_000 + " q")]
    target = ["haus garten straße 9", None, "", "colour theatre " * 30]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(table(spark, pairs), bench, Scratch(spark, "t"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_features, r.weight, r.score, r.rank or 0) for r in got.collect())
    want = brute_resample(pairs, target)
    assert got == want and sum(x[4] > 0 for x in want) > 40


def test_resample_without_rows(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(table(spark, []), none, Scratch(spark, "t")).count() == 0
    got = importance.resample(table(spark, [(1, None), (2, "a b")]), none, Scratch(spark, "t")).collect()
    assert [(r.rank, r.n_features) for r in sorted(got, key=lambda r: r.doc_id)] == [(None, 0), (None, 3)]
