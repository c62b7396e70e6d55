"""The pipeline's stages on the smallest documents, each judged on its own input."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import duckdb
from seekspark.llm import line_dedup
from seekspark.llm.common import Scratch

from .test_dedup import brute_near

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch = Scratch(spark, "t")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.save(stage(spark, docs, DATA), name)
        results[name] = docs, out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    # languages: only documents without a sure language go
    before, after = results["language_id"]
    assert len(ids(after)) >= 0.97 * len(ids(before))
    # lines: texts only get shorter, n_chars follows
    before, after = results["line_dedup"]
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert len(r.text) <= len(old[r.doc_id]) and r.n_chars == len(r.text)
    # near-duplicates at 0.8: exactly the smallest of each group stays, once
    before, after = results["near_dedup"]
    assert ids(after) == {d for d, _, _, kept in brute_near([(r.doc_id, r.text) for r in before.collect()], 80) if kept}
    assert after.count() == len(ids(after))
    # mixing: at most three of each, all copies alike
    before, after = results["mixing"]
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= 3
    assert after.select("doc_id", "text").subtract(before.select("doc_id", "text")).count() == 0
    # pieces: every row, without loss
    before, after = results["pieces"]
    assert before.count() == after.count() == after.where("lossless").count()


def test_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and columns with the names that stages use inside."""
    words = [f"word{k}" for k in range(400)]
    text = lambda s: " ".join(random.Random(s).choices(words, k=60))
    rows = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(20)]
    rows += [rows[3], rows[3], (3, text(3), "de", "s9", 1), (None, text(50), None, None, None), (None, text(50), None, None, None), (21, None, "en", "s", 0), (22, "", None, "s", 0)]
    rows += [(23, " \n ", "en", None, 0), (24, "long " * 50_000 + text(60), "en", "s0", 1), (25, f"{text(61)}\n{text(0)}", "en", "s0", 1), (26, "1234 5678", "en", "s0", 1)]
    names = "row text2 pid tkey runs did dkey whole copies copy lines_removed".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"'{n}' {n}" for n in names if n != "lines_removed"))
    scratch = Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.save(stage(spark, docs, DATA), name)
        if name == "language_id":  # all rows with a letter; whether one is sure is not at stake here
            assert out.columns == docs.columns and out.where("text is null or trim(text) = ''").count() == 0
            out = docs.where("doc_id is null or doc_id < 21 or doc_id in (24, 25)")
        if name == "line_dedup":
            assert out.columns == docs.columns and out.count() == 27
            assert out.where("doc_id = 25").first().text == text(61) and out.where("doc_id = 25").first().n_chars == len(text(61))
        if name == "near_dedup":
            assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([*range(20), 24, 25, None], key=str)
        if name == "mixing":
            assert out.columns == docs.columns and out.subtract(docs).count() == 0
        if name == "pieces":
            assert out.count() == docs.count() and out.where("not lossless").count() == 0
        docs = out


def test_no_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    scratch = Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, DATA), name)
        assert docs.count() == 0


def test_lines_and_mixing_by_brute_force(spark):
    """The line stage against SQL from the definition, the mix against the targets by a plain loop."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = corpus_pipeline.lines(spark, docs, DATA).collect()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = {d: (n, h) for d, n, _, h in con.sql(f"select doc_id, lines_removed, n_bytes, kept_sha256 from ({line_dedup.ORACLE})").fetchall()}
    texts = {d: t for d, t in con.sql("select doc_id, text from documents").fetchall()}
    for r in got:
        assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][1]
    gone = set(texts) - {r.doc_id for r in got}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(want[d][0] > 0 for d in gone) and all(want[d][1] != empty or not texts[d] for d in {r.doc_id for r in got})
    sizes = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    whole = Counter()
    for source, n in sizes.values():
        whole[source] += n
    names = sorted((s for s in whole if s is not None)) + [None] * (None in whole)
    weight, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, sum(whole.values())
    while True:  # what is above three times its source is reshared by weight
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in target) for s in names if s not in target}
        over = [s for s in share if share[s] > 3 * whole[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * whole[s]
            left -= target[s]
    taken = Counter()
    for r in corpus_pipeline.mixed(spark, docs, DATA).collect():
        taken[r.source] += sizes[r.doc_id][1]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(n for x, n in sizes.values() if x == s)
