"""Stored indexes: changes touch only their own segments, and results are those of the exact search."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekspark.catalog import retrieval
from seekspark.operators import codes, lexical, nearest, postings

DATA = "/root/testdata/sf0.001"


def parts(index, what):
    top = index.path.removeprefix("file:")
    return {os.path.relpath(f"{d}/{f}", top): os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(f"{top}/{what}") for f in fs if f.endswith(".parquet")}


def texts(n, seed):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    return [(i, " ".join(r.choices(words, k=r.randint(0, 80))) if i % 17 else None) for i in range(n)]


def hits(df):
    return sorted((r.qid, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())


def test_postings_are_changed_in_part(spark, monkeypatch):
    monkeypatch.setattr(postings, "SHARD", 100)
    rows = texts(600, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts(40, 2)) if t] + [(99, "w1 w1 w2 unknown"), (100, ""), (101, None)], "qid long, text string")
    index = postings.build(docs)
    assert hits(postings.search(index, asked, 10)) == hits(lexical.bm25_sparse(docs, asked, 10))
    assert hits(postings.search(index, asked, 3, group=7)) == hits(lexical.bm25_sparse(docs, asked, 3))
    before = parts(index, "postings")
    new = dict(rows) | {5: "w1 w2 w3", 700: "w2 brandnew"}
    for gone in range(0, 600, 100):
        del new[gone + 1]
    postings.remove(index, spark.createDataFrame([(i + 1,) for i in range(0, 600, 100)], "doc_id long"))
    postings.add(index, spark.createDataFrame([(5, "w1 w2 w3"), (700, "w2 brandnew")], "doc_id long, text string"))
    after = parts(index, "postings")
    assert before.items() <= after.items() and 0 < len(after) - len(before) <= 2  # no file of the first segment was written again
    want = hits(lexical.bm25_sparse(spark.createDataFrame(list(new.items()), "doc_id long, text string"), asked, 10))
    assert hits(postings.search(index, asked, 10)) == want
    merged = postings.merge(index)
    assert hits(postings.search(merged, asked, 10)) == want and merged.gone().isEmpty()
    assert hits(postings.search(index, asked, 10)) == want  # who reads the old folder sees the old state


def shuffled(spark):
    """Rows shuffled so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_postings_are_not_shuffled(spark):
    """Texts are shuffled to build an index and lists to merge; before, each posting was."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 300}" for j in range(100))) for i in range(500)], "doc_id long, text string")
    at = shuffled(spark)
    index = postings.build(docs)
    assert shuffled(spark) - at < 2000
    postings.remove(index, docs.where("doc_id % 10 = 3"))
    at = shuffled(spark)
    merged = postings.merge(index)
    assert shuffled(spark) - at < 0.5 * 500 * 100
    assert merged.postings().agg(F.sum(F.size("docs"))).first()[0] == 450 * 100


def test_postings_merge_over_shards(spark, monkeypatch):
    """Segments of one, four and eight shards become one of sixteen, and of two once most has gone."""
    monkeypatch.setattr(postings, "SHARD", 100)
    rows = texts(1500, 4)
    of = lambda a, b: spark.createDataFrame(rows[a:b], "doc_id long, text string")
    asked = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts(12, 2)) if t], "qid long, text string")
    index = postings.build(of(0, 800))
    for a, b in ((800, 850), (850, 1250), (1250, 1500)):
        postings.add(index, of(a, b))
    merged = postings.merge(index)
    assert hits(postings.search(merged, asked, 5)) == hits(lexical.bm25_sparse(of(0, 1500), asked, 5))
    postings.remove(merged, of(150, 1500).select("doc_id"))
    assert hits(postings.search(postings.merge(merged), asked, 5)) == hits(postings.search(merged, asked, 5)) == hits(lexical.bm25_sparse(of(0, 150), asked, 5))


def test_postings_skip_blocks(spark, monkeypatch):
    """Blocks that cannot reach a query's ten best are not scored: of sixteen, those that hold the rare words are."""
    import pyarrow as pa

    index = postings.build(spark.createDataFrame([(i, "common " + ("rare word " if i < 12 else "") + "x " * (i % 9)) for i in range(2000)], "doc_id long, text string"))
    rows = index.postings().where("term in ('common', 'rare', 'word')").toArrow()
    side = pa.table({"qid": [1, 1, 1], "term": ["rare", "word", "common"], "w": [5.0, 5.0, 0.01], "doc_id": pa.array([None] * 3, pa.int64())})
    scored = []
    best = postings.Best

    class Counting(best):
        def add(self, which, ids, s):
            scored.append(len(ids))
            super().add(which, ids, s)

    monkeypatch.setattr(postings, "Best", Counting)
    out = postings._shard(5.0, 10, 0.0)(rows, side)
    assert out.num_rows == 10 and max(out.column("doc_id").to_pylist()) < 12
    assert len(scored) < postings.BLOCKS


def test_vocabulary_needs_no_python(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc!"), (3, None), (4, "")], "doc_id long, text string")
    out = lexical.vocabulary(lexical.tokenized(docs))
    assert {(r.term, r.df, r.cf) for r in out.collect()} == {("aa", 1, 2), ("bb", 2, 2), ("cc", 1, 1)}
    for q in (retrieval.top_terms, retrieval.hapax_pruned):
        assert "MapInArrow" not in q(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_codes_exact_where_codes_miss(spark):
    """Vectors without clusters, one candidate a neighbour of one cell: the bounds of the cells find the rest."""
    r = np.random.default_rng(8)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(1200, 48)))] + [(9000, None), (9001, [0.0] * 48)], "doc_id long, vec array<double>")
    asked = v.where("doc_id % 40 = 0").withColumnRenamed("doc_id", "qid")
    index, want = codes.build(v.where("doc_id <> 9001")), [h[:3] for h in hits(nearest.knn(v, asked, 10))]
    assert [h[:3] for h in hits(codes.search(index, asked, 10, 1, 1))] != want
    assert [h[:3] for h in hits(codes.search(index, asked, 10, 1, 1, exact=True))] == want


def test_codes_find_and_change(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(20, 32))[r.integers(0, 20, 1500)] + 0.4 * r.normal(size=(1500, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    v = spark.createDataFrame([*rows, (9000, None), (9001, [1.0])], "doc_id long, vec array<double>")
    asked = v.where("doc_id % 20 = 0 and doc_id < 2000").withColumnRenamed("doc_id", "qid")
    index = codes.build(v)
    truth = {(a.qid, a.doc_id) for a in nearest.knn(v, asked, 10).collect()}
    found = {(a.qid, a.doc_id) for a in codes.search(index, asked, 10).collect()}
    assert len(found & truth) >= 0.94 * len(truth)
    before = parts(index, "codes") | parts(index, "vectors")
    codes.remove(index, v.where("doc_id % 20 = 3"))
    codes.add(index, spark.createDataFrame([(7, rows[8][1]), (5000, rows[9][1])], "doc_id long, vec array<double>"))
    assert before.items() <= (parts(index, "codes") | parts(index, "vectors")).items()
    now = spark.createDataFrame([(i, rows[8][1] if i == 7 else t) for i, t in rows if i % 20 != 3] + [(5000, rows[9][1])], "doc_id long, vec array<double>")
    exact = hits(nearest.knn(now, asked, 10))
    got = hits(codes.search(index, asked, 10, probes=32, depth=200))
    assert [h[:3] for h in got] == [h[:3] for h in exact]
    assert not codes.drifted(index)
    codes.add(index, spark.createDataFrame([(10_000 + i, w.tolist()) for i, w in enumerate(r.normal(size=(3000, 32)))], "doc_id long, vec array<double>"))
    assert codes.drifted(index, 1.2)
    assert codes.rebuilt(index).error > index.error


def test_codes_hold_few_tables(spark, monkeypatch):
    """A task holds the tables of ASKED queries and one cell; before, those of all queries and cells that it had met."""
    r = np.random.default_rng(9)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(400, 16)))], "doc_id long, vec array<double>")
    index = codes.build(v, centres=4)
    q = codes._unit(r.normal(size=(50, 16)))
    of = {c: np.arange(50) for c in range(4)}
    rows = index.codes().select("doc_id", "code", "cell").toArrow().combine_chunks().to_batches()
    found = lambda: next(codes._approximate(index, np.arange(50), q, of, 5)(iter(rows))).to_pylist()
    want, seen, tables = found(), [], codes._tables
    monkeypatch.setattr(codes, "_tables", lambda rest, books: seen.append(len(rest)) or tables(rest, books))
    monkeypatch.setattr(codes, "ASKED", 7)
    assert found() == want and max(seen) == 7 and sum(seen) >= 200


def test_recall_grows_with_probes(spark):
    got = [(r.probes, r.queries, r.recall) for r in retrieval.vector_index_recall(spark, DATA).collect()]
    recall = [x[2] for x in got]
    assert [x[0] for x in got[:3]] == [1, 4, 16] and recall[:3] == sorted(recall[:3]) and recall[-1] >= 0.94 and all(x[1] == 25 for x in got)


def test_visit_curve(spark):
    """The curve against visits counted one by one, with the centres that the operator takes; all cells hold everything."""
    x = np.random.default_rng(5).normal(size=(300, 6)).round(3)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 6), (902, [1.0, 2.0])]
    v = spark.createDataFrame(data, "doc_id long, vec array<double>")
    q = v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid")
    got = {(r.centres, r.probes): (r.recall, r.share) for r in nearest.visit_curve(v, q, [3, 7], 5).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = [r.doc_id for r in v.where("doc_id < 300").orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id").collect()]
    for n in (3, 7):
        c = nearest._spherical(unit[order], n)
        cell = (unit @ c.T).argmax(axis=1)
        for probes in range(1, n + 1):
            hit = read = 0
            for i in range(0, 300, 20):
                near = set(np.argsort(-(unit[i] @ c.T), kind="stable")[:probes].tolist())
                hit += sum(int(cell[j]) in near for j in np.lexsort((np.arange(300), -np.round(unit @ unit[i], 9)))[:5])
                read += sum(int(z) in near for z in cell)
            assert got[n, probes] == pytest.approx((hit / 75, read / 15 / 300))
        assert got[n, n] == (1.0, 1.0)
    assert {r.centres for r in nearest.chosen(nearest.visit_curve(v, q, [3, 7], 5)).collect()} == {3, 7}
    assert nearest.visit_curve(v.where("false"), q, [3]).count() == 0
