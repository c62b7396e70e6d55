"""What the operators did not do to the end before: each test failed on the code before its change."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seekspark.operators import chunking, context, evaluate, expansion, lexical, nearest, postings
from seekspark.plans import embedding
from seekspark.sources import tables


def test_cells_take_many_queries(spark, monkeypatch):
    r = np.random.default_rng(6)
    v = spark.createDataFrame([(i, r.standard_normal(8).tolist()) for i in range(60)], "doc_id long, vec array<double>")
    q = v.where("doc_id % 3 = 0").selectExpr("doc_id qid", "vec")
    index = nearest.cells(v, 8)
    found = lambda: sorted(map(tuple, nearest.search_cells(index, q, 5, 3).select("qid", "doc_id", "rank").collect()))
    want = found()
    monkeypatch.setattr(nearest, "BLOCK", 7)
    assert len({x[0] for x in want}) == 20 and found() == want


def test_chunkers_take_time_in_proportion(spark):
    """A hundred thousand words in one text: before, a step copied all pieces (34 s for a third of these)."""
    docs = spark.createDataFrame([(" ".join(f"word{i}" for i in range(100_000)),)], "text string")
    began = time.time()
    got = docs.select(chunking.words(F.col("text"), 512, 60).alias("c")).first().c
    assert time.time() - began < 30
    split = [c.split() for c in got]
    assert all(len(c) + 1 <= 512 for c in got) and all(a[-6:] == b[:6] for a, b in zip(split, split[1:], strict=False))
    assert split[0] + [w for c in split[1:] for w in c[6:]] == [f"word{i}" for i in range(100_000)]


def test_texts_are_not_shuffled_to_meet_vectors(spark, tmp_path):
    """Before, a search by text joined all texts with all vectors, once for each of its uses."""
    spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for ids, n in ([1, 2, 9], 4), ([1, 1, 2], 5):
        spark.createDataFrame([(i, [1.0, float(k)]) for k, i in enumerate(ids)], "vec_id long, embedding array<double>").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        corpus = tables.hybrid_corpus(spark, str(tmp_path))
        texts = corpus.select("doc_id", "text")
        assert ("Join" in texts._jdf.queryExecution().optimizedPlan().toString()) == (n == 5)
        assert texts.count() == corpus.count() == n  # a vector that is there twice still makes two rows
        assert corpus.where("vec is not null").count() == (2 if n == 4 else 3)


def test_index_takes_tokens_once(spark):
    """Before, a pass of its own counted the lengths, so each text was tokenised twice."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(text):
        calls.add(1)
        return None if text is None else text.split()

    rows = [(i, None if i % 9 == 8 else "a b " * (i % 4) + "c") for i in range(40)]
    index = postings.build(spark.createDataFrame(rows, "doc_id long, text string"), split)
    assert calls.value == 40
    assert {r.doc_id: r.dl for r in index.lengths().collect()} == {i: None if t is None else len(t.split()) for i, t in rows}
    assert index.postings().where("n <> size(docs) or term is null").isEmpty()
    shard = [(r.term, r.block) for r in index.spark.read.parquet(index.path + "/postings").where("term is not null").collect()]
    assert shard == sorted(shard)


def test_expansion_takes_hits_that_are_found(spark, monkeypatch):
    """Before, the hits of the plain search were searched again to expand its queries."""
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i % 7} w{i % 11} x{i}") for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w9")], "qid long, text string")
    index = postings.build(docs)
    rows = lambda df: sorted(map(tuple, df.select("qid", "term", F.round("times", 9)).collect()))
    want, plain = rows(expansion.expanded(index, docs, asked)), postings.search(index, asked)
    monkeypatch.setattr(postings, "search_terms", None)
    assert rows(expansion.expanded(index, docs, asked, found=plain)) == want


def test_holders_shuffle_no_texts(spark, monkeypatch):
    """Before, the ids and words of all texts were looked through as rows, and the texts were shuffled to those that met."""
    docs = spark.createDataFrame([(i, None if i == 7 else f"one shared phrase {i % 3} stands here") for i in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a shared phrase 1 stands"), (2, "one shared phrase 1 st"), (3, "here"), (4, None)], "qid long, item string")
    few = evaluate.holders(docs, items)
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(evaluate, "MOST_ITEMS", 0)
    assert sorted(map(tuple, evaluate.holders(docs, items).collect())) == got
    assert len(got) == 99 + 299


def test_tokens_are_counted_a_few_documents_at_a_time():
    """Before, what was counted at once was a whole batch of Spark's: ten thousand documents."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000))], ["doc_id"])
    parts = [x.column(0).to_pylist() for x in lexical._slices(iter([batch]))]
    assert max(map(len, parts)) <= lexical.DOCUMENTS and sum(parts, []) == list(range(2000))


def test_model_batches_hold_few_texts():
    """Before, all texts of a batch of Spark's were Python strings at once."""
    batch = pa.RecordBatch.from_arrays([pa.array([f"h{i}" for i in range(2000)]), pa.array(["x" * 10_000] * 2000)], ["hash", "text"])
    tracemalloc.start()
    n = sum(x.num_rows for x in embedding._batches(lambda texts: [[len(t)] for t in texts], 50)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 and peak < 5e6


def test_edge_stats_find_edges_once(spark):
    """Before, the edges were found for those that leave one of the chunks, and again for those that only reach one."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def strength(i):
        calls.add(1)
        return i / 10

    edges = spark.createDataFrame([(f"c{i}", f"c{j}", "Semantic", i) for i, j in ((1, 2), (2, 1), (3, 1), (3, 4), (1, 1), (9, None))], "src string, dst string, type string, i long")
    edges = edges.select("src", "dst", "type", strength("i").alias("strength"))
    chunks = spark.createDataFrame([("c1",), ("c1",), ("c2",), (None,)], "chunk_id string")
    r = context.edge_stats(edges, chunks).first()
    assert (r.n, r.mean, r.low, r.high) == (4, pytest.approx(0.175), 0.1, 0.3) and calls.value == 6


def test_a_text_is_cut_once(spark):
    """What is cut is exploded without being cut before to see whether there is anything; texts without a piece, and long ones, as before."""
    texts = [None, "", "  ", "a b", "x" * 512, "x" * 513, *("".join(chr(97 + i % 23) for i in range(n)) for n in (16 * 448 + 64, 16 * 448 + 65, 40_000))]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for strategy, call in (("words", "split("), ("fixed", "substring(")):
        plan = chunking.chunk(docs, strategy)._jdf.queryExecution().optimizedPlan().toString()
        once = chunking.CHUNKERS[strategy](F.col("text")).alias("pieces")
        assert plan.count(call) == docs.select(once)._jdf.queryExecution().optimizedPlan().toString().count(call)
    got = {i: [] for i in range(len(texts))}
    for r in chunking.chunk(docs).orderBy("doc_id", "chunk_index").collect():
        assert r.chunk_index == len(got[r.document_id])
        got[r.document_id].append(r.content)
    for i, t in enumerate(texts):
        n = max(1, -(-(len(t or "") - 64) // 448))
        assert got[i] == ([None] if t is None else [t[448 * j : 448 * j + 512] for j in range(n)])
    assert {r.document_id for r in chunking.chunk(docs, "words").select("document_id").collect()} == set(range(3, len(texts)))
