"""Plans with state of their own: embedding with a cache, stored tables, jobs, files, SQL functions."""

import os
import time

import pytest
from pyspark.sql import functions as F

from seekspark.functions import sql
from seekspark.operators import chunking, evaluate, nearest
from seekspark.plans import embedding, ingest, jobs
from seekspark.sources import buckets, web
from seekspark.sources.shared import place


def files_of(path):
    top = path.removeprefix("file:")
    return {os.path.relpath(f"{d}/{f}", top) for d, _, fs in os.walk(top) for f in fs if f.endswith(".parquet")}


def test_embedding_calls_the_model_for_new_texts_only(spark):
    calls, texts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def model(batch):
        calls.add(1)
        texts.add(len(batch))
        if "bad" in batch:
            raise ValueError("bad text")
        return [[float(len(t)), 1.0] for t in batch]

    first = spark.createDataFrame([(i, f"text {i % 120}") for i in range(300)] + [(900, None), (901, "  ")], "id long, content string").coalesce(1)
    rows, cache, rejects = embedding.embed(first, model, "2024-01-01 00:00:00")
    assert (calls.value, texts.value) == (3, 120) and rejects.isEmpty() and cache.count() == 120  # 50, 50 and 20
    assert {r.id: r.vec for r in rows.collect()} == {i: [float(len(f"text {i % 120}")), 1.0] for i in range(300)} | {900: None, 901: None}
    more = first.unionByName(spark.createDataFrame([(1000, "new"), (1001, "bad"), (1002, "newer")], first.schema)).coalesce(1)
    rows, state, rejects = embedding.embed(more, model, "2024-01-01 12:00:00", cache)
    assert texts.value == 120 + 3 + 3 and [r.error for r in rejects.collect()] == ["bad text"] and state.count() == 122  # the failed batch again, text by text
    assert {r.id for r in rows.where("vec is null").collect()} == {900, 901, 1001} and rows.where("not cached").count() == 2
    embedding.embed(first, model, "2024-01-02 06:00:00", state)  # the first ones are too old
    assert texts.value == 126 + 120


def test_stored_table_rewrites_what_is_touched(spark):
    path = place(spark, "table")
    rows = spark.range(2000).select(F.col("id"), F.concat(F.lit("v"), "id").alias("v"))
    buckets.create(rows, path, "id", 16)
    before = files_of(path)
    buckets.upsert(spark, path, spark.createDataFrame([(7, "seven"), (5000, "new")], "id long, v string"), "id", 16)
    after = files_of(path)
    assert len(before) == 16 and len(before & after) >= 14
    got = {r.id: r.v for r in buckets.read(spark, path).collect()}
    assert got == {i: f"v{i}" for i in range(2000)} | {7: "seven", 5000: "new"}
    whole = buckets.bucketed(rows, "id", 16).where("bucket = 3").select("id")
    buckets.delete(spark, path, whole.unionByName(spark.createDataFrame([(7,)], "id long")), "id", 16)
    left = {r.id for r in buckets.read(spark, path).collect()}
    assert left == set(range(2000)) - {7} - {r.id for r in whole.collect()} | ({5000} - {r.id for r in buckets.bucketed(spark.createDataFrame([(5000,)], "id long"), "id", 16).where("bucket = 3").collect()})


@pytest.fixture
def running(spark):
    return jobs.Jobs(spark)


def test_jobs_complete_fail_and_are_cancelled(spark, running):
    path = place(spark, "job")
    good = running.submit("good", lambda: spark.range(1000).repartition(5).write.parquet(path))
    bad = running.submit("bad", lambda: spark.range(10).select(F.raise_error(F.lit("no such luck"))).collect())
    assert running.wait(good, 60) == "Completed" and running.wait(bad, 60) == "Failed"
    assert running.progress(good)["done"] >= 5 and spark.read.parquet(path).count() == 1000
    assert running.progress(bad)["error"]

    def slow():
        def wait(rows):
            for b in rows:
                time.sleep(120)
                yield b

        spark.range(0, 8, 1, 8).mapInArrow(wait, "id long").count()

    long = running.submit("long", slow)
    end = time.time() + 60
    while not running.progress(long)["active"] and time.time() < end:
        time.sleep(0.2)
    assert running.progress(long)["active"] > 0 and running.cancel(long)
    assert running.wait(long, 60) == "Cancelled" and not running.cancel(long)
    assert {r.name: r.state for r in running.table().collect()} == {"good": "Completed", "bad": "Failed", "long": "Cancelled"}


def test_golden_names(spark, tmp_path):
    items = spark.createDataFrame([(1, "a", ["x", "y"]), (2, None, [])], "item_id long, query_text string, relevant_ids array<string>")
    evaluate.save_golden(items, str(tmp_path / "g"), each=10)
    text = "".join(open(tmp_path / "g" / f).read() for f in os.listdir(tmp_path / "g") if f.startswith("part"))
    assert text.startswith("[{") and all(x in text for x in ("itemId", "queryText", "relevantIds", "updatedAt"))
    assert sorted((r.item_id, r.query_text, r.relevant_ids) for r in evaluate.load_golden(spark, str(tmp_path / "g")).collect()) == [(1, "a", ["x", "y"]), (2, None, [])]


def test_files_and_their_rejects(spark, tmp_path):
    for name, data in (("a.txt", "ä" * 1000), ("b.MD", "short"), ("c.bin", "x"), ("e.txt", " \n")):
        (tmp_path / name).write_text(data)
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe")
    chunks, rejects = web.parsed_files(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content"))
    assert sorted((r.path[-5:], r.reason) for r in rejects.collect()) == [("c.bin", "extension"), ("d.txt", "encoding"), ("e.txt", "empty")]
    got = sorted((r.metadata["source_file"], int(r.metadata["ff_chunk_index"]), int(r.metadata["ff_start_char"]), int(r.metadata["ff_end_char"]), len(r.content)) for r in chunks.collect())
    assert got == [("a.txt", 0, 0, 512, 512), ("a.txt", 1, 448, 960, 512), ("a.txt", 2, 896, 1000, 104), ("b.MD", 0, 0, 5, 5)]


def test_sql_functions_are_inlined(spark):
    """What the session runs is the body: no Python, no call."""
    sql.register(spark)
    df = spark.sql("select sparse_tokens(s) t, jaccard_words(s, 'a b') j, bm25_part(2, 10, 12, 3, 100) b, quality(100, 6, 0.5, 0.5, true) q from values ('A bc, d efg') v(s)")
    r = df.first()
    assert r.t == ["bc", "efg"] and r.j == pytest.approx(0.2) and r.q == pytest.approx(66.5) and r.b > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_chunkers_equal_the_columns(spark):
    """Odd texts too; keep and size vary, and a text is longer than several blocks of the inner fold."""
    sql.register(spark)
    long = ". ".join(f"w{i % 97} " * (i % 13) + "End" for i in range(900))
    texts = [None, "", "  ", "one", "x" * 900, "a b\n \nc. D e\n\nf", long]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    c = F.col("text")
    for size, overlap in ((40, 0), (64, 35), (512, 64), (1, 10)):
        want = docs.select("i", chunking.words(c, size, overlap).alias("w"), chunking.sentences(c, size).alias("s"), chunking.paragraphs(c, size, overlap).alias("p")).orderBy("i").collect()
        got = spark.sql(f"select i, word_chunks(text, {size}, {overlap}) w, sentence_chunks(text, {size}) s, paragraph_chunks(text, {size}, {overlap}) p from {{docs}} order by i", docs=docs)
        assert got.collect() == want and want[0].w is None and want[1].w == [] and len(want[6].w) > 20
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_sql_fusion_of_partitions(spark):
    """Ties go to the smaller id, null weights count nothing, rows without a document or rank are left out; queries do not mix."""
    sql.register(spark)
    rows = [(q, d, r, w) for q in range(40) for r, d in enumerate(range(q, q + 30), 1) for w in (0.7, 0.3)] + [(99, 1, 1, None), (99, None, 1, 1.0), (99, 2, None, 1.0), (98, None, 1, 1.0)]
    arms = spark.createDataFrame(rows, "qid long, doc_id long, rank int, weight double").repartition(5)
    ask = "select * from fused(table({arms}) partition by (qid), 7)"
    got = {(r.qid, r["rank"]): (r.doc_id, round(r.score, 9)) for r in spark.sql(ask, arms=arms).collect()}
    assert got == {(q, r): (q + r - 1, round(1 / (60 + r), 9)) for q in range(40) for r in range(1, 8)} | {(99, 1): (1, 0.0)}
    tied = spark.createDataFrame([(1, d, 3, 1.0) for d in (9, 4, 6)], arms.schema)
    assert [r.doc_id for r in spark.sql(ask, arms=tied).orderBy("rank").collect()] == [4, 6, 9]
    assert spark.sql(ask, arms=arms.limit(0)).collect() == []


def test_sql_terms_stay_in_their_row(spark):
    """Counts of odd texts; the plan is a generator, without a join or shuffle of texts."""
    sql.register(spark)
    docs = spark.createDataFrame([(1, "b a, a c' aa AA bb aa"), (2, None), (3, ""), (4, "zz zz"), (5, "zz zz")], "i int, text string")
    df = spark.sql("select i, x.term, x.tf from {docs} join lateral terms_of(text) x", docs=docs)
    assert sorted(map(tuple, df.collect())) == [(1, "aa", 3), (1, "bb", 1), (4, "zz", 2), (5, "zz", 2)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    odd = spark.sql("select term_counts(text) x from {docs} order by i", docs=docs).collect()
    assert odd[1].x is None and odd[2].x == [] and [tuple(y) for y in odd[3].x] == [("zz", 2)]


def test_cached_search_by_number(spark):
    """A result cache answers the query that it holds, and not one whose vector is near it."""
    vec = [1.0, 0.0]
    queries = spark.createDataFrame([(1, vec), (3, vec), (4, [0.0, 1.0])], "qid long, vec array<double>")
    cache = spark.createDataFrame([(3, vec, [(77, 1.0, 1)])], "entry_id long, vec array<double>, results array<struct<doc_id: long, score: double, rank: int>>").withColumn("expires", F.expr("timestamp '2024-02-01 00:00:00'"))
    corpus = spark.createDataFrame([(5, vec), (6, [0.0, 1.0])], "doc_id long, vec array<double>")
    rows, log, state = ingest.cached_search(cache, corpus, queries, lambda c, q: nearest.knn(c, q, 1), "2024-01-15 00:00:00", keyed=True)
    assert sorted((r.qid, r.doc_id, r.cached) for r in rows.collect()) == [(1, 5, False), (3, 77, True), (4, 6, False)]
    assert {r.qid: r.cached for r in log.collect()} == {1: False, 3: True, 4: False}
    assert sorted(r.entry_id for r in state.collect()) == [1, 3, 4]
