"""Searches composed from the lexical and vector arms. A corpus has (doc_id, text, vec), queries have (qid, text, vec)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_score, space_tokens, sparse_tokens
from ..operators import fusion, lexical, nearest
from ..operators.lexical import top

#: A word that has one of these inside makes a query technical for the hybrid plan.
TECHNICAL = ["api", "http", "json", "sql", "ai", "ml"]
ARM_K = 10


def metadata_filter(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows whose metadata map has all the pairs; a null map or a missing key has none."""
    cond = F.lit(True)
    for k, v in wanted.items():
        cond = cond & F.coalesce(F.col("metadata")[k] == v, F.lit(False))
    return rows.where(cond)


def min_score(rows: DataFrame, least: float) -> DataFrame:
    return rows.where(~F.isnan("score") & (F.col("score") >= least))


def arms(corpus: DataFrame, queries: DataFrame, k: int = ARM_K) -> tuple[DataFrame, DataFrame]:
    return nearest.knn(corpus.select("doc_id", "vec"), queries.select("qid", "vec"), k), lexical.bm25_sparse(corpus.select("doc_id", "text"), queries.select("qid", "text"), k)


def hybrid(corpus: DataFrame, queries: DataFrame, method: str = "RRF", wv: float = 0.7, ws: float = 0.3, k: int = 10, arm_k: int = ARM_K) -> DataFrame:
    v, s = arms(corpus, queries, arm_k)
    return fusion.METHODS[method](v, s, wv=wv, ws=ws, k=k)


def auto_strategy(text: Column) -> Column:
    """Weight of the vector arm and fusion method by the query's length and vocabulary, as a struct."""
    words = space_tokens(text)
    n = F.size(words)
    technical = F.exists(words, lambda x: F.lower(x).rlike("|".join(TECHNICAL)))
    weight = F.when(n <= 2, 0.3).when(n <= 5, 0.6).otherwise(0.8)
    name = F.when(n <= 2, "SparseFirst").when(n <= 5, "Balanced").otherwise("VectorFirst")
    return F.struct(name.alias("strategy"), weight.alias("vector_weight"), F.when(technical, "WeightedSum").otherwise("RRF").alias("method"))


def hybrid_auto(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Every query by the strategy of its own features, all in one plan."""
    chosen = queries.select("qid", auto_strategy(F.col("text")).alias("c")).select("qid", "c.*")
    v, s = arms(corpus, queries)
    w = Window.partitionBy("qid")
    a = v.select("qid", "doc_id", F.col("score").alias("v"), F.col("rank").alias("rv"))
    b = s.select("qid", "doc_id", F.col("score").alias("s"), F.col("rank").alias("rs"))
    x = a.join(b, ["qid", "doc_id"], "full").join(chosen, "qid").withColumns({"mv": F.max("v").over(w), "ms": F.max("s").over(w)})
    wv, ws = F.col("vector_weight"), 1 - F.col("vector_weight")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = lambda c, m: F.when(F.col(m) != 0, F.col(c) / F.col(m))
    rrf = zero(wv / (fusion.RRF_K + F.col("rv"))) + zero(ws / (fusion.RRF_K + F.col("rs")))
    summed = zero(wv * share("v", "mv")) + zero(ws * share("s", "ms"))
    return fusion._finish(x, F.when(F.col("method") == "RRF", rrf).otherwise(summed), k, 0.0)


def rank_hybrid(corpus: DataFrame, queries: DataFrame, k: int = 10, vector_weight: float = 0.5) -> DataFrame:
    """Twice k of each arm; even weights fuse by rank, others by normalised score."""
    v, s = arms(corpus, queries, 2 * k)
    if abs(vector_weight - 0.5) <= 0.01:
        return fusion.rrf_many({"vector": v, "keyword": s}, k)
    return fusion.weighted_many({"vector": (v, vector_weight), "keyword": (s, 1 - vector_weight)}, k)


def find_similar(vectors: DataFrame, doc_id: int, k: int = 10, least: float = 0.0) -> DataFrame:
    """Neighbours of one document's vector, itself left out."""
    own = vectors.where(F.col("doc_id") == doc_id).select(F.col("doc_id").alias("qid"), "vec")
    return nearest.knn(vectors.where(F.col("doc_id") != doc_id), own, k, min_score=least)


def advanced(corpus: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.0, rerank=None) -> DataFrame:
    """Over-fetches min(3k, 50) at 0.7 of the least score, lets a reranker reorder, keeps k."""
    hits = nearest.knn(corpus.select("doc_id", "vec"), queries.select("qid", "vec"), min(3 * k, 50), min_score=0.7 * least)
    return top((rerank(hits) if rerank else hits).drop("rank"), k)


def boolean_and(docs: DataFrame, terms: list[str]) -> DataFrame:
    tokens = sparse_tokens(F.col("text"))
    return docs.where(F.forall(F.array(*map(F.lit, terms)), lambda t: F.array_contains(tokens, t)))


def phrase(docs: DataFrame, words: str) -> DataFrame:
    return docs.where(F.contains(F.lower("text"), F.lit(words.lower())))


def facets(docs: DataFrame, fields: list[str], most: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, field, value, n): the most frequent values of each field, in one pass over the rows."""
    by = by or []
    long = docs.select(*by, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select(*by, "x.*")
    counts = long.groupBy(*by, "field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by, "field").orderBy(F.desc("n"), "value")
    return counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def keyword(docs: DataFrame, chunks: DataFrame, word: str, k: int = 10, wanted: dict[str, str] | None = None) -> DataFrame:
    """(chunk_id, score, rank): of documents that hold the word, the chunks that hold it, by how often for each of their words."""
    held = docs.where(F.contains(F.lower("text"), F.lit(word.lower()))).select(F.col("doc_id").alias("document_id"))
    found = chunks.where(F.contains(F.lower("content"), F.lit(word.lower()))).join(held, "document_id", "left_semi")
    found = metadata_filter(found, wanted or {}).select("chunk_id", keyword_score(F.col("content"), word).alias("score"))
    best = found.orderBy(F.desc(F.round("score", 9)), "chunk_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "chunk_id")))


def in_fields(docs: DataFrame, wanted: dict[str, str], case_sensitive: bool = False) -> DataFrame:
    """Documents that hold a field's text in that field, with in_<field> for each."""
    low = (lambda c: c) if case_sensitive else F.lower
    found = {f"in_{f}": F.coalesce(F.contains(low(F.col(f)), F.lit(x if case_sensitive else x.lower())), F.lit(False)) for f, x in wanted.items()}
    some = F.lit(False)
    for c in found:
        some = some | F.col(c)
    return docs.withColumns(found).where(some)


def merged(chunks: DataFrame, metadata: dict[str, str], score: Column) -> DataFrame:
    """Chunks with another score, and metadata in which the new values win."""
    new = F.create_map(*(F.lit(x) for kv in metadata.items() for x in kv))
    old = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(list(metadata)))
    return chunks.withColumns({"metadata": F.map_concat(old, new), "score": score})


def suggestions(terms: DataFrame, prefix: str, k: int = 10) -> DataFrame:
    return terms.where(F.startswith("term", F.lit(prefix.lower()))).orderBy(F.desc("df"), "term").limit(k)


def highlighted(c: Column, keyword: str, mark: tuple[str, str] = ("<em>", "</em>")) -> Column:
    import re

    return F.regexp_replace(c, f"(?i)({re.escape(keyword)})", f"{mark[0]}$1{mark[1]}")
