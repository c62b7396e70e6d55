"""Local reranking of candidates (qid, doc_id, rank, text) against queries (qid, text) by term overlap and position."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rerank_tokens

CUT = 1024
_IDF = math.log(1000.5 / 1.5)


def tf_cosine(a: Column, b: Column) -> Column:
    """Cosine of 1 + ln(tf) over two token arrays; 0 if one is empty."""
    weight = lambda t, x: 1 + F.ln(F.size(F.filter(t, lambda y: y == x)))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, x: s + weight(a, x) * weight(b, x))
    norm = lambda t: F.sqrt(F.aggregate(F.array_distinct(t), F.lit(0.0), lambda s, x: s + F.pow(weight(t, x), F.lit(2))))
    n = norm(a) * norm(b)
    return F.when(n > 0, both / n).otherwise(0.0)


def fixed_bm25(query: Column, content: Column, chars: Column) -> Column:
    """BM25 with one IDF for all terms and length in characters against 100, by query token."""
    tf = lambda x: F.size(F.filter(content, lambda y: y == x)).cast("double")
    total = F.aggregate(F.array_distinct(query), F.lit(0.0), lambda s, x: s + _IDF * tf(x) * 2.2 / (tf(x) + 1.2 * (0.25 + 0.75 * chars / 100)))
    return F.when(F.size(query) > 0, F.greatest(F.lit(0.0), total / F.size(query))).otherwise(0.0)


def local(queries: DataFrame, candidates: DataFrame, k: int = 10, least: float = 0.0, similarity: Column | None = None) -> DataFrame:
    """(qid, doc_id, rank, new_rank, tfidf, bm25, score). Ranks are given before the threshold, the limit after."""
    x = candidates.join(queries.select("qid", F.col("text").alias("asked")), "qid").withColumn("content", F.substring("text", 1, CUT))
    x = x.withColumns({"qt": rerank_tokens(F.col("asked")), "ct": rerank_tokens(F.col("content"))})
    x = x.withColumns({"tfidf": tf_cosine(F.col("qt"), F.col("ct")), "bm25": fixed_bm25(F.col("qt"), F.col("ct"), F.length("content"))})
    boost = F.greatest(F.lit(0.0), (10 - F.col("rank")) * 0.01)
    score = 0.4 * F.col("tfidf") + 0.3 * F.col("bm25") + 0.3 * (similarity if similarity is not None else F.lit(0.0)) + boost
    x = x.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
    x = x.withColumn("new_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "rank")))
    return x.where((F.col("score") >= least) & (F.col("new_rank") <= k)).select("qid", "doc_id", "rank", "new_rank", "tfidf", "bm25", "score")


#: Weights of likeness, quality (length up to a thousand characters) and place, by strategy; models are hooks of their own.
STRATEGIES = {"Semantic": (1.0, 0.0, 0.0), "Quality": (0.4, 0.6, 0.0), "Contextual": (0.5, 0.0, 0.5), "Hybrid": (0.5, 0.2, 0.3)}


def by_strategy(candidates: DataFrame, strategy: str, k: int = 10) -> DataFrame:
    """(qid, doc_id, rank, new_rank, score) of candidates (qid, doc_id, rank, score, text)."""
    a, b, c = STRATEGIES[strategy]
    score = a * F.col("score") + b * F.least(F.lit(1.0), F.length("text") / 1000) + c / F.col("rank")
    x = candidates.withColumn("score", score)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return x.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k).select("qid", "doc_id", "rank", "new_rank", "score")
