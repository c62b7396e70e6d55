"""Term expansion by relevance feedback: what the first hits say beside the query's own words is asked too, with less weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import postings
from .lexical import term_frequencies, tokenized


def expanded(index: postings.Index, docs: DataFrame, queries: DataFrame, hits: int = 5, terms: int = 10, weight: float = 0.5, found: DataFrame | None = None) -> DataFrame:
    """(qid, term, times): each query's terms and the `terms` best new ones of its first `hits` documents.

    A term's value is the sum over these documents of its share of the text, times its inverse document frequency, not below 0; it
    weighs `weight` times that of the best. Only the texts of hits are read. Where the queries' ranked hits are `found` already
    (at least `hits` of each that has so many), they are not searched again.
    """
    asked = postings.kept(postings.asked_terms(index, queries), "asked")
    ranked = postings.search_terms(index, asked, hits) if found is None else found.where(F.col("rank") <= hits)
    first = postings.kept(ranked.select("qid", "doc_id"), "first")
    texts = docs.join(first.select("doc_id").distinct(), "doc_id", "left_semi")
    tf = postings.kept(term_frequencies(tokenized(texts, index.tokenizer)), "tf")
    n = index.live().count()
    idf = F.greatest(F.lit(0.0), F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    known = postings.frequencies(index, tf.select("term")).select("term", idf.alias("idf"))
    value = first.join(tf, "doc_id").join(known, "term").groupBy("qid", "term").agg(F.sum(F.col("tf") / F.col("dl") * F.col("idf")).alias("value"))
    value = value.where("value > 0").join(asked.select("qid", "term"), ["qid", "term"], "left_anti")
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("value", 9)), "term")
    new = value.withColumn("r", F.row_number().over(best)).where(F.col("r") <= terms)
    new = new.select("qid", "term", (weight * F.col("value") / F.max("value").over(Window.partitionBy("qid"))).alias("times"))
    return asked.unionByName(new)


def search(index: postings.Index, docs: DataFrame, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    """(qid, doc_id, score, rank) of the expanded queries."""
    return postings.search_terms(index, expanded(index, docs, queries, **options), k)
