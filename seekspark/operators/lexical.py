"""The inverted index and BM25. Queries are rows (qid, text); one query is one row."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import service_tokens, sparse_tokens
from ..sources.shared import kept

K1, B = 1.2, 0.75
#: Queries that are answered in one pass over the documents, queries in one product, and documents in one product.
QUERIES, ASKED, DOCUMENTS = 1024, 128, 512
#: Postings that leave a task in one batch. Tokens are counted DOCUMENTS at a time too, however many a batch from Spark holds.
POSTINGS = 1 << 16


def tokenized(docs: DataFrame, tokenizer=sparse_tokens, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), tokenizer(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, DOCUMENTS):
            yield b.slice(i, DOCUMENTS)


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl): the postings. What is counted lies within one row, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            n = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy()
            words = b.column(1).flatten().dictionary_encode()
            known = max(len(words.dictionary), 1)
            pair, tf = np.unique(np.repeat(np.arange(len(n)), n) * known + words.indices.to_numpy(), return_counts=True)
            row = pair // known
            for i in range(0, len(pair), POSTINGS):
                j = slice(i, i + POSTINGS)
                doc, term = b.column(0).take(pa.array(row[j])), words.dictionary.take(pa.array(pair[j] % known))
                yield pa.RecordBatch.from_arrays([doc, term, pa.array(tf[j]), b.column(2).take(pa.array(row[j]))], ["doc_id", "term", "tf", "dl"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "tokens", "dl").mapInArrow(run, f"doc_id {kind}, term string, tf long, dl int")


def terms(postings: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(term, df, cf) of tokenised documents, without their postings: tokens, and the different ones of each document, are counted where they are."""
    marked = lambda c, first: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(first).alias("first")))
    each = tokens.select(F.explode(F.concat(marked("tokens", False), marked(F.array_distinct("tokens"), True))).alias("t")).select("t.*")
    return each.groupBy("term").agg(F.count_if("first").alias("df"), F.count_if(~F.col("first")).alias("cf"))


def small(df: DataFrame, most: int) -> bool:
    """Whether a table has at most so many rows, without counting further."""
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if small(df, most) else df


def top(scored: DataFrame, k: int, by: str = "score", key: str = "doc_id") -> DataFrame:
    """The k best of each query with their rank. Scores equal to nine digits, whatever the order of their sums, tie; then by key."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round(by, 9)), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _hits(docs: DataFrame, tokenizer, vocabulary: list[str], distinct: bool) -> DataFrame:
    """(doc_id, dl, length, terms, tf): of each document the asked terms, as places in `vocabulary`, and how often it has them.

    dl counts tokens, length what the mean length is taken of: tokens, or those that are distinct.

    Texts are tokenised in the JVM and lose all other tokens there; what is counted lies within one row, so nothing is shuffled.
    """
    tokens = tokenizer(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.alias("tokens"))
    listed = ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in vocabulary) or "null"
    length = F.size(F.array_distinct("tokens")) if distinct else F.size("tokens")
    rows = rows.select("doc_id", F.size("tokens").alias("dl"), length.alias("length"), F.expr(f"filter(tokens, x -> x in ({listed}))").alias("asked"))
    known = pa.array(vocabulary, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            words = b.column(3)
            n = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
            term = pc.index_in(words.flatten(), known).to_numpy(zero_copy_only=False).astype(np.int64)
            pair, tf = np.unique(np.repeat(np.arange(len(n)), n) * max(len(vocabulary), 1) + term, return_counts=True)
            at = pa.array(np.searchsorted(pair, np.arange(len(n) + 1) * max(len(vocabulary), 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (pair % max(len(vocabulary), 1), tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *lists], ["doc_id", "dl", "length", "terms", "tf"])

    return rows.mapInArrow(run, "doc_id long, dl int, length int, terms array<int>, tf array<int>")


def _ranked(docs: DataFrame, queries: DataFrame, k: int, tokenizer, distinct: bool, idf, keep) -> DataFrame:
    """BM25 of all documents for blocks of queries: documents are read once for a block, and a task passes on its k best for each.

    The postings of the asked terms are a table (a list of small numbers for each document); counts of documents by term are
    sums over it, with one number a term on the driver; scores are sparse products in the tasks, ASKED queries at a time.
    """
    terms = tokenizer(F.col("text"))
    asked = queries.select("qid", (F.array_distinct(terms) if distinct else terms).alias("t"))
    first, out = asked.limit(QUERIES + 1).collect(), None
    for block in [first] if len(first) <= QUERIES else _blocks(asked):
        times = [Counter(r.t or []) for r in block]
        vocabulary = sorted(set().union(*times))
        place = {t: i for i, t in enumerate(vocabulary)}
        hits = kept(_hits(docs, tokenizer, vocabulary, distinct), "postings")
        df = np.zeros(len(vocabulary))
        for r in hits.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r.term] = r["count"]
        n, avgdl = hits.agg(F.count("*"), F.avg("length")).first()
        weight = idf(n, df)
        parts = []
        for i in range(0, len(block), ASKED):
            some = times[i : i + ASKED]
            use = np.array(sorted({place[t] for x in some for t in x}), np.int64)
            w, has = np.zeros((len(use), len(some))), np.zeros((len(use), len(some)), np.float32)
            for j, x in enumerate(some):
                for t, m in x.items():
                    at = np.searchsorted(use, place[t])
                    w[at, j], has[at, j] = (1 if distinct else m) * weight[place[t]], 1
            parts.append((use, w, has))
        part = _scored(hits, np.array([r.qid for r in block], np.int64), parts, float(avgdl or 1.0), len(vocabulary), k, keep)
        out = part if out is None else out.unionByName(part)
    return top(out, k)


def _scored(hits: DataFrame, qids: np.ndarray, parts: list, avgdl: float, terms: int, k: int, keep) -> DataFrame:
    from .nearest import Best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(qids), k)
        column = np.full(max(terms, 1), -1)
        for b in batches:
            for i in range(0, b.num_rows, DOCUMENTS):
                some = b.slice(i, DOCUMENTS)
                n = pc.list_value_length(some.column(2)).to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                term, tf = some.column(2).flatten().to_numpy(), some.column(3).flatten().to_numpy().astype(np.float64)
                dl = some.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[row]
                value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
                at = 0
                for use, w, has in parts:
                    column[:] = -1
                    column[use] = np.arange(len(use))
                    c = column[term]
                    ok = c >= 0
                    x, met = np.zeros((len(n), len(use))), np.zeros((len(n), len(use)), np.float32)
                    x[row[ok], c[ok]], met[row[ok], c[ok]] = value[ok], 1
                    s = (x @ w).T
                    # a document counts for a query if they share a term and the score is enough
                    s[~((met @ has).T > 0) | ~keep(s)] = -np.inf
                    best.add(np.arange(at, at + w.shape[1]), some.column(0).to_numpy(), s)
                    at += w.shape[1]
        found = best.batch(qids)
        yield found.filter(pc.is_finite(found.column(2)))

    return hits.select("doc_id", "dl", "terms", "tf").mapInArrow(run, "qid long, doc_id long, score double")


def _blocks(asked: DataFrame) -> Iterator[list]:
    block = []
    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == QUERIES:
            yield block
            block = []
    if block:
        yield block


def bm25_sparse(docs: DataFrame, queries: DataFrame, k: int = 10, min_score: float = 0.0) -> DataFrame:
    """(qid, doc_id, score, rank). IDF may be negative; a term asked twice counts twice."""
    return _ranked(docs, queries, k, sparse_tokens, False, lambda n, df: np.log((n - df + 0.5) / (df + 0.5)), lambda s: s >= min_score)


def bm25_service(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, doc_id, score, rank). IDF at least 0, distinct query terms, mean length over distinct terms, scores above 0."""
    return _ranked(docs, queries, k, service_tokens, True, lambda n, df: np.maximum(0, np.log((n - df + 0.5) / (df + 0.5))), lambda s: s > 0)


def bm25_components(docs: DataFrame, term: str) -> DataFrame:
    """(doc_id, tf_part, idf, length_ratio) of one term."""
    tokens = tokenized(docs)
    hits = tokens.select("doc_id", "dl", F.size(F.filter("tokens", lambda x: x == term)).alias("tf")).where("tf > 0")
    corpus = tokens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.count_if(F.array_contains("tokens", term)).alias("df"))
    x = hits.join(F.broadcast(corpus))
    ratio = F.col("dl") / F.col("avgdl")
    return x.select("doc_id", (F.col("tf") / (F.col("tf") + K1 * (1 - B + B * ratio))).alias("tf_part"), F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), ratio.alias("length_ratio"))
