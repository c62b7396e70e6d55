"""Ingestion as plans over tables: documents become chunks and vectors; changes give the tables' next state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hooks import embedded
from ..operators import chunking, context
from ..operators.cache import key
from ..operators.nearest import knn
from ..sources import tables
from ..sources.shared import kept


@dataclass
class Index:
    """documents (doc_id, ..., status, n_chunks), chunks (chunk_id, document_id, ...), vectors (chunk_id, document_id, vec)."""

    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame


def index(docs: DataFrame, strategy: str = "fixed", embedder: str = "counted_words", **options: int) -> Index:
    """Documents with their chunks and the chunks' vectors. A document without a chunk has status Failed, and nothing else."""
    chunks = chunking.chunk(docs.where("text is not null and text <> ''"), strategy, **options).where("content <> ''")
    n = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    known = docs.join(n.withColumnRenamed("document_id", "doc_id"), "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    known = known.withColumn("status", F.when(F.col("n_chunks") > 0, "Indexed").otherwise("Failed"))
    return Index(known, chunks, embedded(chunks).select("chunk_id", "document_id", "vec"))


def updated(old: Index, docs: DataFrame, **options) -> Index:
    """The index after these documents came, or came again: what they had before is gone."""
    new, ids = index(docs, **options), docs.select("doc_id").distinct()
    of = ids.withColumnRenamed("doc_id", "document_id")
    return Index(
        tables.upsert(old.documents, new.documents, "doc_id"),
        tables.delete(old.chunks, of, "document_id").unionByName(new.chunks),
        tables.delete(old.vectors, of, "document_id").unionByName(new.vectors),
    )


def removed(old: Index, ids: DataFrame) -> Index:
    """The index without these documents (doc_id)."""
    of = ids.select(F.col("doc_id").alias("document_id"))
    return Index(tables.delete(old.documents, ids, "doc_id"), tables.delete(old.chunks, of, "document_id"), tables.delete(old.vectors, of, "document_id"))


def embedded_again(old: Index, ids: DataFrame, embedder: str) -> Index:
    """The index with new vectors for the chunks of these documents (doc_id)."""
    of = ids.select(F.col("doc_id").alias("document_id")).distinct()
    new = embedded(old.chunks.join(of, "document_id", "left_semi"), name=embedder).select("chunk_id", "document_id", "vec")
    return Index(old.documents, old.chunks, tables.delete(old.vectors, of, "document_id").unionByName(new))


def enriched(chunks: DataFrame) -> DataFrame:
    """Chunks with the content before and after, the likeness to these, and a quality from length and variety of words."""
    x = tables.enriched(chunks)
    like = lambda c: F.when(F.col(c).isNotNull(), context.jaccard(context.word_set(F.col("content")), context.word_set(F.col(c))))
    words = context.space_tokens(F.lower("content"))
    variety = F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words)).otherwise(0.0)
    quality = 0.5 * F.least(F.lit(1.0), F.length("content") / 500) + 0.5 * variety
    return x.withColumns({"like_previous": like("previous"), "like_following": like("following"), "quality": quality})


def assigned(chunks: DataFrame) -> DataFrame:
    """Chunks with an id where they have none: a hash of document, place and content, so that a retried task gives the same."""
    return chunks.withColumn("chunk_id", F.coalesce("chunk_id", key(F.col("document_id"), F.col("chunk_index"), F.col("content"))))


def migrated(legacy: DataFrame) -> DataFrame:
    """(chunk_id, vec) of rows that hold their vector as JSON text; rows whose text is no list of numbers are left out."""
    return legacy.select("chunk_id", F.from_json("embedding", "array<double>").alias("vec")).where("vec is not null and size(vec) > 0")


def cached_search(cache: DataFrame, corpus: DataFrame, queries: DataFrame, search, as_of: str, least: float = 0.95, ttl: str = "15 minutes", keyed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, log, cache): queries that a live entry answers take its results; the others are searched; the log has a row for each.

    The cache's next state holds the live entries and the answers that were searched, each under the number of its query.

    An entry answers the queries that are near enough to it; with `keyed`, as in a retriever's result cache, the query whose number it has.

    cache: (entry_id, vec, expires, results: array of (doc_id, score, rank)). `search` takes (corpus, queries) and returns ranked rows.
    """
    live = cache.where(F.col("expires") > F.lit(as_of).cast("timestamp"))
    if keyed:
        hits = queries.select("qid", F.col("qid").alias("entry_id")).join(live.select("entry_id"), "entry_id", "left_semi").select("qid", "entry_id")
    else:
        hits = knn(live.select(F.col("entry_id").alias("doc_id"), "vec"), queries, 1, min_score=least).select("qid", F.col("doc_id").alias("entry_id"))
    stored = hits.join(live.select("entry_id", F.explode("results").alias("r")), "entry_id").select("qid", "r.doc_id", "r.score", "r.rank", F.lit(True).alias("cached"))
    found = kept(search(corpus, queries.join(hits, "qid", "left_anti")).select("qid", "doc_id", "score", "rank", F.lit(False).alias("cached")), "found")
    results = stored.unionByName(found)
    log = queries.select("qid").join(results.groupBy("qid").agg(F.count("*").alias("results"), F.max("cached").alias("cached"), F.avg("score").alias("similarity")), "qid", "left")
    log = log.select("qid", F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("cached", F.lit(False)).alias("cached"), "similarity")
    answers = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("r"))  # k rows a query
    answers = answers.select("qid", F.transform("r", lambda x: F.struct(x.doc_id.alias("doc_id"), x.score.alias("score"), x["rank"].alias("rank"))).alias("results"))
    expires = F.lit(as_of).cast("timestamp") + F.expr(f"interval {ttl}")
    new = answers.join(queries.select("qid", "vec"), "qid").select(F.col("qid").alias("entry_id"), "vec", expires.alias("expires"), "results")
    return results, log, live.select("entry_id", "vec", "expires", "results").unionByName(new)


def statistics(index: Index) -> DataFrame:
    """One row: documents, indexed ones, chunks, mean chunks of a document and characters of a chunk."""
    docs = index.documents.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "Indexed").alias("indexed"))
    chunks = index.chunks.agg(F.count("*").alias("chunks"), F.avg(F.length("content")).alias("avg_chars"))
    x = docs.join(F.broadcast(chunks))
    mean = F.when(F.col("indexed") > 0, F.col("chunks") / F.when(F.col("indexed") > 0, F.col("indexed"))).otherwise(0.0)
    return x.withColumn("chunks_each", mean)


def client_statistics(index: Index, cache: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """One row on a client: what its index holds, the live entries of its cache, and of its searches (a log as `cached_search` gives it)
    their number, the share that the cache answered, and their mean likeness. Without documents or searches the means are 0."""
    share = lambda part, whole: F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(0.0)
    docs = index.documents.agg(F.count("*").alias("documents"))
    chunks = index.chunks.agg(F.count("*").alias("chunks"))
    entries = cache.agg(F.count_if(F.col("expires") > F.lit(as_of).cast("timestamp")).alias("cached_entries"))
    searches = log.agg(F.count("*").alias("searches"), F.count_if("cached").alias("hits"), F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("similarity"))
    x = docs.join(F.broadcast(chunks)).join(F.broadcast(entries)).join(F.broadcast(searches))  # a row each
    return x.select("documents", "chunks", share(F.col("chunks"), F.col("documents")).alias("chunks_each"), "cached_entries", "searches", share(F.col("hits"), F.col("searches")).alias("hit_rate"), "similarity")


def described(docs: DataFrame, terms: DataFrame, n: int, keywords: int = 5, summary: int = 200) -> DataFrame:
    """(doc_id, title, summary, keywords, entities): metadata from the text alone.

    The title is the first line with a letter, the summary the first characters, keywords are the words with the largest tf-idf
    (`terms`: term, df; `n` documents), entities the first words in capitals.
    """
    from ..operators.lexical import term_frequencies, tokenized

    tf = term_frequencies(tokenized(docs)).join(terms.select("term", "df"), "term")
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round(F.col("tf") * F.ln(F.lit(n) / F.col("df")), 9)), "term")
    best = tf.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keywords)
    best = best.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("r", "term"))).alias("k")).select("doc_id", F.transform("k", lambda x: x.term).alias("keywords"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"\p{L}"))
    names = F.slice(F.array_distinct(F.filter(F.split("text", r"[^\p{L}\p{Nd}]+"), lambda x: x.rlike(r"^\p{Lu}") & (F.length(x) > 2))), 1, keywords)
    made = docs.select("doc_id", F.try_element_at(lines, F.lit(1)).alias("title"), F.substring(F.trim("text"), 1, summary).alias("summary"), names.alias("entities"))
    return made.join(best, "doc_id", "left")


def searchable(titled: DataFrame) -> DataFrame:
    """(doc_id, terms): words of the title, keywords and entities of more than two characters, distinct, then in lower case."""
    words = F.concat(context.space_tokens(F.coalesce("title", F.lit(""))), F.coalesce("keywords", F.array().cast("array<string>")), F.coalesce("entities", F.array().cast("array<string>")))
    return titled.select("doc_id", F.transform(F.array_distinct(F.filter(words, lambda x: F.length(x) > 2)), F.lower).alias("terms"))
