"""A stored inverted index: built once, changed in part, searched for any number of queries in one plan.

The index is a folder in the shared file system:

  postings/segment=S/shard=H   (term, block, docs, tfs, dls): the documents of a block that have the term, in order of their id, with
                               counts and lengths; n is how many, most (largest count) and least (smallest length) bound what they
                               can score; a row without a term lists all documents that a shard was built of
  lengths/segment=S            (doc_id, shard, dl): the documents of a segment
  gone/segment=S               (doc_id): documents that segments before S no longer hold

Documents fall into shards by a hash of their id, SHARD to each at most on average, and a shard into BLOCKS blocks, so a shard is a bounded piece of work. Adding or
removing documents writes a new segment and touches no file of the others; `merge` makes one segment of all.

A search reads the postings of the asked terms only. These go, once for each group of queries, to one task a shard, together with the
weights of the group's terms. A task takes the blocks of its shard in order of what they can score at most, and a query leaves out
those that cannot reach its k best so far.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sparse_tokens
from ..sources.shared import drop, kept, place
from .lexical import K1, B, maybe_broadcast, top
from .nearest import Best

SHARD, BLOCKS = 8192, 16
#: Queries whose weights travel together, and tombstones that are broadcast at most.
GROUP, FEW = 1024, 1_000_000
_POSTINGS = "term string, block int, docs array<long>, tfs array<long>, dls array<int>, n int, most long, least int, segment int, shard int"
_LENGTHS = "doc_id long, shard int, dl int, segment int"
_GONE = "doc_id long, segment int"


@dataclass
class Index:
    """An index in a folder, and how its texts and queries become terms."""

    spark: SparkSession
    path: str
    tokenizer: object = sparse_tokens

    def _read(self, name: str, schema: str) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def postings(self) -> DataFrame:
        return self._read("postings", _POSTINGS).where("term is not null")

    def lengths(self) -> DataFrame:
        return self._read("lengths", _LENGTHS)

    def gone(self) -> DataFrame:
        return self._read("gone", _GONE)

    def live(self) -> DataFrame:
        """(doc_id, shard, dl, segment) of the documents that are not gone."""
        gone = self.gone().groupBy("doc_id").agg(F.max("segment").alias("upto"))
        x = self.lengths().join(maybe_broadcast(gone, FEW), "doc_id", "left")
        return x.where("upto is null or segment >= upto").drop("upto")

    def next_segment(self) -> int:
        last = [df.agg(F.max("segment")).first()[0] for df in (self.lengths(), self.gone())]  # partition values alone
        return max(-1 if x is None else x for x in last) + 1


_LISTS = "term string, block int, docs array<long>, tfs array<long>, dls array<int>, n int, most long, least int, shard int"


_NAMES = ["term", "block", "docs", "tfs", "dls", "n", "most", "least", "shard"]


def _shards(n: int) -> int:
    """A power of two, so that shards of one number of them are parts, or unions, of those of another."""
    return _power(max(1, -(-n // SHARD)))


def _hash(shards: int, c: str = "doc_id"):
    return F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")


def _grouped(shard: pa.Scalar, words: pa.Array, term: np.ndarray, block: np.ndarray, doc: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> pa.Table:
    """The lists of a shard's postings in order of their terms; `term` is a place in `words`."""
    alphabetical = pc.sort_indices(words)
    words, place = words.take(alphabetical), np.empty(len(words), np.int64)
    place[alphabetical.to_numpy()] = np.arange(len(words))
    term = place[term]
    order = np.lexsort((doc, block, term))
    term, block, doc, tf, dl = (x[order] for x in (term, block, doc, tf, dl))
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
    at = pa.array(np.r_[first, len(term)], pa.int32())
    lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((doc, pa.int64()), (tf, pa.int64()), (dl, pa.int32()))]
    most, least = (f.reduceat(x, first) if len(first) else x[:0] for f, x in ((np.maximum, tf), (np.minimum, dl)))
    columns = [words.take(pa.array(term[first])), pa.array(block[first], pa.int32()), *lists, pa.array(np.diff(at.to_numpy()), pa.int32()), pa.array(most, pa.int64()), pa.array(least, pa.int32()), pa.repeat(shard, len(first))]
    return pa.Table.from_arrays(columns, _NAMES)


def _counted(docs: pa.Table) -> pa.Table:
    """The lists of a shard's documents (shard, block, doc_id, tokens, dl), and one without a term: all documents and their lengths."""
    words, pairs = [], []
    for b in docs.to_batches():
        tokens = b.column("tokens")
        n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
        coded = tokens.flatten().dictionary_encode()
        known = max(len(coded.dictionary), 1)
        pair, tf = np.unique(np.repeat(np.arange(len(n)), n) * known + coded.indices.to_numpy(), return_counts=True)
        row = pair // known
        words.append(coded.dictionary)
        pairs.append((pair % known, *(b.column(c).to_numpy(zero_copy_only=False)[row] for c in ("block", "doc_id")), tf, b.column("dl").to_numpy(zero_copy_only=False)[row]))
    every = pa.chunked_array(words, pa.string()).unique()
    term = [pc.index_in(w, every).to_numpy(zero_copy_only=False)[p[0]] for w, p in zip(words, pairs, strict=True)]
    every = every.combine_chunks() if isinstance(every, pa.ChunkedArray) else every
    lists = _grouped(docs.column("shard")[0], every, np.concatenate(term), *(np.concatenate(x) for x in list(zip(*pairs, strict=True))[1:]))
    ids, dls = docs.column("doc_id").combine_chunks(), docs.column("dl").combine_chunks()
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    none, zero = whole(pa.array([], pa.int64())), pa.array([0], pa.int32())
    row = [pa.array([None], pa.string()), zero, whole(ids), none, whole(dls), pa.array([docs.num_rows], pa.int32()), pa.array([0], pa.int64()), zero, pa.repeat(docs.column("shard")[0], 1)]
    return pa.concat_tables([pa.Table.from_arrays(row, _NAMES), lists])


def _merged(lists: pa.Table, live: pa.Table) -> pa.Table:
    """The lists of a shard, of those of all segments (to, segment, term, block, docs, tfs, dls) and what is live (to, segment, doc_id)."""
    if not lists.num_rows:
        return pa.Table.from_pylist([], pa.schema([("term", pa.string()), ("block", pa.int32()), ("docs", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int64())), ("dls", pa.list_(pa.int32())), ("n", pa.int32()), ("most", pa.int64()), ("least", pa.int32()), ("shard", pa.int32())]))
    coded = lists.column("term").combine_chunks().dictionary_encode()
    size = pc.list_value_length(lists.column("docs")).to_numpy()
    wide = lambda x: np.repeat(x, size)
    doc, tf, dl = (lists.column(c).combine_chunks().flatten().to_numpy() for c in ("docs", "tfs", "dls"))
    term, block, segment = wide(coded.indices.to_numpy()), wide(lists.column("block").to_numpy()), wide(lists.column("segment").to_numpy())
    keep = np.zeros(len(doc), bool)
    has, of = live.column("doc_id").to_numpy(), live.column("segment").to_numpy()
    for s in np.unique(segment):
        keep |= (segment == s) & np.isin(doc, has[of == s])
    return _grouped(lists.column("to")[0], coded.dictionary, *(x[keep] for x in (term, block, doc, tf, dl)))


def _write(index: Index, lists: DataFrame, lengths: DataFrame | None, shards: int, segment: int) -> None:
    """A segment of lists, all of a shard in one task and in order of terms, and lengths (doc_id, dl): those of the lists without a term, if none are given."""
    lists = lists.select("term", "block", "docs", "tfs", "dls", "n", "most", "least", F.lit(segment).alias("segment"), "shard")
    lists.write.mode("append").partitionBy("segment", "shard").parquet(f"{index.path}/postings")
    if lengths is None:
        every = index._read("postings", _POSTINGS).where((F.col("segment") == segment) & F.col("term").isNull())
        lengths = every.select(F.explode(F.arrays_zip("docs", "dls")).alias("x")).select(F.col("x.docs").alias("doc_id"), F.when(F.col("x.dls") >= 0, F.col("x.dls")).alias("dl"))
    lengths.select("doc_id", _hash(shards).alias("shard"), "dl", F.lit(segment).alias("segment")).write.mode("append").partitionBy("segment").parquet(f"{index.path}/lengths")


def build(docs: DataFrame, tokenizer=sparse_tokens, path: str | None = None) -> Index:
    """An index of documents (doc_id, text) with unique ids."""
    index = Index(docs.sparkSession, path or place(docs.sparkSession, "index"), tokenizer)
    add(index, docs)
    return index


def add(index: Index, docs: DataFrame) -> None:
    """Adds documents, in place of those with their ids: one segment more."""
    segment = index.next_segment()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    if segment:
        _mark(index, docs.select("doc_id").join(index.lengths().select("doc_id"), "doc_id", "left_semi"), segment)
    shards = _shards(docs.count())
    # texts go to their shards, and become terms there: no posting is shuffled
    there = docs.withColumn("shard", _hash(shards)).repartition("shard").sortWithinPartitions("shard")
    tokens = there.select("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(BLOCKS)).cast("int").alias("block"), "doc_id", index.tokenizer(F.col("text")).alias("tokens"))
    _write(index, tokens.withColumn("dl", F.size("tokens")).groupBy("shard").applyInArrow(_counted, _LISTS), None, shards, segment)


def remove(index: Index, ids: DataFrame) -> None:
    """Removes documents by doc_id: a list of what is gone, no file is rewritten."""
    _mark(index, ids, index.next_segment())


def _mark(index: Index, ids: DataFrame, segment: int) -> None:
    ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(segment).alias("segment")).write.mode("append").partitionBy("segment").parquet(f"{index.path}/gone")


def merge(index: Index) -> Index:
    """The same documents as one segment, in a folder of its own; readers of the old one see the old state until it is dropped."""
    live = kept(index.live().select("doc_id", "segment", "dl"), "live")
    shards = _shards(live.count())
    out = Index(index.spark, place(index.spark, "index"), index.tokenizer)
    of = index.lengths().groupBy("segment").agg((F.max("shard") + 1).alias("most"))  # a segment's shards may end with empty ones
    known = {r.segment: _power(r.most) for r in of.collect()}
    parts = []
    for s, n in known.items():
        p = index.postings().where(F.col("segment") == s).select("segment", "term", "block", "docs", "tfs", "dls", "shard")
        if n < shards:  # a list goes in parts to the shards that its shard falls into
            p = p.withColumn("to", F.explode(F.expr(f"sequence(shard, {shards - 1}, {n})")))
            mine = F.filter(F.arrays_zip("docs", "tfs", "dls"), lambda x: F.pmod(F.xxhash64(x.docs), F.lit(shards)) == F.col("to"))
            p = p.withColumn("p", mine).where(F.size("p") > 0).withColumns({c: F.col(f"p.{c}") for c in ("docs", "tfs", "dls")}).drop("p")
        else:
            p = p.withColumn("to", F.pmod("shard", F.lit(shards)))
        parts.append(p.select(F.col("to").cast("int").alias("to"), "segment", "term", "block", "docs", "tfs", "dls"))
    lists = parts[0] if parts else index.postings().withColumn("to", F.col("shard")).select("to", "segment", "term", "block", "docs", "tfs", "dls")
    for p in parts[1:]:
        lists = lists.unionByName(p)
    side = live.select(_hash(shards).alias("to"), "segment", "doc_id")
    _write(out, lists.groupBy("to").cogroup(side.groupBy("to")).applyInArrow(_merged, _LISTS), live.select("doc_id", "dl"), shards, 0)
    return out


def _power(n: int) -> int:
    return 1 << (n - 1).bit_length()


def close(index: Index) -> None:
    drop(index.spark, index.path)


# --- search ----------------------------------------------------------------------


def search(index: Index, queries: DataFrame, k: int = 10, min_score: float = 0.0, group: int = GROUP) -> DataFrame:
    """(qid, doc_id, score, rank) by BM25; a term asked twice counts twice."""
    return search_terms(index, asked_terms(index, queries), k, min_score, group)


def asked_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, term, times) of queries (qid, text)."""
    return queries.select(F.col("qid").cast("long").alias("qid"), F.explode(index.tokenizer(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("times"))


def frequencies(index: Index, terms: DataFrame) -> DataFrame:
    """(term, df) of the terms that some document has."""
    hits = index.postings().join(maybe_broadcast(terms.select("term").distinct(), 100_000), "term", "left_semi")
    if index.gone().isEmpty():
        return hits.groupBy("term").agg(F.sum("n").alias("df"))
    dead = _dead(index).select("doc_id", "segment")
    each = hits.select("term", "segment", F.explode("docs").alias("doc_id")).join(maybe_broadcast(dead, FEW), ["doc_id", "segment"], "left_semi")
    rows = hits.select("term", F.col("n").cast("long").alias("n")).unionByName(each.select("term", F.lit(-1).cast("long").alias("n")))
    return rows.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")


def _dead(index: Index) -> DataFrame:
    """(doc_id, segment, shard) of what later segments have taken away."""
    gone = index.gone().groupBy("doc_id").agg(F.max("segment").alias("upto"))
    return index.lengths().join(maybe_broadcast(gone, FEW), "doc_id").where("segment < upto").select("doc_id", "segment", "shard")


def search_terms(index: Index, asked: DataFrame, k: int = 10, min_score: float = 0.0, group: int = GROUP) -> DataFrame:
    """The same for terms with weights of their own: asked (qid, term, times), each pair once."""
    asked = kept(asked, "asked")
    parts = max(1, -(-asked.select("qid").distinct().count() // group))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
    live, gone = index.live(), index.gone()
    n, avgdl = live.agg(F.count("*"), F.avg("dl")).first()  # documents without a text count, but have no length
    some_gone = not gone.isEmpty()
    df = frequencies(index, asked)
    weight = F.col("times") * F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = kept(asked.join(df, "term").select("part", "qid", "term", weight.alias("w")), "weights")
    places = index.lengths().select("segment", "shard").distinct()  # a row for SHARD documents
    hits = index.postings().join(maybe_broadcast(weights.select("part", "term").distinct(), 100_000), "term")
    side = weights.join(F.broadcast(places)).select("part", "segment", "shard", "qid", "term", "w", F.lit(None).cast("long").alias("doc_id"))
    if some_gone:
        dead = _dead(index).select("segment", "shard", "doc_id")
        side = side.unionByName(dead.join(F.broadcast(weights.select("part").distinct())).select("part", "segment", "shard", "doc_id"), allowMissingColumns=True)
    key = ["part", "segment", "shard"]
    hits = hits.select(*key, "block", "term", "docs", "tfs", "dls", "most", "least")
    hits, side = hits.toDF(*hits.columns), side.toDF(*side.columns)  # both have columns of the index and of the queries
    found = hits.groupBy(*key).cogroup(side.groupBy(*key)).applyInArrow(_shard(float(avgdl or 1.0), k, min_score), "qid long, doc_id long, score double")
    return top(found, k)


def _part(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _shard(avgdl: float, k: int, min_score: float):
    """Scores the documents of a shard for a group of queries, block by block."""

    def run(hits: pa.Table, side: pa.Table) -> pa.Table:
        none = pa.table({"qid": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        asked = side.filter(pc.is_valid(side.column("qid")))
        if not hits.num_rows or not asked.num_rows:
            return none
        dead = side.column("doc_id").drop_null().to_numpy()
        qids, q = np.unique(asked.column("qid").to_numpy(), return_inverse=True)
        words = asked.column("term").combine_chunks().dictionary_encode()
        w = np.zeros((len(words.dictionary), len(qids)))
        w[words.indices.to_numpy(), q] = asked.column("w").to_numpy()
        has = np.zeros(w.shape, np.float32)
        has[words.indices.to_numpy(), q] = 1
        term = pc.index_in(hits.column("term").combine_chunks(), words.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        block = hits.column("block").to_numpy()
        bound = _part(hits.column("most").to_numpy().astype(np.float64), hits.column("least").to_numpy().astype(np.float64), avgdl)
        blocks = np.unique(block)
        most = np.zeros((len(blocks), len(qids)))  # what a document of the block can score at most
        np.add.at(most, np.searchsorted(blocks, block), bound[:, None] * np.maximum(w[term], 0))
        best = Best(len(qids), k)
        for i in np.argsort(-most.max(axis=1), kind="stable"):
            may = np.flatnonzero(most[i] >= best.least - 1e-8)
            if not len(may):
                continue
            rows = np.flatnonzero(block == blocks[i])
            some = hits.take(pa.array(rows))
            size = pc.list_value_length(some.column("docs")).to_numpy()
            doc, tf, dl = (some.column(c).combine_chunks().flatten().to_numpy() for c in ("docs", "tfs", "dls"))
            t = np.repeat(term[rows], size)
            if len(dead):
                keep = ~np.isin(doc, dead)
                doc, tf, dl, t = doc[keep], tf[keep], dl[keep], t[keep]
            if not len(doc):
                continue
            ids, at = np.unique(doc, return_inverse=True)
            use, c = np.unique(t, return_inverse=True)
            x, met = np.zeros((len(ids), len(use))), np.zeros((len(ids), len(use)), np.float32)
            x[at, c], met[at, c] = _part(tf.astype(np.float64), dl.astype(np.float64), avgdl), 1
            s = (x @ w[np.ix_(use, may)]).T
            s[~((met @ has[np.ix_(use, may)]).T > 0) | (s < min_score)] = -np.inf
            best.add(may, ids, s)
            best.settle()
        out = best.batch(qids)
        out = pa.Table.from_batches([out.filter(pc.is_finite(out.column(2)))])
        return out if out.num_rows else none

    return run
