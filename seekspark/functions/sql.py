"""The library's functions for SQL text: `register` makes them known to a session; the optimizer puts their bodies in place of the calls.

Defined results: of a null text the scalar functions and chunkers give null, and the table functions no row. A text without a
piece has no chunk. `fused` leaves out rows without a document or rank, takes a null weight as 0, and gives no row for an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from .text import NON_WORD

#: Pieces of one inner fold of the chunkers, and the lengths of the last pieces after one more.
BLOCK = 256
TAIL = "if(keep > 0, slice(array_append(u.tail, length(w) + 1), greatest(1, size(u.tail) + 2 - keep), keep), u.tail)"
TOKENS = f"filter(split(lower(t), r'{NON_WORD}'), x -> length(x) > 1)"
#: Terms with their counts, from the runs of the sorted tokens: what is counted lies within one row.
COUNTS = f"""transform(array(array_sort({TOKENS})), s -> transform(
      array(if(size(s) = 0, cast(array() as array<int>), filter(sequence(1, size(s)), i -> coalesce(get(s, i - 1) <> get(s, i - 2), true)))),
      at -> transform(at, (a, j) -> struct(get(s, a - 1) as term, cast(coalesce(get(at, j + 1), size(s) + 1) - a as bigint) as tf)))[0])[0]"""
FUNCTIONS = (
    # words as the inverted index takes them
    f"sparse_tokens(t string) returns array<string> return {TOKENS}",
    "jaccard_words(a string, b string) returns double return (with w as (select array_distinct(split(lower(a), ' ')) x, array_distinct(split(lower(b), ' ')) y) select if(size(array_union(x, y)) > 0, size(array_intersect(x, y)) / size(array_union(x, y)), 0) from w)",
    # one arm's share of a fused score: summed over the arms it is reciprocal rank fusion
    "reciprocal_rank(rank int, weight double) returns double return coalesce(weight / (60 + rank), 0D)",
    "bm25_part(tf double, dl double, avgdl double, df double, n double) returns double return ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))",
    "quality(ms double, results double, similarity double, diversity double, success boolean) returns double return if(success and results > 0, least(100D, greatest(0D, if(ms <= 250, 40 * (1 - ms / 250), 0) + if(results >= 6, 25, 25 * results / 6) + 20 * similarity + 15 * diversity)), 0D)",
    # a table function: the overlapping chunks of a text
    """fixed_chunks(t string, size int, overlap int) returns table (chunk_index int, content string)
      return select i, substr(t, i * (size - overlap) + 1, size) from (select explode(sequence(0, greatest(0, cast(ceil((length(t) - overlap) / (size - overlap)) as int) - 1))) i)""",
    f"term_counts(t string) returns array<struct<term: string, tf: bigint>> return {COUNTS}",
    # the body's own expression and not a call, so that it is a generator over the row: a nested query would be joined to the texts again
    f"terms_of(t string) returns table (term string, tf bigint) return select c.term, c.tf from (select explode({COUNTS}) c)",
    # pieces gathered to at most `size` characters, each counted with one more; the last `keep` of a chunk begin the next. Two folds, as in
    # operators/chunking: the inner one's state holds a block's cuts only
    f"""gathered(p array<string>, size int, keep int, sep string) returns array<string> return transform(array(p), x -> aggregate(
      sequence(0, cast(floor(size(x) / {BLOCK}) as int)), struct(cast(array() as array<struct<a: int, b: int>>) as cuts, 0 as a, 0 as used, 0 as n, cast(array() as array<int>) as tail),
      (s, i) -> aggregate(slice(x, i * {BLOCK} + 1, {BLOCK}), struct(cast(array() as array<struct<a: int, b: int>>) as cuts, s.a as a, s.used as used, s.n as n, s.tail as tail),
        (u, w) -> if(u.used + length(w) + 1 > size and u.n > u.a,
          struct(array_append(u.cuts, struct(u.a as a, u.n as b)) as cuts, u.n - size(u.tail) as a, aggregate(u.tail, 0, (c, y) -> c + y) + length(w) + 1 as used, u.n + 1 as n, {TAIL} as tail),
          struct(u.cuts as cuts, u.a as a, u.used + length(w) + 1 as used, u.n + 1 as n, {TAIL} as tail)),
        u -> struct(concat(s.cuts, u.cuts) as cuts, u.a as a, u.used as used, u.n as n, u.tail as tail)),
      s -> transform(if(s.n > s.a, array_append(s.cuts, struct(s.a as a, s.n as b)), s.cuts), c -> array_join(slice(x, c.a + 1, c.b - c.a), sep))))[0]""",
    r"word_chunks(t string, size int, overlap int) returns array<string> return gathered(filter(split(t, r'[ \t\r\n]+'), x -> x <> ''), size, overlap div 10, ' ')",
    r"sentence_chunks(t string, size int) returns array<string> return gathered(filter(transform(split(t, r'(?<=[.!?\n])(?!\p{Ll})'), x -> trim(x)), x -> x <> ''), size, 1, ' ')",
    r"paragraph_chunks(t string, size int, overlap int) returns array<string> return gathered(filter(transform(split(t, r'\n[ \t]*\n'), x -> trim(x)), x -> x <> ''), size, if(overlap > 0, 1, 0), '\n\n')",
)


@arrow_udtf(returnType="qid long, doc_id long, score double, rank int")
class Fused:
    """fused(table(...) partition by (qid), k): the k best of each query's ranked lists (qid, doc_id, rank, weight) by the sum of
    weight / (60 + rank). Scores equal to nine digits tie, then the smaller id comes first. A partition is what the arms found for a
    query; its rows are summed as they come, so the state holds a number for each document found."""

    def __init__(self) -> None:
        self.qid, self.k, self.sums = None, 0, pa.table({"doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def eval(self, rows: pa.RecordBatch, k: pa.Array) -> Iterator[pa.Table]:
        if rows.num_rows:
            self.qid, self.k = rows.column("qid")[0].as_py(), k[0].as_py()
            part = pc.divide(pc.fill_null(rows.column("weight").cast(pa.float64()), 0.0), pc.add(rows.column("rank").cast(pa.float64()), 60.0))
            both = pa.table({"doc_id": rows.column("doc_id").cast(pa.int64()), "score": part})
            both = both.filter(pc.and_(pc.is_valid(both["doc_id"]), pc.is_valid(both["score"])))
            sums = pa.concat_tables([self.sums, both]).group_by("doc_id").aggregate([("score", "sum")])
            self.sums = sums.select(["doc_id", "score_sum"]).rename_columns(["doc_id", "score"])
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        best = self.sums.append_column("r", pc.round(self.sums["score"], 9)).sort_by([("r", "descending"), ("doc_id", "ascending")]).slice(0, self.k)
        n = best.num_rows
        if n:
            yield pa.table({"qid": pa.array([self.qid] * n, pa.int64()), "doc_id": best["doc_id"], "score": best["score"], "rank": pa.array(range(1, n + 1), pa.int32())})


def register(spark: SparkSession) -> None:
    for f in FUNCTIONS:
        spark.sql(f"create or replace temporary function {f}")
    spark.udtf.register("fused", Fused)
