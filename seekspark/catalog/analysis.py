"""Queries on query analysis, reranking, context, self-reflection and evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import relevance
from ..operators import analyze, chunking, context, nearest, rerank
from ..plans import search, selfrag
from ..sources.shared import kept
from ..sources.tables import documents, hybrid_corpus, queries, table, vectors
from . import query
from .fragments import CHUNK_SQL, CORPUS, RRF, SPACED, VECS, bm25, dense, fused, words

A = analyze
r6 = lambda c: F.round(c, 6).alias(c)


def among(t: str, xs: list[str]) -> str:
    return f"len(list_filter({t}, lambda x: list_contains({words(xs)}, x)))"


def inside(c: str, xs: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({c}), '{x.lower()}')" for x in xs) + ")"


# --- query analysis ---

SAMPLES = [
    "What is machine learning?",
    "compare SQL and JSON",
    "how does the API differ before and after",
    "find recent papers",
    "AI",
    "explain neural network or deep learning because why",
    "어떻게 알고리즘 비교",
    "x AND y",
    "Why and then how not",
]
USER = f"""asks as (select conv_id, turn, text from conversations where role = 'user' union all
  select -row_number() over (), 0, v from (select unnest({words(SAMPLES)}) as v))"""


def user_turns(spark, d):
    """User turns of the conversations, and nine questions that reach the other branches."""
    own = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    more = spark.createDataFrame([(-i - 1, 0, t) for i, t in enumerate(SAMPLES)], "conv_id long, turn long, text string")
    return own.unionByName(more)


STEPS = rf"""a1 as (select *, list_filter(regexp_split_to_array(lower(text), '[\s.,;:!?()"'']'), lambda x: length(x) > 0) as t from asks),
a2 as (select *, len(t) as n, {among('t', A.QUESTION_WORDS)} as q, {among('t', A.TECHNICAL_WORDS)} as te, {among('t', A.LOGICAL_WORDS)} as lo,
  {among('t', A.COMPARISON_WORDS)} > 0 as co, {among('t', A.TEMPORAL_WORDS)} > 0 as tm,
  ({inside('text', A.REASONING_PHRASES)} or {among('t', A.REASONING_WORDS)} > 0) as re, {among('t', A.DETAIL_WORDS)} > 0 as de from a1),
a3 as (select *, ({inside('text', A.MULTI_HOP_PHRASES)} or lo > 1) as mh,
  te + {' + '.join(f"cast(contains(lower(text), '{p}') as int)" for p in A.TECHNICAL_PHRASES)} as tt from a2),
a4 as (select *, case when q > 0 and mh then 'MultiHopQuery' when q > 0 and co then 'ComparisonQuery' when q > 0 and tm then 'TemporalQuery'
  when q > 0 and re then 'ReasoningQuery' when q > 0 then 'NaturalQuestion'
    when lo > 0 or contains(text, 'AND') or contains(text, 'OR') then 'ComplexSearch' when co then 'ComparisonQuery' when re then 'ReasoningQuery'
  else 'SimpleKeyword' end as type,
  case when n > 10 then 2 when n > 5 then 1 else 0 end + case when q > 1 then 2 when q > 0 then 1 else 0 end + case when tt > 2 then 3
  when tt > 1 then 2 when tt > 0 then 1 else 0 end
  + case when de then 2 else 0 end + case when lo > 0 then 1 else 0 end + cast(co as int) + cast(tm as int) + 2 * cast(mh as int) + 2 * cast(re as
  int) as points,
  case when n > 0 then least(1.0, (len(list_distinct(t)) / n + te / n) / 2) else 0 end as specificity,
  least(1.0, greatest(0.1, 0.5 + case when n between 2 and 15 then 0.2 else 0 end + case when q > 0 then 0.1 else 0 end + case when te > 0 then 0.1
  else 0 end - case when n < 2 then 0.2 else 0 end - case when n > 20 then 0.1 else 0 end)) as confidence,
  least(10000, 500 + 10 * n + 1000 * cast(re as int) + 1500 * cast(mh as int) + 500 * cast(co as int)) as ms from a3),
a5 as (select *, case when points <= 1 then 'Simple' when points <= 3 then 'Moderate' when points <= 5 then 'Complex'
  else 'VeryComplex' end as complexity from a4),
a6 as (select *, case complexity when 'Simple' then 'DirectVector' when 'Moderate' then case when co then 'MultiQuery' else 'Hybrid' end
  when 'Complex' then case when re then 'TwoStage' when mh then 'MultiQuery' else 'Hybrid' end
  else case when mh and re then 'SelfRAG' when re then 'TwoStage' else 'Adaptive' end end as recommended from a5)"""
ANALYSIS = f"{USER}, {STEPS}"


@query(f"""with {ANALYSIS} select conv_id, turn, type, cast(points as int) as points, complexity, round(specificity, 6) as specificity,
  round(confidence, 6) as confidence, cast(ms as int) as estimated_ms, re as reasoning, mh as multi_hop from a6""")
def query_analysis(spark, d):
    return A.analysis(user_turns(spark, d)).select("conv_id", "turn", "type", F.col("points").cast("int").alias("points"), "complexity", r6("specificity"), r6("confidence"), F.col("estimated_ms").cast("int").alias("estimated_ms"), "reasoning", "multi_hop")


@query(f"""with {ANALYSIS} select conv_id, turn, recommended, case when confidence >= 0.8 - 1e-9 then case when type in ('SimpleKeyword',
  'NaturalQuestion') then 'DirectVector' when type = 'ComplexSearch' then 'Hybrid' when type = 'ReasoningQuery' then 'Adaptive'
when type = 'ComparisonQuery' then 'MultiQuery' when type = 'TemporalQuery' then 'TwoStage' else 'SelfRAG' end else recommended end as strategy
  from a6""")
def strategy_recommend(spark, d):
    x = A.analysis(user_turns(spark, d)).withColumn("confidence", F.round("confidence", 9))
    return x.select("conv_id", "turn", "recommended", A.strategy().alias("strategy"))


@query(f"""with {ANALYSIS} select conv_id, turn, case when q > 0 then 'Informational' when co or len(list_filter(t, lambda x: contains(x,
  'analyz'))) > 0 then 'Analytical' when len(list_filter(t, lambda x: contains(x, 'find') or contains(x, 'search'))) > 0 then 'Exploratory'
  else 'Informational' end as intent,
cast(len(list_filter(t, lambda x: not list_contains({words(A.STOP_WORDS)}, x) and length(x) > 2)) as int) as keywords, cast(len(list_filter(t,
  lambda x: list_contains({words(A.TECHNICAL_WORDS)}, x) or length(x) > 6)) as int) as concepts from a6""")
def query_intent(spark, d):
    return A.analysis(user_turns(spark, d)).select("conv_id", "turn", "intent", F.size("keywords").alias("keywords"), F.size("concepts").alias("concepts"))


@query(f"""with {USER} select conv_id, turn, case when len({SPACED}) <= 2 then 'SparseFirst' when len({SPACED}) <= 5 then 'Balanced'
  else 'VectorFirst' end as strategy, case when len({SPACED}) <= 2 then 0.3 when len({SPACED}) <= 5 then 0.6 else 0.8 end as vector_weight, case
  when len(list_filter({SPACED}, lambda x: regexp_matches(lower(x), 'api|http|json|sql|ai|ml'))) > 0 then 'WeightedSum' else 'RRF' end as method
  from asks""")
def auto_strategy(spark, d):
    return user_turns(spark, d).select("conv_id", "turn", search.auto_strategy(F.col("text")).alias("s")).select("conv_id", "turn", "s.*")


SMALL = f"""{USER}, b1 as (select *, {SPACED} as w, length(text) as len, length(text) - length(regexp_replace(text, '\\p{{P}}', '', 'g')) as p
  from asks),
b2 as (select *, len(w) as n, len(list_distinct(list_transform(w, lambda x: lower(x)))) as u, len(list_filter(w, lambda x: regexp_matches(x,
  '(?i){'|'.join(A.SMALL_TECHNICAL)}'))) as te, len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}') and length(x) > 1)) as e,
  len(list_filter(w, lambda x: list_contains({words(A.SMALL_QUESTIONS)}, lower(x)))) as q, {among('w', A.SMALL_LOGICAL)} as lo,
  coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as chars from b1),
b3 as (select *, greatest(1, n) as m, (u / greatest(1, n) + least(1.0, chars / greatest(1, n) / 10) + least(1.0, 3 * te / greatest(1,
  n))) / 3 as lexical, (least(1.0, 10 * case when len > 0 then p / len else 0 end) + least(1.0, n / 20) + least(1.0, 5 * lo / greatest(1,
  n))) / 3 as syntactic,
  (least(1.0, 2 * e / greatest(1, n)) + least(1.0, 3 * te / greatest(1, n)) + u / greatest(1, n)) / 3 as semantic, (least(1.0, 5 * q / greatest(1,
  n)) + least(1.0, 3 * lo / greatest(1, n)) + least(1.0, n / 15)) / 3 as reasoning from b2),
b4 as (select *, 0.2 * lexical + 0.3 * syntactic + 0.3 * semantic + 0.2 * reasoning as overall from b3),
b5 as (select *, round(overall, 9) as o from b4)"""


@query(f"""with {SMALL} select conv_id, turn, round(lexical, 6) as lexical, round(syntactic, 6) as syntactic, round(semantic, 6) as semantic,
  round(reasoning, 6) as reasoning, round(overall, 6) as overall,
cast(least(10, greatest(1, case when o <= 0.2 then 1 when o <= 0.4 then 2 when o <= 0.6 then 4 when o <= 0.8 then 6 else 8 end + case
  when te > 0 then 1 else 0 end + case when e > 2 then 1 else 0 end + case when q > 0 then 1 else 0 end + case when lo > 0 then 2
  else 0 end)) as int) as "window" from b5""")
def query_complexity(spark, d):
    return A.components(user_turns(spark, d)).select("conv_id", "turn", *(r6(c) for c in ("lexical", "syntactic", "semantic", "reasoning", "overall")), F.col("window").cast("int").alias("window"))


@query(f"""with {SMALL}, b6 as (select *, case when o <= 0.3 then 'Conservative' when o <= 0.6 then 'Balanced' when o <= 0.8 then 'Aggressive'
  else 'Adaptive' end as expansion,
'Sequential' || case when round(semantic, 9) > 0.5 then ',Semantic' else '' end || case when e > 0 then ',Entity' else '' end || case
  when round(reasoning, 9) > 0.6 then ',Hierarchical' else '' end as methods from b5)
select conv_id, turn, expansion, methods, round(least(1.0, 0.8 + case when n >= 3 then 0.1 else 0 end + case when u >= 2 then 0.1 else 0 end),
  6) as confidence, case expansion when 'Conservative' then 0.02 when 'Balanced' then 0.05 when 'Aggressive' then 0.08
  else 0.06 end as precision_gain,
round(0.1 * len(string_split(methods, ',')), 6) as latency_increase, round(least(1.0, case expansion when 'Conservative' then 0.7
  when 'Balanced' then 0.8 when 'Aggressive' then 0.85 else 0.9 end + 0.1 * overall), 6) as satisfaction from b6""")
def expansion_strategy(spark, d):
    return A.components(user_turns(spark, d)).select("conv_id", "turn", "expansion", F.array_join("methods", ",").alias("methods"), r6("confidence"), "precision_gain", r6("latency_increase"), r6("satisfaction"))


@query(f"""with {USER}, e as (select conv_id, turn, text as e0, case when contains(text, 'machine learning') then replace(text, 'machine learning',
  'ML') end as e1, case when contains(text, 'machine learning') then replace(text, 'machine learning', 'artificial intelligence') end as e2,
case when contains(text, 'neural network') then replace(text, 'neural network', 'deep learning') end as e3, case when contains(text,
  'neural network') then replace(text, 'neural network', 'artificial neural network') end as e4 from asks)
select conv_id, turn, array_to_string(list_filter([e0, e1, e2, e3, e4], lambda x: x is not null)[1:3], '|') as expansions from e""")
def query_expansions(spark, d):
    return user_turns(spark, d).select("conv_id", "turn", F.array_join(A.expansions(F.col("text")), "|").alias("expansions"))


@query(f"""with {USER} select conv_id, turn, case when len({SPACED}) <= 3 and not ({inside('text', ['분석', '비교', '설명'])}) then 'Easy'
  when len({SPACED}) <= 7 and not ({inside('text', ['분석', '비교', '설명'])}) and {inside('text', ['왜', '어떻게', '무엇'])} then 'Medium'
when len({SPACED}) > 7 or {inside('text', ['분석', '비교', '설명'])} then 'Hard' else 'Medium' end as difficulty from asks""")
def query_difficulty(spark, d):
    return user_turns(spark, d).select("conv_id", "turn", A.difficulty(F.col("text")).alias("difficulty"))


@query(f"""with {USER} select conv_id, turn, trim(replace(replace(replace(text, ' 구체적인 ', ' '), ' 특정 ', ' '),
  ' 정확한 ', ' ')) as generalized, case when contains(lower(text), '최근') or contains(lower(text),
  'recent') then text else '최근 ' || text end as specified,
text || ' 상세 정보 설명' as with_context, case when len(string_split(text, ' ')) > 2 then array_to_string(list_concat(string_split(text, ' ')[-1:],
  string_split(text, ' ')[:-2]), ' ') else text end as restructured from asks""")
def query_rewrites(spark, d):
    t = F.col("text")
    return user_turns(spark, d).select("conv_id", "turn", A.generalized(t).alias("generalized"), A.specified(t).alias("specified"), A.with_context(t).alias("with_context"), A.restructured(t).alias("restructured"))


# --- reranking ---

RT = r"list_filter(regexp_split_to_array(lower({}), '[ \t\n\r.,;:!?]'), lambda x: length(x) > 1)"
RERANK = f"""{CORPUS}, {dense(20)},
c as (select d.qid, d.doc_id, d.rank, {RT.format('a.text')} as qt, {RT.format('substr(c.text, 1, 1024)')} as ct, length(substr(c.text, 1,
  1024)) as chars from dense d join asked a using (qid) join corpus c using (doc_id)),
qf as (select qid, term, count(*) as f from (select qid, unnest({RT.format('text')}) as term from asked) group by all),
cf as (select qid, doc_id, term, count(*) as f from (select qid, doc_id, unnest(ct) as term from c) group by all),
qn as (select qid, sqrt(sum(power(1 + ln(f), 2))) as n from qf group by qid), cn as (select qid, doc_id, sqrt(sum(power(1 + ln(f), 2))) as n from cf
  group by all),
d as (select cf.qid, doc_id, sum((1 + ln(qf.f)) * (1 + ln(cf.f))) as dot, sum(ln(1000.5 / 1.5) * cf.f * 2.2 / (cf.f + 1.2 * (0.25 + 0.75 * chars /
  100))) as bm from cf join qf using (qid, term) join c using (qid, doc_id) group by all),
s as (select c.qid, c.doc_id, c.rank, coalesce(dot / (qn.n * cn.n), 0) as tfidf, coalesce(greatest(0, bm / len(qt)), 0) as bm25
  from c left join d using (qid, doc_id) left join qn using (qid) left join cn using (qid, doc_id)),
z as (select *, least(1.0, greatest(0.0, 0.4 * tfidf + 0.3 * bm25 + greatest(0, (10 - rank) * 0.01))) as score from s)"""


def candidates(spark, d):
    corpus, asked = hybrid_corpus(spark, d), queries(spark, d)
    return asked, nearest.knn(corpus, asked, 20).drop("score").join(corpus.select("doc_id", "text"), "doc_id")


@query(f"""with {RERANK} select qid, doc_id, cast(rank as int) as rank, cast(row_number() over (partition by qid order by round(score, 9) desc,
  rank) as int) as new_rank, round(score, 6) as score from z qualify new_rank <= 10""")
def local_rerank(spark, d):
    asked, found = candidates(spark, d)
    return rerank.local(asked, found).select("qid", "doc_id", "rank", "new_rank", r6("score"))


@query(f"with {RERANK} select qid, doc_id, round(tfidf, 6) as tfidf, round(bm25, 6) as bm25 from z")
def tfidf_cosine(spark, d):
    asked, found = candidates(spark, d)
    return rerank.local(asked, found, k=20).select("qid", "doc_id", r6("tfidf"), r6("bm25"))


# --- context ---

HITS = f"{CORPUS}, {dense(10)}, {CHUNK_SQL}, hits as (select qid, doc_id || '#0' as chunk_id, score from dense)"
SETS = "sets as (select *, list_distinct(list_filter(string_split(lower(content), ' '), lambda x: x <> '')) as s from chunks)"
J = "len(list_intersect({0}, {1})) / greatest(1, len(list_distinct(list_concat({0}, {1}))))"
EDGES = f"""{SETS}, edges as (select a.chunk_id as src, b.chunk_id as dst, 'Semantic' as type, {J.format('a.s', 'b.s')} as strength
  from sets a join sets b on a.document_id = b.document_id and a.chunk_index < b.chunk_index where {J.format('a.s', 'b.s')} > 0.7)"""


def all_chunks(spark, d):
    return chunking.chunk(documents(spark, d)).drop("metadata", "total_chunks", "token_count")


def chunk_hits(spark, d):
    """The chunks of the documents that a vector search finds for the benchmark queries, and of each the first chunk as hit."""
    found = kept(nearest.knn(hybrid_corpus(spark, d), queries(spark, d), 10), "hits")
    docs = documents(spark, d).join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    c = kept(chunking.chunk(docs).drop("metadata", "total_chunks", "token_count"), "chunks")
    return c, found.select("qid", F.concat("doc_id", F.lit("#0")).alias("chunk_id"), "score")


@query(f"""with {HITS} select h.qid, b.chunk_id, round(0.8 * h.score, 6) as score from hits h join chunks a using (chunk_id)
  join chunks b on a.document_id = b.document_id and abs(a.chunk_index - b.chunk_index) = 1""")
def contextual_neighbors(spark, d):
    c, hits = chunk_hits(spark, d)
    return context.neighbours(hits, c).select("qid", "chunk_id", r6("score"))


@query(f"with {CHUNK_SQL}, {EDGES} select src, dst, round(strength, 6) as strength from edges")
def semantic_edges(spark, d):
    return context.semantic_edges(all_chunks(spark, d)).select("src", "dst", r6("strength"))


@query(f"""with {HITS}, {EDGES}, ends as (select src as a, dst as b, strength from edges union all select dst, src, strength from edges)
  select qid, b as chunk_id, round(score * strength * 0.7, 6) as score from hits join ends on chunk_id = a
  qualify row_number() over (partition by qid, a order by strength desc, b) <= 3""")
def related_chunks(spark, d):
    c, hits = chunk_hits(spark, d)
    return context.related(hits, context.near_edges(hits, c), ["Semantic", "Reference"]).select("qid", "chunk_id", r6("score"))


@query(f"""with {CHUNK_SQL} select chunk_id, document_id || '#g' || (chunk_index // 4) as parent_id,
cast(coalesce(sum(length(content)) over (partition by document_id order by chunk_index rows between unbounded preceding and 1 preceding), 0) as bigint) as start
from chunks""")
def chunk_hierarchy(spark, d):
    return context.hierarchy(all_chunks(spark, d)).select("chunk_id", "parent_id", "start")


NODES = f"""{CHUNK_SQL}, g as (select document_id, chunk_index // 4 as g, count(*) as n from chunks group by all),
  r as (select document_id, count(*) as n from g group by all),
nodes as (select chunk_id as node_id, document_id || '#g' || (chunk_index // 4) as parent_id, 2 as level, 0 as n from chunks union all
  select document_id || '#g' || g, cast(document_id as varchar), 1, n from g where document_id % 50 <> 3 or g <> 0
  union all select cast(document_id as varchar), null, 0, n from r)"""


def nodes(spark, d):
    """The tree of all chunks; the first group of every fiftieth document is missing, so that there are orphans."""
    tree = context.with_groups(context.hierarchy(all_chunks(spark, d)))
    return tree.where("not (level = 1 and cast(parent_id as long) % 50 = 3 and node_id like '%#g0')")


@query(f"""with {NODES} select count(*) as nodes, cast(max(level) as int) as depth, count(*) filter (parent_id is null) as roots,
  count(*) filter (parent_id is not null and parent_id not in (select node_id from nodes)) as orphans,
count(*) filter (n = 0) as leaves, round(avg(n) filter (n > 0), 6) as branching from nodes""")
def hierarchy_stats(spark, d):
    return context.hierarchy_stats(nodes(spark, d)).select("nodes", "depth", "roots", "orphans", "leaves", r6("branching"))


@query(f"with {NODES} select cast(level as int) as level, count(*) as n from nodes group by level")
def level_distribution(spark, d):
    return context.level_distribution(nodes(spark, d))


@query(f"""with {NODES} select node_id, parent_id, cast(level as int) as level from nodes where parent_id in (select cast(doc_id as varchar)
  from documents where doc_id % 20 = 0)""")
def hierarchy_children(spark, d):
    parents = documents(spark, d).where("doc_id % 20 = 0").select(F.col("doc_id").cast("string").alias("node_id"))
    return context.children(nodes(spark, d), parents).select("node_id", "parent_id", "level")


@query(f"""with {CHUNK_SQL}, leaves as (select chunk_id, document_id, coalesce(sum(length(content)) over (partition by document_id
  order by chunk_index rows between unbounded preceding and 1 preceding), 0) as start from chunks)
  select chunk_id, cast(row_number() over (partition by document_id order by start) as int) as place from leaves""")
def hierarchy_level(spark, d):
    """The chunks of a level of each document in order of their place in it."""
    return context.level(context.hierarchy(all_chunks(spark, d)), 1).select("chunk_id", "place")


ALL_EDGES = f"""{CHUNK_SQL}, {EDGES}, linked as (select src, dst, 'Semantic' as type, strength from edges union all
  select chunk_id, lead(chunk_id) over (partition by document_id order by chunk_index), 'Sequential', 0.8 from chunks
  qualify lead(chunk_id) over (partition by document_id order by chunk_index) is not null)"""


def linked(spark, d):
    c = all_chunks(spark, d)
    return c, context.semantic_edges(c).unionByName(context.sequential_edges(c))


@query(f"""with {ALL_EDGES} select type, count(*) as n, round(avg(strength), 6) as mean, round(min(strength), 6) as low, round(max(strength),
  6) as high from linked group by type""")
def edge_stats(spark, d):
    c, edges = linked(spark, d)
    return context.edge_stats(edges, c).select("type", "n", r6("mean"), r6("low"), r6("high"))


@query(f"""with {ALL_EDGES}, ends as (select src as chunk_id, dst as other, type, strength from linked union all select dst, src, type, strength
  from linked) select chunk_id, other, type, round(strength, 6) as strength, cast(row_number() over (partition by chunk_id order by strength desc,
  other, type) as int) as place from ends where type in ('Sequential', 'Semantic') and chunk_id like '%#0'""")
def relationship_filter(spark, d):
    """The edges of every document's first chunk, strongest first."""
    c, edges = linked(spark, d)
    return context.relationships(edges, c.where("chunk_index = 0"), ["Sequential", "Semantic"]).select("chunk_id", "other", "type", r6("strength"), "place")


@query(f"""with {ALL_EDGES}, h as (select document_id, count(*) as n from chunks group by document_id), e as (select document_id, count(*) as m
  from linked join chunks on src = chunk_id group by document_id) select h.document_id, round(least(1.0, coalesce(m, 0) / n / 2), 6) as quality
  from h left join e using (document_id)""")
def hierarchy_quality(spark, d):
    c, edges = linked(spark, d)
    n = c.groupBy("document_id").agg(F.count("*").alias("n"))
    m = edges.join(c.selectExpr("chunk_id src", "document_id"), "src").groupBy("document_id").agg(F.count("*").alias("m"))
    return n.join(m, "document_id", "left").select("document_id", F.round(context.hierarchy_quality(F.col("n"), F.coalesce("m", F.lit(0))), 6).alias("quality"))


EXPANDED = f"""{HITS}, {EDGES}, ends as (select src as a, dst as b, strength from edges union all select dst, src, strength from edges),
pt as (select h.qid, h.chunk_id as pri, c.document_id, c.chunk_index, c.s as own, c.content as owntext from hits h join sets c using (chunk_id)),
near as (select pt.*, o.chunk_id, o.chunk_index as oi, o.content, o.s, abs(o.chunk_index - pt.chunk_index) as gap
  from pt join sets o using (document_id) where o.chunk_id <> pri),
f as (select qid, pri, own, chunk_id, content, s, 'Hierarchical' as method from near where oi // 4 = chunk_index // 4
  qualify row_number() over (partition by qid, pri order by oi) <= 2
  union all select qid, pri, own, chunk_id, content, s, 'Sequential' from near where gap <= 3 qualify row_number() over (partition by qid, pri
  order by gap, oi) <= 3
  union all select qid, pri, own, o.chunk_id, o.content, o.s, 'Semantic' from pt join ends on a = pri join sets o on o.chunk_id = b
  qualify row_number() over (partition by qid, pri order by strength desc, b) <= 1),
q as (select *, 0.5 * {J.format('s', 'own')} + 0.3 * least(1.0, length(content) / 500) + 0.2 as quality from f),
u as (select * from q where round(quality, 9) >= 0.5 qualify row_number() over (partition by qid, pri, chunk_id order by method) = 1),
expanded as (select * from u qualify row_number() over (partition by qid, pri order by round(quality, 9) desc, chunk_id) <= 6)"""


def expansion(spark, d):
    c, hits = chunk_hits(spark, d)
    return c, hits, context.expand(hits, c, context.near_edges(hits, c))


@query(f"with {EXPANDED} select qid, pri as \"primary\", chunk_id, method, round(quality, 6) as quality from expanded")
def context_expand(spark, d):
    return expansion(spark, d)[2].select("qid", "primary", "chunk_id", "method", r6("quality"))


REL = """len(list_filter(list_filter(string_split(lower(asked.text), ' '), lambda x: x <> ''), lambda x: list_contains(list_filter(string_split(lower({}), ' '), lambda y: y <> ''), x)))
  / greatest(1, len(list_filter(string_split(lower(asked.text), ' '), lambda x: x <> '')))"""


@query(f"""with {EXPANDED}, ctx as (select qid, pri, count(*) as n, avg({REL.format('content')}) as r from expanded join asked using (qid) group by qid, pri)
select pt.qid, pt.pri as "primary", coalesce(n, 0) as context_size, round(0.7 * {REL.format('owntext')} + 0.3 * coalesce(r, 0), 6) as relevance
from pt join asked on pt.qid = asked.qid left join ctx on pt.pri = ctx.pri and pt.qid = ctx.qid""")
def small_to_big(spark, d):
    c, hits, found = expansion(spark, d)
    return context.small_to_big(found, hits, c, queries(spark, d)).select("qid", "primary", "context_size", r6("relevance"))


DIVERSE = f"""{EXPANDED}, few as (select *, list_filter(string_split(lower(content), ' '), lambda x: x <> '') as w from expanded
  qualify row_number() over (partition by qid, pri order by chunk_id) <= 10),
pj as (select a.qid, a.pri, avg({J.format('a.s', 'b.s')}) as j from few a join few b on a.qid = b.qid and a.pri = b.pri and a.chunk_id < b.chunk_id
  group by a.qid, a.pri),
dv as (select few.qid, few.pri, count(*) as n, coalesce(1 - any_value(j),
  0) as diversity, 1 - len(list_distinct(flatten(list(w)))) / len(flatten(list(w))) as redundancy, avg(quality) as mean
  from few left join pj on few.qid = pj.qid and few.pri = pj.pri group by few.qid, few.pri)"""


@query(f"with {DIVERSE} select qid, pri as \"primary\", cast(n as int) as n, round(diversity, 6) as diversity, round(redundancy, 6) as redundancy from dv")
def context_diversity(spark, d):
    return context.diversity(expansion(spark, d)[2], ["qid", "primary"]).select("qid", "primary", "n", r6("diversity"), r6("redundancy"))


@query(f"""with {DIVERSE} select qid, pri as "primary", n, round(0.7 * mean + 0.3 * diversity, 6) as quality,
  round((0.7 * mean + 0.3 * diversity) / 2, 6) as efficiency from dv""")
def expansion_quality(spark, d):
    return context.set_quality(expansion(spark, d)[2], F.lit(2.0)).select("qid", "primary", "n", r6("quality"), r6("efficiency"))


@query(f"""with {EXPANDED}, rows as (select qid, chunk_id as pri, 0 as o, chunk_id, content from hits join chunks using (chunk_id) union all
  select qid, pri, 1, chunk_id, content from expanded)
select qid, pri as "primary", sha256(string_agg(content, chr(10) || chr(10) order by o, chunk_id)) as hash from rows group by qid, pri""")
def combined_text(spark, d):
    c, hits, found = expansion(spark, d)
    return context.combined(found, hits, c).select("qid", "primary", F.sha2("text", 256).alias("hash"))


ROUND_UP = """a as (select qid, chunk_id, score from hits union all select h.qid, b.chunk_id, 0.8 * h.score from hits h join chunks a using (chunk_id)
  join chunks b on a.document_id = b.document_id and abs(a.chunk_index - b.chunk_index) = 1 {}),
m as (select qid, chunk_id, max(score) as score from a group by qid, chunk_id), t as (select * from m qualify row_number() over (partition by qid
  order by round(score, 9) desc, chunk_id) <= {})
select qid, chunk_id, round(case when max(score) over w > min(score) over w then (score - min(score) over w) / nullif(max(score) over w - min(score)
  over w, 0) else score end, 6) as score from t window w as (partition by qid)"""


@query(f"with {HITS}, " + ROUND_UP.format("", 50))
def dedupe_rebalance(spark, d):
    c, hits = chunk_hits(spark, d)
    return context.rebalance(hits.unionByName(context.neighbours(hits, c)), 50).select("qid", "chunk_id", r6("score"))


@query(f"with {HITS}, {EDGES}, ends as (select src as a, dst as b, strength from edges union all select dst, src, strength from edges), " + ROUND_UP.format("""
          
  union all select qid, b, score * strength * 0.7 from (select qid, a, b, score, strength from hits join ends on chunk_id = a
  qualify row_number() over (partition by qid, a order by strength desc, b) <= 3)""", 20))
def contextual_search(spark, d):
    """A search's hits with their neighbours and what they are related to: the best score of each chunk, stretched to 0..1."""
    c, hits = chunk_hits(spark, d)
    return context.contextual(hits, c, 20).select("qid", "chunk_id", r6("score"))


@query(f"""with {CORPUS}, {dense(20)}, s as (select qid, 2 * rank + copy as rank, doc_id + 1000000 * copy as doc_id,
  list_distinct(string_split(lower(text), ' ')) as s from dense join corpus using (doc_id), (select unnest([0, 1]) as copy))
  select a.qid, a.doc_id as kept, b.doc_id as duplicate from s a join s b on a.qid = b.qid and a.rank < b.rank where {J.format('a.s', 'b.s')} > 0.8""")
def near_duplicates(spark, d):
    """Pairs of results that are too alike; each result is there twice, so that there are some."""
    corpus = hybrid_corpus(spark, d)
    hits = nearest.knn(corpus, queries(spark, d), 20).join(corpus.select("doc_id", "text"), "doc_id").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    hits = hits.select("qid", (2 * F.col("rank") + F.col("copy")).alias("rank"), (F.col("doc_id") + 1_000_000 * F.col("copy")).alias("doc_id"), "text")
    return context.duplicates(hits)


GREEDY = f"""{CORPUS}, {dense(20)}, gs as (select qid, rank, doc_id, list_distinct({SPACED.replace('(text', '(lower(text)')}) as s
  from dense join corpus using (doc_id)),
g as (select distinct qid, 0::bigint as r, []::bigint[] as ids, []::varchar[][] as sets from gs union all
  select g.qid, g.r + 1, case when dup then ids else list_append(ids, rank) end, case when dup then sets else list_append(sets, s) end
  from g join (select *, rank as rk from gs) x on x.qid = g.qid and x.rk = g.r + 1, lateral (select len(list_filter(g.sets,
  lambda y: {J.format('y', 'x.s')} >= 0.5)) > 0 as dup))"""


@query(f"""with recursive {GREEDY} select g.qid, cast(gs.rank as int) as rank, cast(doc_id as varchar) as chunk_id
  from (select qid, unnest(ids) as rank from g qualify r = max(r) over (partition by qid)) g join gs on g.qid = gs.qid and g.rank = gs.rank""")
def greedy_dedupe(spark, d):
    corpus = hybrid_corpus(spark, d)
    hits = nearest.knn(corpus, queries(spark, d), 20).join(corpus.select("doc_id", F.col("text").alias("content")), "doc_id")
    return context.greedy_distinct(hits.withColumn("chunk_id", F.col("doc_id").cast("string")), ["qid"], 0.5)


# --- adaptive and self-reflective search ---


MORE = f"""{VECS}, corpus as (select doc_id, text, vec from documents left join vecs using (doc_id)),
asked as (select item_id as qid, text, vec from benchmark join vecs on item_id = doc_id union all select 100000 + i, q[i], vec
  from (select unnest(range(1, {len(SAMPLES) + 1})) as i, {words(SAMPLES)} as q) join vecs on doc_id = i)"""


def more_queries(spark, d):
    """The benchmark queries, and nine that reach the other strategies."""
    few = spark.createDataFrame([(100_001 + i, t, i + 1) for i, t in enumerate(SAMPLES)], "qid long, text string, i long")
    return queries(spark, d).unionByName(few.join(vectors(spark, d).withColumnRenamed("doc_id", "i"), "i").select("qid", "text", "vec"))


def multi_sql(asked: str, p: str, k: int = 10) -> str:
    """CTEs that end in {p}multi: qid, doc_id, rank, score."""
    made = ["text", *(f"case when contains(text, '{a}') then replace(text, '{a}', '{b}') end" for a, b in A.EXPANSIONS)]
    return f"""{p}ex as (select qid * 8 + i - 1 as qid, xs[i] as text, vec from (select *, list_filter([{", ".join(made)}],
  lambda x: x is not null)[1:3] as xs from {asked}), (select unnest([1, 2, 3]) as i) where i <= len(xs)),
{prefixed(p + "m", f"{dense()}, {bm25()}, {fused(RRF, k=k)}", p + "ex")},
{p}multi as (select qid // 8 as qid, doc_id, score, row_number() over (partition by qid // 8 order by qid % 8, rank) as rank from (select *
  from {p}mfused qualify row_number() over (partition by qid // 8, doc_id order by qid % 8, rank) = 1) qualify rank <= {k})"""


def prefixed(p: str, sql: str, asked: str) -> str:
    """CTEs with other names, over other queries."""
    names = ["sims", "dense", "toks", "post", "dfs", "st", "qt", "scored", "sparse", "pairs", "fused"]
    sql = re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: p + m[1], sql)
    return re.sub(r"\basked\b", asked, sql)


def second_sql(wide: str, asked: str, k: int) -> str:
    t = "list_filter(string_split(lower({}), ' '), lambda {}: {} <> '')"
    q, c = t.format(asked + ".text", "x", "x"), t.format("corpus.text", "y", "y")
    return f"""select {wide}.qid, {wide}.doc_id, 0.7 * len(list_filter({q}, lambda x: list_contains({c}, x))) / greatest(1,
  len({q})) + 0.3 * score as score from {wide} join corpus using (doc_id) join {asked} on {asked}.qid = {wide}.qid"""


def adaptive_sql(asked: str, p: str, k: int) -> str:
    """CTEs that end in {p}adapted: qid, doc_id, score, rank, strategy."""
    plan = re.sub(r"\b(a[1-6])\b", lambda m: p + m[1], STEPS).replace("from asks", f"from (select qid as conv_id, text from {asked})")
    by_type = """case when confidence >= 0.8 - 1e-9 then case when type in ('SimpleKeyword', 'NaturalQuestion') then 'DirectVector' when type = 'ComplexSearch' then 'Hybrid' when type = 'ReasoningQuery' then 'Adaptive'
when type = 'ComparisonQuery' then 'MultiQuery' when type = 'TemporalQuery' then 'TwoStage' else 'SelfRAG' end else recommended end"""
    return f"""{plan}, {p}plan as (select conv_id as qid, {by_type} as strategy from {p}a6),
{prefixed(p, f"{dense(20)}, {bm25(k=20)}", asked)},
{p}two as (select coalesce(d.qid, s.qid) as qid, coalesce(d.doc_id, s.doc_id) as doc_id, d.rank as rv, s.rank as rs
  from {p}dense d full join {p}sparse s on d.qid = s.qid and d.doc_id = s.doc_id),
{p}direct as (select qid, doc_id, 1.0 / (60 + rank) as score from {p}dense join {p}plan using (qid) where strategy = 'DirectVector' and rank <= 10),
{p}plain as (select qid, doc_id, coalesce(0.7 / (60 + case when rv <= 10 then rv end), 0) + coalesce(0.3 / (60 + case when rs <= 10 then rs end),
  0) as score from {p}two join {p}plan using (qid) where strategy in ('Hybrid', 'Adaptive', 'SelfRAG') and (rv <= 10 or rs <= 10)),
{p}wide as (select qid, doc_id, {RRF} as score from {p}two join {p}plan using (qid) where strategy = 'TwoStage'
  qualify row_number() over (partition by qid order by round({RRF}, 9) desc, doc_id) <= 20),
{multi_sql(asked, p, k)},
{p}every as (select *, 0 as r from {p}direct union all select *, 0 from {p}plain union all select *, 0 from ({second_sql(p + "wide", asked, k)})
  union all select qid, doc_id, score, rank from {p}multi join {p}plan using (qid) where strategy = 'MultiQuery'),
{p}adapted as (select qid, doc_id, score, strategy, row_number() over (partition by qid order by r, round(score, 9) desc, doc_id) as rank
  from {p}every join {p}plan using (qid) qualify rank <= {k})"""


@query(f"with {MORE}, {multi_sql('asked', '')} select qid, doc_id, cast(rank as int) as rank from multi")
def multi_query(spark, d):
    return selfrag.multi_query(hybrid_corpus(spark, d), more_queries(spark, d)).select("qid", "doc_id", "rank")


@query(f"""with {MORE}, {dense(20)}, {bm25(k=20)}, {fused(RRF, k=20)}, s2 as ({second_sql('fused', 'asked', 10)})
  select qid, doc_id, cast(row_number() over (partition by qid order by round(score, 9) desc, doc_id) as int) as rank, round(score, 6) as score
  from s2 qualify rank <= 10""")
def two_stage(spark, d):
    return selfrag.two_stage(hybrid_corpus(spark, d), more_queries(spark, d)).select("qid", "doc_id", "rank", r6("score"))


@query(f"with {MORE}, {adaptive_sql('asked', '', 10)} select qid, doc_id, cast(rank as int) as rank, strategy, round(score, 6) as score from adapted")
def adaptive_search(spark, d):
    return selfrag.adaptive(hybrid_corpus(spark, d), more_queries(spark, d)).select("qid", "doc_id", "rank", "strategy", r6("score"))


@query(f"with {MORE} select count(*) as queries, true as some_of_each from asked")
def ab_arms(spark, d):
    """Half of the queries go to the arm that takes the alternative strategy."""
    x = selfrag.planned(more_queries(spark, d), 50)
    return x.agg(F.count("*").alias("queries"), ((F.count_if(F.col("arm") == "A") > 0) & (F.count_if(F.col("arm") == "B") > 0)).alias("some_of_each"))


def _quality(spark, d):
    corpus, asked = hybrid_corpus(spark, d), queries(spark, d)
    return asked, selfrag.assessed(search.hybrid(corpus, asked), asked, corpus)


TERMS = r"list_filter(regexp_split_to_array(text, '[ \t\n,.!?]'), lambda x: length(x) > 2)"
QUALITY = f"""{CORPUS}, {dense()}, {bm25()}, {fused(RRF)}, t as (select qid, {TERMS} as t from asked),
r as (select f.qid, f.rank, c.text, t.t, len(list_filter(t.t, lambda w: contains(lower(c.text), lower(w)))) / greatest(1, len(t.t)) as share,
  list_distinct(string_split(lower(c.text), ' ')) as s from fused f join corpus c using (doc_id) join t using (qid)),
p as (select a.qid, avg({J.format('a.s', 'b.s')}) as j, count(distinct b.rank) filter ({J.format('a.s', 'b.s')} > 0.8) as dups
  from r a join r b on a.qid = b.qid and a.rank < b.rank group by a.qid),
cov as (select qid, count(*) filter (found) / greatest(1, count(*)) as c from (select t.qid, w, bool_or(contains(lower(r.text), lower(w))) as found
  from (select qid, unnest(t) as w, generate_subscripts(t, 1) as i from t) t join r on r.qid = t.qid group by t.qid, w, i) group by qid),
q as (select t.qid, count(r.rank) as n, avg(share) as relevance, 0.4 * least(count(r.rank) / 10, 1.0) + 0.3 * least(avg(length(r.text)) / 500,
  1.0) + 0.3 * coalesce(any_value(cov.c), 0) as completeness, any_value(case when p.qid is not null then greatest(0, 1 - p.j)
  else 0 end) as diversity, coalesce(any_value(p.dups), 0) as dups
  from t join r on t.qid = r.qid left join p on p.qid = t.qid left join cov on cov.qid = t.qid group by t.qid)"""


@query(f"""with {QUALITY} select qid, cast(n as int) as n, round(relevance, 6) as relevance, round(completeness, 6) as completeness, round(diversity,
  6) as diversity, round(0.35 * relevance + 0.25 * completeness + 0.15 * diversity + 0.15 * 0.8 + 0.1 * 0.7, 6) as overall,
  cast(dups as int) as duplicates from q""")
def selfrag_quality(spark, d):
    return _quality(spark, d)[1].select("qid", "n", *(r6(c) for c in ("relevance", "completeness", "diversity", "overall")), "duplicates")


TRUST = "case when doc_id % 3 > 0 then (doc_id % 10) / 10.0 end"
AGE = "case when doc_id % 4 > 0 then doc_id * 7 % 500 end"


def moved(base: float, value: str, name: str) -> str:
    """A CTE: a value that starts at `base` and goes half of the way to each of the first ten results that has one, in their order."""
    return f"""{name} as (select qid, {base} * pow(0.5, max(m)) + sum(v * pow(0.5, m - i + 1)) as {name} from (select qid, {value} as v, row_number() over (partition by qid
  order by rank) as i, count(*) over (partition by qid) as m from fused where rank <= 10 and {value} is not null) group by qid)"""


@query(f"""with {QUALITY}, {moved(0.8, TRUST, "credibility")}, {moved(0.7, AGE.replace("doc_id * 7 % 500", "greatest(0, 1 - (doc_id * 7 % 500) / 365.0)"), "freshness")},
z as (select q.*, coalesce(credibility, 0.8) as credibility, coalesce(freshness, 0.7) as freshness from q left join credibility using (qid) left join freshness using (qid))
select qid, round(credibility + 1e-9, 6) as credibility, round(freshness + 1e-9, 6) as freshness, round(0.35 * relevance + 0.25 * completeness + 0.15 * diversity
  + 0.15 * credibility + 0.1 * freshness + 1e-9, 6) as overall from z""")
def selfrag_trust(spark, d):
    """The quality of results whose texts are more or less reliable, and old; some have neither."""
    corpus, asked = hybrid_corpus(spark, d), queries(spark, d)
    texts = corpus.withColumns({"reliability": F.expr(TRUST.replace("10.0", "10D")), "age_days": F.expr(AGE)})
    return selfrag.assessed(search.hybrid(corpus, asked), asked, texts).select("qid", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("credibility", "freshness", "overall")))


ISSUES = """i as (select qid, 'InsufficientResults' as issue, 4 as severity from q where n < 5 union all select qid, 'InsufficientRelevance', 5 from q
  where relevance < 0.5 union all select qid, 'LackOfDiversity', 3 from q where diversity < 0.3 union all select qid, 'DuplicateResults', 2 from q
  where dups > 0)"""


@query(f"with {QUALITY}, {ISSUES} select * from i")
def selfrag_issues(spark, d):
    return selfrag.issues(_quality(spark, d)[1])


@query(f"""with {QUALITY}, {ISSUES} select qid, case issue when 'InsufficientResults' then trim(text) when 'InsufficientRelevance' then text ||
  ' 상세 정보 설명' else case when len(string_split(text, ' ')) > 2 then array_to_string(list_concat(string_split(text, ' ')[-1:], string_split(text,
  ' ')[:-2]), ' ') else text end end as refined,
case issue when 'InsufficientResults' then 'Generalization' when 'InsufficientRelevance' then 'ContextAddition' else 'Restructuring' end as kind,
  case issue when 'InsufficientResults' then 0.7 when 'InsufficientRelevance' then 0.8 else 0.6 end as gain from i join asked using (qid)
  where issue <> 'DuplicateResults'""")
def query_refinements(spark, d):
    asked, quality = _quality(spark, d)
    return selfrag.refinements(asked, selfrag.issues(quality))


@query(f"""with {QUALITY}, {ISSUES}, more as (select qid, text || case qid % 3 when 0 then ' Software' when 1 then ' computer technology software' else '' end as text from asked),
made as (select qid, case issue when 'InsufficientResults' then trim(text) when 'InsufficientRelevance' then text || ' 상세 정보 설명' else case
  when len(string_split(text, ' ')) > 2 then array_to_string(list_concat(string_split(text, ' ')[-1:], string_split(text, ' ')[:-2]), ' ') else text end end as refined,
  case issue when 'InsufficientResults' then 'Generalization' when 'InsufficientRelevance' then 'ContextAddition' else 'Restructuring' end as kind,
  case issue when 'InsufficientResults' then 0.7 when 'InsufficientRelevance' then 0.8 else 0.6 end as gain from i join more using (qid) where issue <> 'DuplicateResults'
union all select qid, text || case qid % 3 when 0 then ' 소프트웨어' else ' 컴퓨터 기술' end, 'SynonymReplacement', 0.6 from more where qid % 3 < 2)
select qid, refined, kind, gain from made qualify row_number() over (partition by qid order by gain desc, kind) <= 2""")
def synonym_refinements(spark, d):
    """The two best refinements of queries, most of which hold a word that has a synonym."""
    asked, quality = _quality(spark, d)
    suffix = F.when(F.col("qid") % 3 == 0, " Software").when(F.col("qid") % 3 == 1, " computer technology software").otherwise("")
    return selfrag.refinements(asked.withColumn("text", F.concat("text", suffix)), selfrag.issues(quality), 2)


def self_rag_sql(rounds: int = 3) -> str:
    """All rounds: each searches for the queries that the one before left open, as they were rewritten."""
    ctes, out, asked = [MORE], [], "asked"
    measure = QUALITY[QUALITY.index("t as (select qid, {TERMS}".replace("{TERMS}", TERMS)) :].replace("fused f", "adapted f").replace(" as j, count", " filter (b.rank <= 10) as j, count")
    for i in range(1, rounds + 1):
        p = f"r{i}"
        ctes.append(adaptive_sql(asked, p, 20))
        part = re.sub(r"\b(t|r|p|cov|q)\b(?= as \()", lambda m, p=p: p + m[1], measure)
        part = re.sub(r"\b(from|join) (t|r|p|cov|q)\b(?! as)", lambda m, p=p: f"{m[1]} {p}{m[2]} {m[2]}", part)
        part = re.sub(r"(r[123](t|r|p|cov|q) (t|r|p|cov|q)) (a|b|t)\b", lambda m: m[1].rsplit(" ", 1)[0] + " " + m[4], part)
        ctes.append(part.replace("adapted f", f"{p}adapted f").replace("from asked)", f"from {asked})"))
        overall = "0.35 * relevance + 0.25 * completeness + 0.15 * diversity + 0.15 * 0.8 + 0.1 * 0.7"
        good = f"{overall} >= 0.7 and n >= 5" if i < rounds else "true"
        out.append(f"""select a.qid, {i} as round, a.doc_id, cast(rank as int) as rank, round({overall}, 6) as overall
  from {p}adapted a join {p}q q on a.qid = q.qid where {good}""")
        ctes.append(f"""{p}open as (select a.qid, case when relevance < 0.5 then text || ' 상세 정보 설명' when n < 5 then trim(text) when diversity < 0.3
  and len(string_split(text, ' ')) > 2 then array_to_string(list_concat(string_split(text, ' ')[-1:], string_split(text, ' ')[:-2]),
  ' ') else text end as text, vec
  from {asked} a join {p}q q on a.qid = q.qid where not ({good}))""")
        asked = f"{p}open"
    return f"with {', '.join(ctes)} " + " union all ".join(out)


@query(self_rag_sql())
def self_rag(spark, d):
    return selfrag.self_rag(hybrid_corpus(spark, d), more_queries(spark, d)).select("qid", "round", "doc_id", "rank", r6("overall"))


@query(f"""with {QUALITY}, {ISSUES} select qid, cast(row_number() over (partition by qid order by severity desc, issue) as int) as place, case issue
  when 'InsufficientRelevance' then 'ContextAddition' when 'InsufficientResults' then 'Generalization' when 'LackOfDiversity' then 'Restructuring'
  else 'Deduplication' end as suggestion, severity from i""")
def improvement_suggestions(spark, d):
    return selfrag.suggestions(_quality(spark, d)[1])


@query(f"""with {CORPUS}, {dense(10)} select qid, doc_id, round(len(list_filter(list_filter(string_split(lower(asked.text), ' '), lambda x: x <> ''),
  lambda x: list_contains(list_filter(string_split(lower(corpus.text), ' '), lambda y: y <> ''),
  x))) / greatest(1, len(list_filter(string_split(lower(asked.text), ' '), lambda x: x <> ''))), 6) as relevance
  from dense join asked using (qid) join corpus using (doc_id)""")
def query_relevance(spark, d):
    """Of each query and its ten nearest documents."""
    asked = queries(spark, d)
    hits = nearest.knn(hybrid_corpus(spark, d), asked, 10).select("qid", "doc_id")
    x = hits.join(asked.select("qid", F.col("text").alias("asked")), "qid").join(documents(spark, d).select("doc_id", "text"), "doc_id")
    return x.select("qid", "doc_id", F.round(relevance(F.col("text"), F.col("asked")), 6).alias("relevance"))
