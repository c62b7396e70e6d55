"""Queries on evaluation: retrieval and answer metrics, gates, comparisons, jobs, golden datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, lexical
from ..sources.shared import kept
from ..sources.tables import documents, table
from . import query
from .fragments import SPACED, bm25, words

r6 = lambda c: F.round(c, 6).alias(c)

TRUTH = "truth as (select item_id as qid, doc_id from benchmark join documents d on contains(d.text, benchmark.text))"
FOUND = f"asked as (select item_id as qid, text from benchmark), {bm25('documents')}"
MEASURED = f"""{FOUND}, {TRUTH}, x as (select coalesce(s.qid, t.qid) as qid, s.rank, t.doc_id is not null as rel, s.doc_id is not null as got
  from sparse s full join truth t on s.qid = t.qid and s.doc_id = t.doc_id),
g as (select qid, count(*) filter (rel and got) as tp, count(*) filter (got and not rel) as fp, count(*) filter (not got) as fn, min(rank) filter (rel
  and got) as first, coalesce(sum(1 / log2(rank + 1)) filter (rel and got and rank <= 10), 0) as dcg from x group by qid),
m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall,
  coalesce(1 / first, 0) as mrr, cast(tp > 0 as double) as hit_rate,
  case when tp + fn > 0 then dcg / list_sum(list_transform(range(1, least(10, tp + fn) + 1), lambda i: 1 / log2(i + 1))) else 0 end as ndcg from g),
metrics as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1_score from m)"""


def truth(spark, d):
    """Which documents hold the text of which benchmark item."""
    return evaluate.holders(documents(spark, d), table(spark, d, "benchmark").selectExpr("item_id qid", "text item"))


def measured(spark, d):
    asked = table(spark, d, "benchmark").selectExpr("item_id qid", "text")
    return evaluate.retrieval_metrics(lexical.bm25_sparse(documents(spark, d), asked), truth(spark, d))


@query(f"""with {MEASURED} select qid, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1_score, 6) as f1_score,
  hit_rate from metrics""")
def retrieval_metrics(spark, d):
    return measured(spark, d).select("qid", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1_score"), "hit_rate")


@query(f"with {MEASURED} select qid, round(ndcg, 6) as ndcg from metrics")
def ndcg_at_10(spark, d):
    return measured(spark, d).select("qid", r6("ndcg"))


@query(f"with {MEASURED} select qid, round(mrr, 6) as mrr from metrics")
def mrr(spark, d):
    return measured(spark, d).select("qid", r6("mrr"))


LOWER = SPACED.replace("text", "lower({})")
ANSWERED = f"""{MEASURED}, best as (select qid, d.text as top from sparse join documents d using (doc_id) where rank = 1),
an as (select asked.qid, asked.text as query, substr(coalesce(top, ''), 1, 300) || ' ' || substr(asked.text, 1, 40) || ' indeed' as answer
  from asked left join best using (qid)),
aw as (select qid, list_distinct({LOWER.format('answer')}) as a, {LOWER.format('answer')} as c, {LOWER.format('query')} as q from an),
cw as (select qid, rank, list_distinct({LOWER.format('d.text')}) as w from sparse join documents d using (doc_id)),
ar as (select aw.qid, case when len(any_value(a)) > 0 then len(list_intersect(any_value(a), coalesce(flatten(list(w)),
  []))) / len(any_value(a)) else 0 end as faithfulness,
  len(list_filter(any_value(q), lambda x: list_contains(any_value(c), x))) / greatest(1, len(any_value(q))) as answer_relevancy,
  coalesce(avg(case when w is not null then len(list_filter(q, lambda x: list_contains(w, x))) / greatest(1, len(q)) end), 0) as context_relevancy
  from aw left join cw using (qid) group by aw.qid),
full_metrics as (select metrics.*, faithfulness, answer_relevancy, context_relevancy, 900.0 + metrics.qid % 50 as ms, metrics.qid % 7 <> 0 as ok
  from metrics join ar using (qid))"""


def answered(spark, d):
    """Retrieval metrics and answer metrics of each benchmark query, with a latency and whether it succeeded."""
    docs = documents(spark, d).select("doc_id", "text")
    asked = table(spark, d, "benchmark").selectExpr("item_id qid", "text query")
    hits = kept(lexical.bm25_sparse(docs, asked.withColumnRenamed("query", "text")), "hits")
    found = kept(hits.join(docs, "doc_id").select("qid", "rank", "text"), "found")
    answers = asked.join(found.where("rank = 1").select("qid", "text"), "qid", "left")
    said = F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 300), F.lit(" "), F.substring("query", 1, 40), F.lit(" indeed"))
    answers = answers.select("qid", "query", said.alias("answer"))
    both = evaluate.retrieval_metrics(hits, truth(spark, d)).join(evaluate.answer_metrics(answers, found), "qid")
    return both.withColumns({"ms": 900.0 + F.col("qid") % 50, "ok": F.col("qid") % 7 != 0})


AVERAGES = ", ".join(f"round(avg({m}), 6) as {m}" for m in evaluate.RETRIEVAL)
ALL_AVERAGES = ", ".join(f"round(avg({m}), 6) as {m}" for m in evaluate.METRICS)


@query(f"with {MEASURED} select count(*) as queries, {AVERAGES} from metrics")
def fusion_eval(spark, d):
    return evaluate.summary(measured(spark, d)).select("queries", *(r6(m) for m in evaluate.RETRIEVAL))


@query(f"""with {ANSWERED} select qid, round(faithfulness, 6) as faithfulness, round(answer_relevancy, 6) as answer_relevancy,
round(context_relevancy, 6) as context_relevancy from full_metrics""")
def answer_quality(spark, d):
    return answered(spark, d).select("qid", *(r6(m) for m in evaluate.ANSWER))


@query(f"""with {ANSWERED} select count(*) as queries, {ALL_AVERAGES}, round(avg(ms), 6) as avg_ms,
round(avg(cast(ok as double)), 6) as success_rate from full_metrics""")
def batch_evaluation(spark, d):
    x = evaluate.summary(answered(spark, d))
    return x.select("queries", *(r6(m) for m in evaluate.METRICS), r6("avg_ms"), r6("success_rate"))


@query(f"""with {MEASURED}, a as (select count(*) as queries, avg(precision) as p, avg(recall) as r from metrics)
select queries, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1_score from a""")
def small_to_big_eval(spark, d):
    """F1 of averaged precision and recall."""
    return evaluate.averaged_f1(evaluate.summary(measured(spark, d))).select("queries", r6("precision"), r6("recall"), r6("f1_score"))


PER_METRIC = " union all ".join(
    f"select '{m}' as metric, avg({m}) as value, {x} as threshold, avg({m}) >= {x} as passed from full_metrics" for m, x in evaluate.THRESHOLDS.items()
)


@query(f"""with {ANSWERED}, a as ({PER_METRIC} union all select 'avg_ms', avg(ms), 1000, avg(ms) <= 1000 from full_metrics)
select metric, round(value, 6) as value, cast(threshold as double) as threshold, passed from a""")
def quality_gate(spark, d):
    return evaluate.gate(evaluate.summary(answered(spark, d))).select("metric", r6("value"), "threshold", "passed")


BOTH = " union all ".join(f"select '{m}' as metric, avg({m}) as baseline, avg({m}) filter (qid % 2 = 0) as candidate from full_metrics" for m in evaluate.METRICS)
COMPARED = f"{ANSWERED}, a as ({BOTH})"


def compared(spark, d):
    m = kept(answered(spark, d), "measured")
    return evaluate.compare(evaluate.summary(m), evaluate.summary(m.where("qid % 2 = 0")))


@query(f"with {COMPARED} select metric, round(candidate - baseline, 6) as improvement, candidate - baseline < -0.05 as regressed from a")
def quality_compare(spark, d):
    return compared(spark, d).select("metric", r6("improvement"), "regressed")


@query(f"""with {COMPARED} select round(avg(candidate - baseline), 6) as overall_improvement, avg(candidate - baseline) > 0 as is_better,
count(*) filter (candidate - baseline < -0.05) as regressions from a""")
def quality_verdict(spark, d):
    return evaluate.verdict(compared(spark, d)).select(r6("overall_improvement"), "is_better", "regressions")


JOB_LOG = """jl as (select user_id as job_id, ts as stamp, case event_type when 'signup' then 'create' when 'view' then 'start'
  when 'click' then 'progress'
  when 'purchase' then 'finish' else 'cancel' end as event, case when event_type = 'click' then value / 500 end as progress from events),
je as (select *, coalesce(max(cast(event in ('finish', 'fail', 'cancel') as int)) over (partition by job_id order by stamp,
  event rows between unbounded preceding and 1 preceding), 0) as ended from jl),
jobs as (select job_id, min(stamp) as created, max(stamp) as changed, arg_max(case event when 'create' then 'Pending' when 'start' then 'Running'
  when 'progress' then 'Running'
  when 'finish' then 'Completed' when 'fail' then 'Failed' else 'Cancelled' end, (stamp, event)) as status, coalesce(max(progress), 0) as progress
  from je where ended = 0 group by job_id)"""


def job_log(spark, d):
    kind = F.col("event_type")
    event = F.when(kind == "signup", "create").when(kind == "view", "start").when(kind == "click", "progress").when(kind == "purchase", "finish").otherwise("cancel")
    progress = F.when(kind == "click", F.col("value") / 500)
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), event.alias("event"), progress.alias("progress"))


@query(f"with {JOB_LOG} select job_id, status, round(progress, 6) as progress from jobs")
def evaluation_jobs(spark, d):
    return evaluate.job_states(job_log(spark, d)).select("job_id", "status", r6("progress"))


@query(f"""with {JOB_LOG} select job_id from jobs where status = 'Cancelled'
and created >= timestamp '2024-01-01 06:00:00' and created <= timestamp '2024-01-20 00:00:00'""")
def job_filter(spark, d):
    return evaluate.jobs(evaluate.job_states(job_log(spark, d)), "Cancelled", "2024-01-01 06:00:00", "2024-01-20 00:00:00").select("job_id")


TITLES = ["query", "기술 개발 방법", "데이터 분석 왜 이런가", "마케팅 전략 비교", "one two three four five six seven eight", "무엇 때문에 그런가 하나 둘", "plain words only here now", "연구 실험"]
LOGS = f"""logs as (select user_id as id, ({words(TITLES)})[1 + user_id % 8] as query, list(event_type order by event_id) as chunk_ids,
  list(value / 490 order by event_id) as scores, max(value) / 490 as rating, count(*) filter (event_type = 'purchase') > 0 as accepted from events
  group by user_id)"""


def logs(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", (F.col("value") / 490).alias("s")))).alias("e"), (F.max("value") / 490).alias("rating"), (F.count_if(F.col("event_type") == "purchase") > 0).alias("accepted"))
    return e.select("id", F.element_at(F.array(*map(F.lit, TITLES)), (1 + F.col("id") % 8).cast("int")).alias("query"), F.transform("e", lambda x: x.event_type).alias("chunk_ids"), F.transform("e", lambda x: x.s).alias("scores"), "rating", "accepted")


DIFFICULTY = """case when len(string_split(query, ' ')) <= 3 and not regexp_matches(query, '분석|비교|설명') then 'Easy'
  when len(string_split(query, ' ')) <= 7 and not regexp_matches(query, '분석|비교|설명') and regexp_matches(query, '왜|어떻게|무엇') then 'Medium'
  when len(string_split(query, ' ')) > 7 or regexp_matches(query, '분석|비교|설명') then 'Hard' else 'Medium' end"""
NAMED = """case when regexp_matches(query, '기술|프로그래밍|개발|시스템|알고리즘') then ['기술'] else [] end || case when regexp_matches(query, '비즈니스|마케팅|경영|전략|수익') then ['비즈니스'] else [] end
  || case when regexp_matches(query, '과학|연구|실험|데이터|분석') then ['과학'] else [] end || case when regexp_matches(query, '일반|정보|설명|개념|정의') then ['일반'] else [] end"""
GOLDEN = f"""{LOGS}, z as (select *, list_filter(list_zip(chunk_ids, scores), lambda p: p[2] >= 0.3) as good from logs
  where accepted and rating >= 0.3), golden as (select id, query, list_transform(good, lambda p: p[1]) as relevant, rating as weight,
  {DIFFICULTY} as difficulty, {NAMED} as names from z where len(good) > 0)"""


@query(f"with {GOLDEN} select id, query, array_to_string(relevant, ',') as relevant, round(weight, 6) as weight, difficulty from golden")
def golden_from_logs(spark, d):
    return evaluate.golden_from_logs(logs(spark, d), 0.3).select("id", "query", F.array_join("relevant", ",").alias("relevant"), r6("weight"), "difficulty")


@query(f"""with {GOLDEN} select 'total' as kind, 'items' as name, count(*) as n from golden union all select 'total', 'relevant', count(distinct r)
  from (select unnest(relevant) as r from golden)
union all select 'category', c, count(*) from (select unnest(case when len(names) > 0 then names else ['일반'] end) as c from golden) group by c
  union all select 'difficulty', difficulty, count(*) from golden group by difficulty""")
def dataset_stats(spark, d):
    return evaluate.dataset_stats(evaluate.golden_from_logs(logs(spark, d), 0.3))


@query("""select item_id, cast(item_id % 5 = 0 as int) + cast(item_id % 4 = 1 as int) + cast(item_id % 6 = 2 as int) as errors,
  cast(item_id % 3 = 0 as int) + cast(item_id % 7 = 0 as int) as warnings from benchmark""")
def dataset_validation(spark, d):
    i = F.col("item_id")
    items = table(spark, d, "benchmark").select(
        "item_id", F.when(i % 5 == 0, " ").otherwise(i.cast("string")).alias("id"), "text", F.when(i % 4 == 1, 15.0).otherwise(1.0).alias("weight"), F.when(i % 6 == 2, "Odd").otherwise("Easy").alias("difficulty"),
        F.when(i % 3 == 0, F.lit(None)).otherwise("answer").alias("answer"), F.when(i % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("relevant"),
    )
    return evaluate.validated(items.withColumnRenamed("text", "query")).select("item_id", F.size("errors").alias("errors"), F.size("warnings").alias("warnings"))
