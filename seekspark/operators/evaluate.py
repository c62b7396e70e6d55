"""Retrieval metrics against ground truth, golden datasets, gates and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import relevance, space_tokens
from .analyze import categories, difficulty
from .lexical import maybe_broadcast, small

RETRIEVAL = ["precision", "recall", "f1_score", "hit_rate", "mrr", "ndcg"]
ANSWER = ["faithfulness", "answer_relevancy", "context_relevancy"]
METRICS = [*RETRIEVAL, *ANSWER]
#: What an average must reach at least, and, for the latency, at most.
THRESHOLDS = {"precision": 0.7, "recall": 0.7, "f1_score": 0.7, "hit_rate": 0.8, "mrr": 0.7, "ndcg": 0.7, "faithfulness": 0.8, "answer_relevancy": 0.7, "context_relevancy": 0.7}
MAX_MS = 1000.0
#: Items that are sent to every task; more meet the documents by a shuffle.
MOST_ITEMS = 10_000


def holders(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, doc_id): which documents (doc_id, text) hold the text of which items (qid, item).

    An occurrence holds all the item's inner words (between spaces) as words of the document: documents and items meet by the
    item's longest inner word, and only these pairs are compared. Items of fewer than three words are compared with every document.
    Where there are few items their words are looked for in the texts in place; else ids and words are shuffled.
    """
    inner = F.split("item", " ")
    inner = F.filter(F.slice(inner, 2, F.greatest(F.lit(0), F.size(inner) - 2)), lambda x: x != "")
    best = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))
    keyed = items.select("qid", "item", best.w.alias("w")).where("item is not null")
    anchors = keyed.where("w is not null")
    short = maybe_broadcast(keyed.where("w is null").drop("w"), MOST_ITEMS)
    bare = docs.select("doc_id", "text").join(short, F.contains("text", F.col("item"))).select("qid", "doc_id")
    if small(anchors, MOST_ITEMS):
        asked = sorted({r.w for r in anchors.select("w").collect()})
        here = F.array_distinct(F.filter(F.split("text", " "), lambda x: x.isin(asked)))
        near = docs.select("doc_id", "text", here.alias("ws")).where(F.size("ws") > 0).select("doc_id", "text", F.explode("ws").alias("w"))
        found = near.join(F.broadcast(anchors), "w").where(F.contains("text", F.col("item"))).select("qid", "doc_id").distinct()
        return found.unionByName(bare)
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))  # ids and words: no text is copied
    met = words.join(anchors.select("qid", "w"), "w").select("qid", "doc_id").distinct()
    both = met.join(docs.select("doc_id", "text"), "doc_id").join(anchors.select("qid", "item"), "qid")
    found = both.where(F.contains("text", F.col("item"))).select("qid", "doc_id").distinct()
    return found.unionByName(bare)


def answer_metrics(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, ANSWER) of answers (qid, query, answer) and what was retrieved for them (qid, rank, text), by overlap of words.

    Faithfulness is the share of the answer's words that some context has, answer relevancy that of the query's words which the
    answer has, context relevancy the mean share of the query's words over the contexts. Models that judge these take the same tables.
    """
    a = answers.select("qid", "query", "answer")
    words = lambda c: F.array_distinct(space_tokens(F.lower(c)))
    each = a.join(contexts.select("qid", "text"), "qid", "left")
    said = F.when(F.col("text").isNotNull(), F.array_intersect(words(F.col("answer")), words(F.col("text"))))
    g = each.groupBy("qid").agg(
        F.first("query").alias("query"), F.first("answer").alias("answer"), F.array_distinct(F.flatten(F.collect_list(said))).alias("said"),
        F.avg(F.when(F.col("text").isNotNull(), relevance(F.col("text"), F.col("query")))).alias("context_relevancy"),
    )
    n = F.size(words(F.col("answer")))
    return g.select("qid", ratio(F.size("said"), n).alias("faithfulness"), relevance(F.col("answer"), F.col("query")).alias("answer_relevancy"), F.coalesce("context_relevancy", F.lit(0.0)).alias("context_relevancy"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)


def retrieval_metrics(results: DataFrame, truth: DataFrame, at: int = 10) -> DataFrame:
    """(qid, tp, fp, fn, and METRICS) of results (qid, doc_id, rank) against truth (qid, doc_id), for every query of either."""
    t = truth.select("qid", "doc_id").distinct().withColumn("rel", F.lit(1))
    x = results.select("qid", "doc_id", "rank").join(t, ["qid", "doc_id"], "full")
    gain = F.when(F.col("rel").isNotNull() & (F.col("rank") <= at), 1 / F.log2(F.col("rank") + 1))
    hit = F.col("rel").isNotNull() & F.col("rank").isNotNull()
    g = x.groupBy("qid").agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col("rank").isNotNull() & F.col("rel").isNull()).alias("fp"), F.count_if(F.col("rank").isNull()).alias("fn"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg")
    )
    n = (F.col("tp") + F.col("fn")).cast("int")
    ideal = F.aggregate(F.slice(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), 1, F.least(F.lit(at), n)), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    g = g.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return g.withColumns({"f1_score": ratio(2 * p * r, p + r), "hit_rate": (F.col("tp") > 0).cast("double"), "mrr": F.coalesce(1 / F.col("first"), F.lit(0.0)), "ndcg": ratio(F.col("dcg"), ideal)}).drop("first", "dcg")


def summary(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Averages of the metrics there are; with `ms` also of the latency, with `ok` the share of queries that succeeded."""
    more = [F.avg("ms").alias("avg_ms")] if "ms" in metrics.columns else []
    more += [F.avg(F.col("ok").cast("double")).alias("success_rate")] if "ok" in metrics.columns else []
    return metrics.groupBy(*(by or [])).agg(F.count("*").alias("queries"), *(F.avg(m).alias(m) for m in METRICS if m in metrics.columns), *more)


def averaged_f1(averages: DataFrame) -> DataFrame:
    """The same row with f1_score of the averaged precision and recall."""
    p, r = F.col("precision"), F.col("recall")
    return averages.withColumn("f1_score", ratio(2 * p * r, p + r))


def long(averages: DataFrame, value: str = "value") -> DataFrame:
    """(metric, value) of a row of averages."""
    return averages.select(F.explode(F.create_map(*(x for m in METRICS if m in averages.columns for x in (F.lit(m), F.col(m))))).alias("metric", value))


def gate(averages: DataFrame, thresholds: dict[str, float] | None = None, max_ms: float = MAX_MS) -> DataFrame:
    """(metric, value, threshold, passed): nine minimums, and the latency's maximum where there is one."""
    known = F.create_map(*(F.lit(x) for kv in (thresholds or THRESHOLDS).items() for x in kv))
    x = long(averages).withColumn("threshold", F.element_at(known, F.col("metric")))
    x = x.withColumn("passed", F.col("value") >= F.col("threshold"))
    if "avg_ms" not in averages.columns:
        return x
    slow = averages.select(F.lit("avg_ms").alias("metric"), F.col("avg_ms").alias("value"), F.lit(max_ms).alias("threshold"))
    return x.unionByName(slow.withColumn("passed", F.col("value") <= F.col("threshold")))


def compare(baseline: DataFrame, candidate: DataFrame, drop: float = 0.05) -> DataFrame:
    """(metric, baseline, candidate, improvement, regressed) of two rows of averages."""
    x = long(baseline, "baseline").join(long(candidate, "candidate"), "metric").withColumn("improvement", F.col("candidate") - F.col("baseline"))
    return x.withColumn("regressed", F.col("improvement") < -drop)


def verdict(compared: DataFrame) -> DataFrame:
    """(overall_improvement, is_better, regressions) of a comparison: the mean over its metrics, and how many regressed."""
    x = compared.agg(F.avg("improvement").alias("overall_improvement"), F.count_if("regressed").alias("regressions"))
    return x.select("overall_improvement", (F.col("overall_improvement") > 0).alias("is_better"), "regressions")


# --- jobs: a log of events (job_id, at, event, progress) is the state ------------

JOB_STATES = {"create": "Pending", "start": "Running", "progress": "Running", "finish": "Completed", "fail": "Failed", "cancel": "Cancelled"}


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, created, changed, status, progress) of the log; what comes after an end is ignored."""
    status = F.element_at(F.create_map(*(F.lit(x) for kv in JOB_STATES.items() for x in kv)), F.col("event"))
    done = F.col("event").isin("finish", "fail", "cancel")
    w = Window.partitionBy("job_id").orderBy("at", "event")
    ended = F.coalesce(F.max(done.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = events.withColumn("status", status).withColumn("ended", ended).where("ended = 0")
    last = F.struct("at", "event")
    return x.groupBy("job_id").agg(F.min("at").alias("created"), F.max("at").alias("changed"), F.max_by("status", last).alias("status"), F.coalesce(F.max("progress"), F.lit(0.0)).alias("progress"))


def jobs(states: DataFrame, status: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Jobs of a status that were created in a period."""
    x = states.where(F.col("status") == status) if status else states
    x = x.where(F.col("created") >= F.lit(since).cast("timestamp")) if since else x
    return x.where(F.col("created") <= F.lit(until).cast("timestamp")) if until else x


def golden_from_logs(logs: DataFrame, least: float = 0.8) -> DataFrame:
    """Golden items of accepted, well rated logs (id, query, chunk_ids, scores, rating, accepted): the ids that scored enough."""
    good = logs.where(F.coalesce(F.col("accepted") & (F.col("rating") >= least), F.lit(False)))
    pairs = F.filter(F.arrays_zip("chunk_ids", "scores"), lambda x: x["scores"] >= least)
    x = good.withColumn("relevant", F.transform(pairs, lambda p: p["chunk_ids"])).where(F.size("relevant") > 0)
    return x.select("id", "query", "relevant", F.col("rating").alias("weight"), difficulty(F.col("query")).alias("difficulty"), categories(F.col("query")).alias("categories"))


def validated(items: DataFrame) -> DataFrame:
    """Items with the lists of what is wrong and what is doubtful about them."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    errors = F.array_compact(F.array(
        F.when(blank("id"), "blank id"), F.when(blank("query"), "blank query"), F.when(~F.coalesce(F.col("weight").between(0, 10), F.lit(False)), "weight out of range"), F.when(~F.coalesce(F.col("difficulty").isin("Easy", "Medium", "Hard"), F.lit(False)), "bad difficulty"),
    ))
    warnings = F.array_compact(F.array(F.when(blank("answer"), "no answer"), F.when(F.coalesce(F.size("relevant"), F.lit(0)) < 1, "no relevant ids")))
    return items.withColumns({"errors": errors, "warnings": warnings})


def dataset_stats(items: DataFrame) -> DataFrame:
    """(kind, name, n): items, distinct relevant ids, items of each category and difficulty."""
    relevant = items.select(F.explode("relevant").alias("r")).agg(F.countDistinct("r").alias("n")).select(F.lit("total").alias("kind"), F.lit("relevant").alias("name"), "n")
    total = items.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("items").alias("name"), "n")
    by = lambda kind, c: items.select(c.alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return total.unionByName(relevant).unionByName(by("category", F.explode("categories"))).unionByName(by("difficulty", F.col("difficulty")))


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name).lstrip("_")


def save_golden(items: DataFrame, path: str, each: int | None = None) -> None:
    """Golden items as JSON with names like itemId, and updatedAt: the time of the write. A line for each item, or, with `each`, a file
    a partition whose lines are arrays of up to about so many items."""
    named = items.withColumn("updated_at", F.current_timestamp())
    named = named.toDF(*(_camel(c) for c in named.columns))
    if each is None:
        named.write.mode("overwrite").json(path)
        return
    groups = named.select(F.pmod(F.xxhash64(*named.columns), F.lit(max(1, -(-items.count() // each)))).alias("g"), F.struct(*named.columns).alias("item"))
    groups.groupBy("g").agg(F.to_json(F.collect_list("item")).alias("value")).select("value").write.mode("overwrite").text(path)


def load_golden(spark, path: str, array: bool = False) -> DataFrame:
    """Golden items from JSON lines (an object or an array each), or from files that each hold one JSON array; names like item_id."""
    items = spark.read.option("multiLine", array).json(path)
    return items.toDF(*(_snake(c) for c in items.columns))


def first_of(rows: DataFrame, by: list[str], *order) -> DataFrame:
    """Keeps the first row of each group."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")
