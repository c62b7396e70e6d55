"""Adaptive and self-reflective search: strategies by query features, assessment of results, refinement, bounded retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, once, query_terms, relevance, space_parts
from ..operators import analyze, fusion, lexical, nearest
from ..operators.lexical import top
from ..sources.shared import kept
from . import search


def multi_query(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Hybrid search for each query and up to two rephrasings; a document counts where it came first."""
    asked = queries.select("qid", "vec", F.posexplode(analyze.expansions(F.col("text"))).alias("e", "text"))
    # each expansion is a query of its own for the arms
    many = asked.select((F.col("qid") * 8 + F.col("e")).alias("qid"), "text", "vec")
    hits = search.hybrid(corpus, many, k=k)
    hits = hits.select(F.floor(F.col("qid") / 8).alias("qid"), (F.col("qid") % 8).alias("e"), "doc_id", "score", "rank")
    w = Window.partitionBy("qid", "doc_id").orderBy("e", "rank")
    first = hits.withColumn("f", F.row_number().over(w)).where("f = 1")
    order = Window.partitionBy("qid").orderBy("e", "rank")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank")


def two_stage(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Wide hybrid search of min(2k, 20), then the k that share most with the query."""
    n = min(2 * k, 20)
    return _second_stage(search.hybrid(corpus, queries, k=n, arm_k=n), corpus, queries, k)


def _second_stage(wide: DataFrame, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    wide = kept(wide.select("qid", "doc_id", "score"), "wide")  # written, its size is known: a few hits go to the texts, not all texts to the hits
    x = wide.join(corpus.select("doc_id", "text"), "doc_id").join(queries.select("qid", F.col("text").alias("asked")), "qid")
    return top(x.select("qid", "doc_id", (0.7 * relevance(F.col("text"), F.col("asked")) + 0.3 * F.col("score")).alias("score")), k)


def planned(queries: DataFrame, ab_share: int = 0) -> DataFrame:
    """(qid, text, vec, strategy, arm): the strategy of each query; `ab_share` of a hundred queries, by hash, take the alternative."""
    q = analyze.analysis(queries).withColumn("strategy", analyze.strategy())
    other = F.pmod(F.crc32(F.col("qid").cast("string")), F.lit(100)) < ab_share
    return q.select("qid", "text", "vec", F.when(other, analyze.other_arm(F.col("strategy"))).otherwise(F.col("strategy")).alias("strategy"), F.when(other, "B").otherwise("A").alias("arm"))


def adaptive(corpus: DataFrame, queries: DataFrame, k: int = 10, ab_share: int = 0) -> DataFrame:
    """(qid, doc_id, score, rank, strategy, arm): each query by the strategy its analysis calls for.

    The arms run once for all queries that use them; the strategies differ in what they do with them. What they share is written
    once, so the plan of the result does not hold the arms several times.
    """
    q = kept(planned(queries, ab_share), "planned")
    of = lambda *names: q.where(F.col("strategy").isin(*names))
    plain = "Hybrid", "Adaptive", "SelfRAG"
    v = kept(nearest.knn(corpus.select("doc_id", "vec"), q.where("strategy <> 'MultiQuery'"), 20).join(q.select("qid", "strategy"), "qid"), "dense")
    both = q.where(F.col("strategy").isin(*plain, "TwoStage"))
    s = kept(lexical.bm25_sparse(corpus.select("doc_id", "text"), both, 20).join(q.select("qid", "strategy"), "qid"), "sparse")
    arm = lambda x, n, *names: x.where((F.col("rank") <= n) & F.col("strategy").isin(*names)).drop("strategy")
    wide = fusion.rrf(arm(v, 20, "TwoStage"), arm(s, 20, "TwoStage"), k=20)
    parts = [
        fusion.rrf(arm(v, 10, "DirectVector"), arm(s, 10, "DirectVector"), wv=1.0, ws=0.0, k=k),
        fusion.rrf(arm(v, 10, *plain), arm(s, 10, *plain), k=k),
        _second_stage(wide, corpus, of("TwoStage"), k),
    ]
    if not of("MultiQuery").isEmpty():
        parts.append(multi_query(corpus, of("MultiQuery").select("qid", "text", "vec"), k))
    out = parts[0].select("qid", "doc_id", "score", "rank")
    for x in parts[1:]:
        out = out.unionByName(x.select("qid", "doc_id", "score", "rank"))
    return out.join(q.select("qid", "strategy", "arm"), "qid")


def assessed(results: DataFrame, queries: DataFrame, texts: DataFrame, most: int = 20) -> DataFrame:
    """(qid, n, relevance, completeness, diversity, credibility, freshness, overall, duplicates) of ranked results.

    Result lists are ranked and at most `most` long, so a list is one small row. Texts may have `reliability` (0 to 1) and `age_days`;
    each of the first ten that has one moves credibility, from 0.8, or freshness, from 0.7, half of the way to it.
    """
    known = [c if c in texts.columns else F.lit(None).cast("double").alias(c) for c in ("reliability", "age_days")]
    ranked = results.where(F.col("rank") <= most).join(texts.select("doc_id", "text", *known), "doc_id")
    lists = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "text", "reliability", "age_days"))).alias("r"))
    x = queries.select("qid", query_terms(F.col("text")).alias("t")).join(lists, "qid", "left")
    x = x.withColumn("c", F.coalesce(F.transform("r", lambda y: y.text), F.array().cast("array<string>"))).withColumn("n", F.size("c"))
    share = lambda c: F.when(F.size("t") > 0, once(F.lower(c), lambda low: F.size(F.filter("t", lambda w: F.contains(low, F.lower(w))))) / F.greatest(F.lit(1), F.size("t"))).otherwise(0.0)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    half = lambda base, of: F.aggregate(F.slice("r", 1, 10), F.lit(base), lambda a, y: F.when(of(y).isNotNull(), (a + of(y)) / 2).otherwise(a))
    n = F.greatest(F.lit(1), F.col("n"))
    covered = F.size(F.filter("t", lambda w: F.exists("c", lambda c: F.contains(F.lower(c), F.lower(w)))))
    sets = F.transform("c", lambda c: F.array_distinct(space_parts(F.lower(c))))
    x = x.withColumn("s", sets)
    pairs = lambda a: F.flatten(F.transform(a, lambda y, i: F.transform(F.slice(a, i + 2, F.size(a)), lambda z: jaccard(y, z))))
    x = x.withColumns({"p10": pairs(F.slice("s", 1, 10)), "dups": F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n"))), lambda j: (F.col("n") > 0) & F.exists(F.slice("s", 1, j - 1), lambda y: jaccard(y, F.try_element_at(F.col("s"), j)) > 0.8)))})
    x = x.withColumns({
        "relevance": total(F.transform("c", share)) / n,
        "completeness": F.when(F.col("n") > 0, 0.4 * F.least(F.col("n") / 10, F.lit(1.0)) + 0.3 * F.least(total(F.transform("c", lambda c: F.length(c).cast("double"))) / n / 500, F.lit(1.0)) + 0.3 * F.when(F.size("t") > 0, covered / F.greatest(F.lit(1), F.size("t"))).otherwise(0.0)).otherwise(0.0),
        "diversity": F.when(F.size("p10") > 0, F.greatest(F.lit(0.0), 1 - total("p10") / F.greatest(F.lit(1), F.size("p10")))).otherwise(0.0),
        "credibility": F.when(F.col("n") > 0, half(0.8, lambda y: y.reliability)).otherwise(0.0),
        "freshness": F.when(F.col("n") > 0, half(0.7, lambda y: F.when(y.age_days.isNotNull(), F.greatest(F.lit(0.0), 1 - y.age_days / 365)))).otherwise(0.0),
    })
    overall = 0.35 * F.col("relevance") + 0.25 * F.col("completeness") + 0.15 * F.col("diversity") + 0.15 * F.col("credibility") + 0.10 * F.col("freshness")
    return x.select("qid", "n", "relevance", "completeness", "diversity", "credibility", "freshness", overall.alias("overall"), F.col("dups").alias("duplicates"))


def issues(quality: DataFrame) -> DataFrame:
    """(qid, issue, severity)."""
    of = lambda cond, name, severity: F.when(cond, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity")))
    c = F.col
    found = F.array_compact(F.array(of(c("n") < 5, "InsufficientResults", 4), of(c("relevance") < 0.5, "InsufficientRelevance", 5), of(c("diversity") < 0.3, "LackOfDiversity", 3), of(c("duplicates") > 0, "DuplicateResults", 2)))
    return quality.select("qid", F.explode(found).alias("x")).select("qid", "x.*")


def refinements(queries: DataFrame, found: DataFrame, most: int = 5) -> DataFrame:
    """(qid, refined, kind, gain): rewritten queries for the issues found, and synonyms, best first."""
    q = queries.select("qid", "text")
    x = found.join(q, "qid")
    t, i = F.col("text"), F.col("issue")
    by = lambda kind, gain, c: F.struct(c.alias("refined"), F.lit(kind).alias("kind"), F.lit(gain).alias("gain"))
    made = F.when(i == "InsufficientResults", by("Generalization", 0.7, analyze.generalized(t))).when(i == "InsufficientRelevance", by("ContextAddition", 0.8, analyze.with_context(t))).when(i == "LackOfDiversity", by("Restructuring", 0.6, analyze.restructured(t)))
    rows = x.select("qid", made.alias("m")).where("m is not null").select("qid", "m.*")
    same = analyze.synonyms(t)
    more = q.where(F.size(same) > 0).select("qid", F.concat(t, F.lit(" "), F.array_join(F.slice(same, 1, 2), " ")).alias("refined"), F.lit("SynonymReplacement").alias("kind"), F.lit(0.6).alias("gain"))
    w = Window.partitionBy("qid").orderBy(F.desc("gain"), "kind")
    return rows.unionByName(more).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def self_rag(corpus: DataFrame, queries: DataFrame, rounds: int = 3, least: float = 0.7, enough: int = 5, k: int = 20) -> DataFrame:
    """(qid, round, overall, doc_id, rank): searches until a query's results are good enough, three times at most.

    Each round takes only the queries still open, rewritten by their best refinement; the last one accepts whatever there is. A round's
    open queries, hits and quality are written, so each round's plan begins at tables and no plan grows with the rounds.
    """
    open_, out = kept(queries.select("qid", "text", "vec"), "open"), None
    for i in range(1, rounds + 1):
        hits = kept(adaptive(corpus, open_, k).select("qid", "doc_id", "score", "rank"), "hits")
        quality = kept(assessed(hits, open_, corpus), "quality")
        good = quality.where((F.col("overall") >= least) & (F.col("n") >= enough)) if i < rounds else quality
        part = hits.join(good.select("qid", "overall"), "qid").withColumn("round", F.lit(i)).select("qid", "round", "overall", "doc_id", "rank")
        out = part if out is None else out.unionByName(part)
        if i == rounds:
            break
        left = quality.join(good.select("qid"), "qid", "left_anti")
        better = refinements(open_, issues(left), 1).select("qid", "refined")
        after = open_.join(left.select("qid"), "qid").join(better, "qid", "left").select("qid", F.coalesce("refined", "text").alias("text"), "vec")
        open_ = kept(after, "open")
        if open_.isEmpty():
            break
    return out


def suggestions(quality: DataFrame) -> DataFrame:
    """(qid, place, suggestion, severity): what to do about the issues of each query, most severe first."""
    found = issues(quality)
    what = F.when(F.col("issue") == "InsufficientRelevance", "ContextAddition").when(F.col("issue") == "InsufficientResults", "Generalization")
    what = what.when(F.col("issue") == "LackOfDiversity", "Restructuring").otherwise("Deduplication")
    w = Window.partitionBy("qid").orderBy(F.desc("severity"), "issue")
    return found.select("qid", F.row_number().over(w).alias("place"), what.alias("suggestion"), "severity")
