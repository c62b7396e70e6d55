"""Fusion of ranked lists (qid, doc_id, score, rank): two arms by one of five methods, or any number of named arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .lexical import top

RRF_K = 60


def _paired(v: DataFrame, s: DataFrame, how: str) -> DataFrame:
    a = v.select("qid", "doc_id", F.col("score").alias("v"), F.col("rank").alias("rv"))
    b = s.select("qid", "doc_id", F.col("score").alias("s"), F.col("rank").alias("rs"))
    return a.join(b, ["qid", "doc_id"], how)


def _finish(df: DataFrame, score: Column, k: int, least: float) -> DataFrame:
    source = F.when(F.col("v").isNotNull() & F.col("s").isNotNull(), "Both").when(F.col("v").isNotNull(), "Vector").otherwise("Sparse")
    out = df.select("qid", "doc_id", score.alias("score"), source.alias("source"))
    return top(out.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") >= least)), k)


def rrf(v: DataFrame, s: DataFrame, wv: float = 0.7, ws: float = 0.3, k: int = 10, c: int = RRF_K, least: float = 0.0) -> DataFrame:
    part = lambda w, r: F.coalesce(w / (c + F.col(r)), F.lit(0.0))
    return _finish(_paired(v, s, "full"), part(F.lit(wv), "rv") + part(F.lit(ws), "rs"), k, least)


def weighted_sum(v: DataFrame, s: DataFrame, wv: float = 0.7, ws: float = 0.3, k: int = 10, least: float = 0.0) -> DataFrame:
    """Scores are shares of their arm's largest."""
    w = Window.partitionBy("qid")
    x = _paired(v, s, "full").withColumns({"mv": F.max("v").over(w), "ms": F.max("s").over(w)})
    share = lambda weight, a, m: F.coalesce(weight * F.when(F.col(m) != 0, F.col(a) / F.col(m)), F.lit(0.0))
    return _finish(x, share(F.lit(wv), "v", "mv") + share(F.lit(ws), "s", "ms"), k, least)


def product(v: DataFrame, s: DataFrame, k: int = 10, least: float = 0.0) -> DataFrame:
    """Geometric mean of what both arms found; a negative product has none."""
    p = F.col("v") * F.col("s")
    return _finish(_paired(v, s, "inner"), F.when(p >= 0, F.sqrt(p)), k, least)


def maximum(v: DataFrame, s: DataFrame, wv: float = 0.7, ws: float = 0.3, k: int = 10, least: float = 0.0) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return _finish(_paired(v, s, "full"), F.greatest(wv * zero("v"), ws * zero("s")), k, least)


def harmonic(v: DataFrame, s: DataFrame, wv: float = 0.7, ws: float = 0.3, k: int = 10, least: float = 0.0) -> DataFrame:
    a, b = wv * F.col("v"), ws * F.col("s")
    return _finish(_paired(v, s, "inner"), F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0), k, least)


def combined(v: DataFrame, s: DataFrame, wv: float = 0.7) -> DataFrame:
    """Weighted where both arms have a document; alone, the vector arm keeps its score and the other is weighted. All rows, ranked."""
    both = wv * F.col("v") + (1 - wv) * F.col("s")
    score = F.when(F.col("v").isNotNull(), F.when(F.col("s").isNotNull(), both).otherwise(F.col("v"))).otherwise((1 - wv) * F.col("s"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return _paired(v, s, "full").select("qid", "doc_id", score.alias("score")).withColumn("rank", F.row_number().over(w))


def _odds(weights: tuple[float, float, float]) -> Column:
    a, b, c = weights
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    return 1 / (1 + F.exp(-(a * zero("v") + b * zero("s") + c)))


def learned(v: DataFrame, s: DataFrame, weights: tuple[float, float, float], k: int = 10, least: float = 0.0) -> DataFrame:
    """A logistic model over the arms' scores (weights of both, and a constant)."""
    return _finish(_paired(v, s, "full"), _odds(weights), k, least)


def fit(v: DataFrame, s: DataFrame, good: DataFrame, steps: int = 16, rate: float = 0.5) -> DataFrame:
    """(labelled, a, b, c, loss, improves): the logistic model's weights by gradient descent; documents in `good` (doc_id) are right.

    A step is one sum over the pairs, of which five numbers reach the driver. A step that makes the loss larger is taken back, and
    the next is half as long.
    """
    y = F.coalesce("y", F.lit(0.0)).alias("y")
    pairs = kept(_paired(v, s, "full").join(good.select("doc_id", F.lit(1.0).alias("y")).distinct(), "doc_id", "left").select("v", "s", y), "pairs")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))

    def at(w: tuple[float, float, float]):
        p, y = _odds(w), F.col("y")
        loss = F.avg(-(y * F.ln(p + 1e-12) + (1 - y) * F.ln(1 - p + 1e-12)))
        return pairs.agg(loss, F.avg((p - y) * zero("v")), F.avg((p - y) * zero("s")), F.avg(p - y), F.count("*")).first()

    w = (1.0, 0.0, 0.0)
    best = first = at(w)
    for _ in range(steps if first[4] else 0):
        size = max(sum(x * x for x in best[1:4]) ** 0.5, 1e-12)
        moved = tuple(x - rate * g / size for x, g in zip(w, best[1:4], strict=True))
        now = at(moved)
        if now[0] < best[0]:
            w, best = moved, now
        else:
            rate /= 2
    row = (first[4], *w, best[0], (best[0] or 0.0) < (first[0] or 0.0))
    return pairs.sparkSession.createDataFrame([row], "labelled long, a double, b double, c double, loss double, improves boolean")


METHODS = {"RRF": rrf, "WeightedSum": weighted_sum, "Maximum": maximum, "HarmonicMean": harmonic, "Product": lambda v, s, wv=None, ws=None, k=10, least=0.0: product(v, s, k, least)}


def normalized(results: DataFrame, by: list[str]) -> DataFrame:
    """Scores to 0..1 within each group; a group of equal scores gets 1."""
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return results.withColumn("score", F.when(high - low <= 1e-12, 1.0).otherwise((F.col("score") - low) / F.when(high > low, high - low)))


def rrf_many(arms: dict[str, DataFrame], k: int = 10, c: int = RRF_K) -> DataFrame:
    """Sum of 1 / (c + rank) over all arms, unweighted; sources are joined by comma in order of name."""
    return _gathered(arms, lambda name: 1.0 / (c + F.col("rank")), k)


def weighted_many(arms: dict[str, tuple[DataFrame, float]], k: int = 10) -> DataFrame:
    """Sum of normalised scores by normalised weights."""
    total = sum(w for _, w in arms.values())
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return _gathered({n: normalized(d, ["qid"]) for n, (d, _) in arms.items()}, lambda name: F.lit(arms[name][1] / total) * F.col("score"), k)


def _gathered(arms: dict[str, DataFrame], score, k: int) -> DataFrame:
    rows = None
    for name, df in sorted(arms.items()):
        x = df.select("qid", "doc_id", score(name).alias("score"), F.lit(name).alias("source"))
        rows = x if rows is None else rows.unionByName(x)
    return top(rows.groupBy("qid", "doc_id").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source")), k)
