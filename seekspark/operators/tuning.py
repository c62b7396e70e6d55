"""Index parameters as rows: formulas, estimates, validation, tuning grids, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# M, construction and search width of the templates, and what the formulas multiply them by.
TEMPLATES = [("Speed", 16, 100, 50, 0.8, 0.7), ("Balanced", 32, 200, 100, 1.0, 1.0), ("Quality", 48, 400, 200, 1.2, 1.3)]
CANDIDATES = {
    "speed": [(8, 32, 16), (12, 48, 24), (16, 64, 32)], "accuracy": [(24, 128, 80), (32, 256, 120), (40, 512, 160)], "memory": [(4, 16, 10), (6, 24, 15), (8, 32, 20)], "balanced": [(12, 60, 40), (20, 100, 60), (24, 120, 70)],
}
LADDERS = {"latency": (20, 30, 50), "recall": (5, 10, 15), "memory": (30, 60, 100), "qps": (15, 25, 40)}


def _rows(columns: str, rows: list[tuple]) -> Column:
    """Fixed rows as an array of structs, to be exploded beside each row of a table."""
    return F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(columns.split(), r, strict=True))) for r in rows))


def collections(rows: DataFrame, by: str, growth: list[int], width: list[int]) -> DataFrame:
    """(by, growth, n, dim): how many vectors (vec) each collection has and how long they are, now and when it has grown so many times and takes a model so many times as wide."""
    own = rows.where("vec is not null").groupBy(by).agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"))
    each = own.withColumn("growth", F.explode(F.array(*map(F.lit, growth)))).withColumn("w", F.explode(F.array(*map(F.lit, width))))
    return each.select(by, "growth", (F.col("n") * F.col("growth")).alias("n"), (F.col("dim") * F.col("w")).cast("long").alias("dim"))


def parameters(cases: DataFrame) -> DataFrame:
    """Adds m, efc, efs, layer, metric to cases (n, dim), for each target."""
    x = cases.withColumn("t", F.explode(_rows("target m0 efc0 efs0 mf cf", TEMPLATES))).select(*cases.columns, "t.*")
    n, d = F.col("n"), F.col("dim")
    size = F.when(n < 1000, 0.8).when(n < 10_000, 0.9).when(n < 100_000, 1.0).when(n < 1_000_000, 1.1).otherwise(1.2)
    wide = F.when(d < 100, 0.85).when(d < 512, 1.0).when(d < 1024, 1.1).otherwise(1.15)
    x = x.withColumn("m", F.least(F.lit(64), F.greatest(F.lit(8), (F.bround(F.round(F.col("m0") * size * wide * F.col("mf") / 2, 9)) * 2).cast("int"))))
    efc = F.least(F.round(F.greatest(F.col("efc0") * size, F.lit(4.0) * F.col("m")) * F.col("cf"), 9).cast("int"), F.lit(800))
    efs = F.when(F.col("target") == "Speed", F.greatest(0.6 * F.col("efs0"), F.col("m"))).when(F.col("target") == "Balanced", F.col("efs0")).otherwise(1.4 * F.col("efs0"))
    layer = F.lit(1.44) * F.when(n > 1_000_000, 1.1).otherwise(1.0) * F.when(d > 1000, 0.95).otherwise(1.0)
    metric = F.when(d >= 512, "cosine").when(F.col("target") == "Speed", "dot").otherwise("euclidean")
    return x.withColumns({"efc": F.greatest(F.col("m"), efc), "efs": F.least(F.lit(500), F.greatest(F.lit(10), F.round(efs, 9).cast("int"))), "layer": F.least(F.lit(2.0), F.greatest(F.lit(1.1), layer)), "metric": metric}).drop("m0", "efc0", "efs0", "mf", "cf")


def estimates(rows: DataFrame, cores: int = 8) -> DataFrame:
    """Adds memory_bytes, build_seconds, latency_ms, recall, qps, p95_ms to rows (n, dim, m, efc, efs, layer, metric)."""
    n, d, m, efc, efs = (F.col(c).cast("double") for c in ("n", "dim", "m", "efc", "efs"))
    memory = 4 * n * d + F.floor(n * 1.2 * m * 8) + F.floor(F.round(4 * n / (1 - 1 / F.col("layer")), 6)) + F.greatest(64 * n, F.lit(1048576.0))
    cpu = 1 / min(0.7 * cores, 4) if cores > 1 else 1.0
    build = F.least(F.greatest(F.lit(1.0), n * F.ln(n) * m * efc * 1e-9 * cpu), F.greatest(F.lit(1.0), 0.1 * n))
    cost = F.when(F.col("metric") == "cosine", 1.2).when(F.col("metric") == "manhattan", 0.8).when(F.col("metric") == "dot", 0.7).otherwise(1.0)
    x = rows.withColumns({"memory_bytes": memory.cast("long"), "build_seconds": build, "latency_ms": F.greatest(F.lit(0.1), 1000 * (efs * d * 1e-6 * cost + 0.01 * F.ln(efs)))})
    recall = F.least(F.lit(0.99), 0.85 * F.least(m / 32, F.lit(1.5)) * F.least(efs / 100, F.lit(2.0)) * F.when(n > 100_000, 0.98).otherwise(1.0))
    return x.withColumns({"recall": recall, "qps": F.least(F.lit(10000.0), 1000 / (F.col("latency_ms") / 10)), "p95_ms": 2.5 * F.col("latency_ms")})


def validation(rows: DataFrame) -> DataFrame:
    """Adds `errors`: which bounds (m, efc, efs, layer) break."""
    c = F.col
    return rows.withColumn("errors", F.array_compact(F.array(F.when(~c("m").between(4, 128), "m"), F.when(c("efc") < c("m"), "efc"), F.when(~c("efs").between(10, 2000), "efs"), F.when((c("layer") <= 0) | (c("layer") > 5), "layer"))))


def constrained(rows: DataFrame, max_memory_mb: int, max_build_minutes: float) -> DataFrame:
    """Shrinks m to the memory, and efc to the time, that there is."""
    most = F.lit(float(max_memory_mb) * 1048576)
    over = F.col("memory_bytes") > most
    m = F.when(over, F.greatest(F.lit(8), F.floor(F.col("m") * F.sqrt(most / F.col("memory_bytes"))).cast("int"))).otherwise(F.col("m"))
    x = rows.withColumn("m", m)
    slow = F.col("build_seconds") / 60 > max_build_minutes
    efc = F.when(slow, F.greatest(F.col("m"), F.floor(F.col("efc") * F.sqrt(max_build_minutes / (F.col("build_seconds") / 60))).cast("int"))).otherwise(F.col("efc"))
    return x.withColumn("efc", efc)


def grid(cases: DataFrame) -> DataFrame:
    """Adds strategy, m, efc, efs to cases: the candidates of every tuning strategy for each."""
    rows = [(k, *x) for k, v in CANDIDATES.items() for x in v]
    return cases.withColumn("t", F.explode(_rows("strategy m efc efs", rows))).select(*cases.columns, "t.*")


def variations(base: DataFrame) -> DataFrame:
    """Eleven rows around each (m, efc, efs): five of m, three of each width; the base itself comes three times. Other columns stay."""
    at = lambda m=0, c=0, s=0: F.struct(F.lit(m).alias("a"), F.lit(c).alias("b"), F.lit(s).alias("c"))
    some = [at(m=i) for i in range(-2, 3)] + [at(c=i) for i in (-1, 0, 1)] + [at(s=i) for i in (-1, 0, 1)]
    others = [c for c in base.columns if c not in ("m", "efc", "efs")]
    move = lambda low, of, n, by: F.greatest(F.lit(low), F.col(of) + n * F.col("x")[by]).cast("int").alias(of)
    return base.withColumn("x", F.explode(F.array(*some))).select(*others, move(4, "m", 2, "a"), move(16, "efc", 16, "b"), move(10, "efs", 10, "c"))


def performance(recall: Column, ms: Column, memory: Column, wr: Column, ws: Column, wm: Column) -> Column:
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    mib = 100.0 * 1048576
    return recall * wr + unit((100 - ms) / 100) * ws + unit((mib - memory) / mib) * wm


def scored(rows: DataFrame) -> DataFrame:
    """Adds `score` to rows (strategy, recall, latency_ms, memory_bytes), by their strategy's weights."""
    s = F.col("strategy")
    pick = lambda speed, accuracy, memory, other: F.when(s == "speed", speed).when(s == "accuracy", accuracy).when(s == "memory", memory).otherwise(other)
    weights = pick(0.2, 0.7, 0.3, 0.4), pick(0.6, 0.2, 0.2, 0.4), pick(0.2, 0.1, 0.5, 0.2)
    return rows.withColumn("score", performance(F.col("recall"), F.col("latency_ms"), F.col("memory_bytes"), *weights))


def tuned(rows: DataFrame, share: int = 3, order: tuple[str, ...] = ("m",), by: tuple[str, ...] = ()) -> DataFrame:
    """The best n div share by score of each strategy (and of each case, whose columns are `by`), one at least."""
    x = scored(rows)
    group = Window.partitionBy(*by, "strategy")
    w = group.orderBy(F.desc(F.round("score", 9)), *order)
    return x.withColumns({"r": F.row_number().over(w), "n_all": F.count("*").over(group)}).where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n_all") / share))).drop("n_all")


def staged(cases: DataFrame, measure) -> DataFrame:
    """Cases with strategy, m, efc, efs, score, ...: tuning in stages. `measure` adds what was measured, or is estimated, of rows.

    The best third of each strategy's candidates is varied, and of the best fifth of the variations the first is taken.
    """
    by = tuple(cases.columns)
    best = tuned(measure(grid(cases)), by=by).select(*by, "strategy", "m", "efc", "efs")
    fine = tuned(measure(variations(best).distinct()), 5, ("m", "efc", "efs"), by)
    return fine.where("r = 1")


def around(base: DataFrame, radius: int) -> DataFrame:
    """Rows (m, efc, efs) up to `radius` steps from each row of `base` in every direction. Other columns stay."""
    others = [c for c in base.columns if c not in ("m", "efc", "efs")]
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    x = base.withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps)).withColumn("c", F.explode(steps))
    move = lambda low, of, n, by: F.greatest(F.lit(low), F.col(of) + n * F.col(by)).cast("int").alias(of)
    return x.select(*others, move(4, "m", 2, "a"), move(16, "efc", 16, "b"), move(10, "efs", 10, "c")).distinct()


def baseline(samples: DataFrame) -> DataFrame:
    """(index, n, latency): what later samples (index, latency) are held against."""
    return samples.groupBy("index").agg(F.count("*").alias("n"), F.avg("latency").alias("latency"))


def against(base: DataFrame, now: DataFrame, metric: str = "latency") -> DataFrame:
    """(index, percent, severity): how far each index got worse than its baseline."""
    x = base.select("index", F.col(metric).alias("old")).join(now.select("index", F.col(metric).alias("new")), "index")
    percent = 100 * (F.col("new") - F.col("old")) / F.col("old")
    return x.select("index", percent.alias("percent"), severity(percent, F.lit(metric)).alias("severity"))


def within(rows: DataFrame, max_ms: float = 50, min_recall: float = 0.9, max_mb: int = 4096, max_minutes: float = 30) -> DataFrame:
    return rows.where((F.col("latency_ms") <= max_ms) & (F.col("recall") >= min_recall) & (F.col("memory_bytes") <= max_mb * 1048576) & (F.col("build_seconds") <= max_minutes * 60))


def efficiency(scans: Column, read: Column, fetched: Column) -> Column:
    """Share of read entries that were fetched, damped by how many a scan reads."""
    ok = (scans > 0) & (read > 0)
    return F.when(ok, F.least(F.lit(1.0), (fetched / F.when(ok, read)) / F.log10(F.greatest(F.lit(10.0), read / F.when(ok, scans))))).otherwise(0.0)


def severity(percent: Column, metric: Column) -> Column:
    """None, Minor, Major or Critical by how far a metric got worse, in percent."""
    out = None
    for name, (a, b, c) in LADDERS.items():
        step = F.when(percent > c, "Critical").when(percent > b, "Major").when(percent > a, "Minor").otherwise("None")
        out = F.when(metric == name, step) if out is None else out.when(metric == name, step)
    return out.otherwise("None")
