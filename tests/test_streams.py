"""Streams over several files, and what failed before: state that an empty batch lost, caps that dropped near entries, one hot range."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekspark.catalog import monitoring
from seekspark.operators import cache, intervals, monitor, nearest
from seekspark.sources.shared import place
from seekspark.streaming import feed, stateful
from seekspark.streaming import monitoring as streams

DAY = datetime(2024, 1, 1)


def files(spark, parts, schema):
    """A stream of the given lists of rows, one file each."""
    path = place(spark, "files")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_sampled_keeps_its_state_over_an_empty_file(spark):
    schema = "at long, efficiency double, scans long"
    first = [(i, 0.9, 10) for i in range(1, 10)]
    then = [(i, 0.9, 5000) for i in range(10, 20)]
    got = streams.sampled(files(spark, [first, [], then], schema)).collect()
    assert [(r.at, r.kind) for r in got] == [(10, "ScanIncrease")]


def test_sampled_by_time_and_not_by_batch(spark):
    """A sample that comes late is held against the one before it by `at`, which an earlier batch brought."""
    schema = "at long, efficiency double, scans long"
    got = streams.sampled(files(spark, [[(1, 0.9, 10), (5, 0.9, 9000)], [(3, 0.9, 20), (6, 0.9, 9100)]], schema)).collect()
    assert sorted((r.at, r.kind) for r in got) == [(5, "ScanIncrease")]


def test_alerts_are_raised_resolved_and_cleaned(spark):
    at = lambda h: DAY + timedelta(hours=h)
    raised = [[(1, at(0), "Slow", "Warning"), (2, at(1), "Slow", "Warning")], [(3, at(30), "Fail", "Critical")], [], [(4, at(80), "Slow", "Warning"), (5, at(79), "Late", "Warning")], [(6, at(110), "Slow", "Warning")]]
    over = [[(1, "Slow", at(2))], [(3, "Fail", at(90)), (3, "Fail", at(31))], [], [(4, "Slow", at(81))], [(9, "Unknown", at(112))]]
    a = files(spark, raised, "event_id long, ts timestamp, alert string, severity string")
    b = files(spark, over, "event_id long, alert string, resolved_at timestamp")
    got = streams.drain(stateful.alert_store(a, b), ["event_id", "alert"], timers=True)
    assert {r.event_id: r.status for r in got.collect()} == {1: "Cleaned", 2: "Open", 3: "Cleaned", 4: "Resolved", 5: "Open", 6: "Open"}


def test_entries_expire(spark):
    """15 minutes after the last use, an hour after they were made; a late use is a hit and moves no time."""
    m = lambda x: DAY + timedelta(minutes=x)
    parts = [[("a", m(0)), ("a", m(10)), ("b", m(0))], [("a", m(20)), ("a", m(5))], [], [("a", m(34)), ("a", m(48)), ("a", m(59)), ("a", m(61))], [("c", m(500))]]
    got = streams.drain(stateful.expiring_cache(files(spark, parts, "query string, ts timestamp"), "query"), timers=True).collect()
    want = {("a", m(0), m(59), 6, m(60)), ("a", m(61), m(61), 0, m(76)), ("b", m(0), m(0), 0, m(15))}
    assert {tuple(r) for r in got} == want


def test_quantiles_of_windows_within_their_bound(spark):
    """A window of more values than the sketch holds, in several batches."""
    n = 40_000
    rows = spark.range(n).selectExpr("id event_id", "timestamp '2024-01-01' + make_dt_interval(0, 0, 0, id) ts", "'q' query", "'s' strategy", "pow(cast(pmod(xxhash64(id), 1000003) as double), 3) response_ms", "1 results", "0.5D similarity", "0.5D diversity", "true success")
    got = streams.drain(streams.dashboard(feed.arriving(rows, "ts", parts=1), "10 days"), ["start"]).collect()
    values = np.sort(np.array([r.response_ms for r in rows.select("response_ms").collect()]))
    assert sum(r.queries for r in got) == n
    (one,) = [r for r in got if r.queries > 0.5 * n]
    for p, q in ((0.95, one.p95_ms), (0.99, one.p99_ms)):
        assert abs(np.searchsorted(values, q, "right") / n - p) < 0.003 + (n - one.queries) / n


def test_dashboard_by_values_is_exact(spark):
    """A window of more values than a sketch holds, in several batches: the percentiles are values of their exact ranks."""
    n = 20_000
    rows = spark.range(n).selectExpr("id event_id", "timestamp '2024-01-01' + make_dt_interval(0, 0, 0, id * 4) ts", "'q' query", "'s' strategy", "if(id = 5, null, pow(cast(pmod(xxhash64(id), 1000003) as double), 3)) response_ms", "1 results", "0.5D similarity", "0.5D diversity", "id % 3 > 0 success")
    got = streams.exact_dashboard(streams.drain(streams.by_value(feed.arriving(rows, "ts", parts=1)), ["start", "response_ms"], timers=True)).collect()
    values = sorted(r.response_ms for r in rows.select("response_ms").where("response_ms is not null").collect())
    (one,) = got
    assert (one.queries, one.successes, one.avg_results) == (n, n - -(-n // 3), 1.0)
    assert (one.p95_ms, one.p99_ms) == tuple(values[-(-p * len(values) // 100) - 1] for p in (95, 99))
    assert abs(one.avg_ms / (sum(values) / len(values)) - 1) < 1e-9


def test_chunks_arrive_in_more_files_than_batches(spark, monkeypatch):
    """The documents are dealt out to four batches of as many files as a shuffle has parts."""
    seen = []
    monkeypatch.setattr(monitoring, "place", lambda s, name: seen.append(place(s, name)) or seen[-1])
    assert not monitoring.stream_chunks(spark, "/root/testdata/sf0.001").isEmpty()
    assert len(spark.read.parquet(seen[0]).inputFiles()) == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_feed_is_the_table(spark):
    rows = spark.range(1000).selectExpr("id event_id", "timestamp '2024-01-01' + make_dt_interval(0, 0, id * 40) ts")
    path = feed.feed(rows, "ts", F.when(F.col("event_id") % 7 == 0, 1).when(F.col("event_id") % 11 == 0, 2))
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == list(range(1000))


def test_eviction_looks_at_all_that_are_alike(spark):
    """25 equal entries: only the most used stays."""
    rows = [(i, [1.0, 0.0], i) for i in range(25)] + [(100, [0.0, 1.0], 1), (101, None, 5), (102, [0.0, 0.0], 5), (103, [1.0], 0)]
    got = cache.evict_similar(spark.createDataFrame(rows, "entry_id long, vec array<double>, hits int"))
    assert sorted(r.entry_id for r in got.collect()) == [24, 100, 101, 102, 103]


@pytest.mark.parametrize("least", [0.5, 0.9, 0.99])
def test_outshone(spark, monkeypatch, least):
    r = np.random.default_rng(3)
    x = r.normal(size=(12, 8))[r.integers(0, 12, 500)] + r.normal(size=(500, 8)) * 0.15
    use = r.integers(0, 4, 500)
    rows = [(i, v.tolist(), int(u)) for i, (v, u) in enumerate(zip(x, use, strict=True))]
    got = {r.doc_id for r in nearest.outshone(spark.createDataFrame(rows, "doc_id long, vec array<double>, use int"), least).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    better = (use[:, None] > use[None, :]) | ((use[:, None] == use[None, :]) & (np.arange(500)[:, None] < np.arange(500)[None, :]))
    assert got == set(np.flatnonzero(((u @ u.T >= least) & better).any(axis=0)).tolist())


def test_interval_join(spark):
    r = random.Random(2)
    points = [(i, r.randrange(-1000, 100_000), f"k{i % 3}") for i in range(400)] + [(900, None, "k1")]
    spans = [(f"s{i}", s, s + r.choice([0, 1, 2, 3, 50, 4096, 70_000]), f"k{i % 3}") for i, s in enumerate(r.randrange(-1000, 100_000) for _ in range(60))] + [("none", None, 3, "k0"), ("far", 10**9, 10**9 + 5, "k0")]
    a = spark.createDataFrame(points, "id long, at long, k string")
    b = spark.createDataFrame(spans, "name string, start long, stop long, k string")
    joined = intervals.interval_join(a, b, F.col("at"), F.col("start"), F.col("stop"), ["k"], "right")
    got = sorted((x.name, x.id if x.id is not None else -1) for x in joined.collect())
    want = []
    for name, s, e, k in spans:
        inside = [i for i, at, kk in points if None not in (s, at) and kk == k and s <= at < e]
        want += [(name, i) for i in inside] or [(name, -1)]
    assert got == sorted(want)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_buckets_without_their_points(spark):
    """Counts and means of overlapping buckets against brute force, also of values that no decimal holds, without a row for each point in each."""
    r = random.Random(5)
    at = lambda s: None if s is None else DAY + timedelta(seconds=s)
    points = [(at(r.randrange(300)), r.choice([1.25, 0.1, 29.27, None])) for _ in range(400)] + [(at(777), 1e-9), (at(778), float("inf")), (at(779), 1e300), (None, 1.0)]
    spans = [(f"s{i}", at(s), at(s + r.choice([0, 1, 7, 100, 900]))) for i, s in enumerate(r.randrange(-50, 800) for _ in range(60))] + [("none", None, at(3)), ("back", at(9), at(2)), ("same", at(0), at(300)), ("same", at(0), at(300))]
    a, b = spark.createDataFrame(points, "ts timestamp, ms double"), spark.createDataFrame(spans, "name string, start timestamp, stop timestamp")
    out = intervals.bucketed(a, b, "ts", "start", "stop", avg_ms="ms")
    want = []
    for name, s, e in spans:
        inside = [ms for t, ms in points if None not in (s, e, t) and s <= t < e]
        values = [x for x in inside if x is not None]
        want.append((name, len(inside), f"{sum(values) / len(values):.9g}" if values else None))
    assert sorted((x.name, x.queries, None if x.avg_ms is None else f"{x.avg_ms:.9g}") for x in out.collect()) == sorted(want)
    plain = intervals.bucketed(a.where("ms between 0.1 and 30"), b, "ts", "start", "stop", avg_ms="ms")
    assert "_bin" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_percentiles_with_an_outlier(spark):
    """One value of 10^9 puts nearly all others in the first range; it is cut again until it is small."""
    values = [float(i % 5000) / 7 for i in range(20_000)] + [1e9, None]
    df = spark.createDataFrame([(v, "a" if i % 2 else "b") for i, v in enumerate(values)], "ms double, k string")
    got = {r.k: (r.p50, r.p99) for r in monitor.percentiles(df, "ms", [0.5, 0.99], ["k"], ranges=16, most=100).collect()}
    for k in "ab":
        v = sorted(x for i, x in enumerate(values) if x is not None and ("a" if i % 2 else "b") == k)
        assert got[k] == tuple(v[int(p * (len(v) - 1))] for p in (0.5, 0.99))


def test_windows_meet_points_of_their_span(spark):
    """Points of one key against brute force; before, a point was held against all windows of its key."""
    r = random.Random(8)
    at = lambda s: datetime(1969, 12, 31, 20) + timedelta(seconds=s)
    a = [(i, f"k{i % 2}", r.randrange(0, 30_000)) for i in range(80)] + [(90, "k0", 3600), (91, "k1", 0), (92, None, 7)]
    b = [(i, f"k{i % 2}", r.randrange(0, 36_000)) for i in range(200)] + [(300, "k0", 3600), (301, "k0", 7200), (302, "k1", 3599), (303, "k1", 3600)]
    windows = spark.createDataFrame([(i, k, at(s)) for i, k, s in a], "name long, query string, start timestamp")
    points = spark.createDataFrame([(i, k, at(s)) for i, k, s in b], "id long, query string, ts timestamp")
    joined = streams.windowed_points(windows, points, "query")
    assert joined.columns == ["name", "query", "start", "id", "ts"]
    want = sorted((i, j) for i, k, s in a for j, m, t in b if k == m and s <= t < s + 3600)
    assert sorted((x.name, x.id) for x in joined.collect()) == want
    keys = joined._jdf.queryExecution().optimizedPlan().toString().split("Join Inner, ")[1].split("\n")[0]
    assert keys.count(" = ") == 2


@pytest.mark.parametrize("buckets", [1, 3])
def test_alerts_of_a_bucket(spark, buckets):
    """Alerts that share a bucket are resolved and cleaned each at its time; before, each took state and a timer of its own."""
    at = lambda h: DAY + timedelta(hours=h)
    raised = [[(i, at(0), "Slow", "Warning") for i in range(40)] + [(100, at(0), "Slow", "Warning")], [(200, at(60), "Slow", "Warning")], [], [(201, at(90), "Slow", "Warning")], [(202, at(130), "Slow", "Warning")]]
    over = [[(i, "Slow", at(1 + i)) for i in range(0, 40, 2)], [(999, "Slow", at(60))], [], [(200, "Slow", at(91))], [(999, "Slow", at(130))]]
    a = files(spark, raised, "event_id long, ts timestamp, alert string, severity string")
    b = files(spark, over, "event_id long, alert string, resolved_at timestamp")
    rows = streams.drain(stateful.alert_store(a, b, buckets=buckets), schema=None, timers=True, keys=["event_id", "alert", "status"]).collect()
    of = lambda s: sorted(r.event_id for r in rows if r.status == s)
    assert of("Cleaned") == list(range(0, 40, 2)) and of("Resolved") == [*range(0, 40, 2), 200]
    assert of("Open") == [*range(1, 40, 2), 100, 200, 201, 202]
