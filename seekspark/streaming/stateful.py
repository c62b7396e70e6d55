"""Keyed state with timers: the alert store, and a cache whose entries expire.

Both run on event time. State is kept for each key, or bucket of keys, in the state store beside the checkpoint, and a timer takes it away, so it does
not grow with the length of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MS = timedelta(milliseconds=1)
#: Buckets of alerts; a call to keyed state costs about a millisecond, so it is paid for a bucket and not for an alert.
BUCKETS = 4096
#: Keyed state with timers needs this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def store_provider(spark: SparkSession) -> Iterator[None]:
    """Queries that start within it keep their state where timers can."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def _ms(t: datetime) -> int:
    return int(t.timestamp() * 1000)


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


class AlertStore(StatefulProcessor):
    """Of each (event_id, alert): when it was raised and resolved. A resolved alert is cleaned `retention` after it was resolved.

    Of several times the earliest counts. A resolution that comes before its alert waits for it, and is cleaned like others.
    Alerts are kept by bucket, as one row of lists that is read and written once a batch; a bucket's one timer is that of the first to be cleaned.
    """

    def __init__(self, retention: timedelta):
        self.retention = retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alerts = handle.getValueState("alerts", "event_id array<long>, alert array<string>, severity array<string>, raised array<long>, resolved array<long>")

    def _held(self) -> dict[tuple, tuple]:
        ids, alerts, *rest = self.alerts.get() or ([],) * 5
        return dict(zip(zip(ids, alerts, strict=True), zip(*rest, strict=True), strict=True))

    def _keep(self, held: dict[tuple, tuple], timer: int | None) -> None:
        """Writes the list, and sets the timer that was `timer` anew."""
        if held:
            self.alerts.update(tuple(list(c) for c in zip(*(k + x for k, x in held.items()), strict=True)))
        else:
            self.alerts.clear()
        first = self._first(held)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def _first(self, held: dict[tuple, tuple]) -> int | None:
        return min((self._cleaned(x[2]) for x in held.values() if x[2] is not None), default=None)

    def _row(self, k: tuple, x: tuple, status: str) -> Row:
        return Row(event_id=k[0], alert=k[1], severity=x[0], status=status, raised=x[1], resolved=x[2])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held()
        timer, met = self._first(held), set()
        for r in rows:
            k, at = (r.event_id, r.alert), r.micros
            severity, raised, resolved = held.get(k, (None, None, None))
            if r.resolution:
                resolved = at if resolved is None else min(resolved, at)
            else:
                severity, raised = r.severity, at if raised is None else min(raised, at)
            held[k] = severity, raised, resolved
            met.add(k)
        self._keep(held, timer)
        for k in met:
            if held[k][1] is not None:
                yield self._row(k, held[k], "Open" if held[k][2] is None else "Resolved")

    def _cleaned(self, resolved: int) -> int:
        return resolved // 1000 + self.retention // MS

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, mark, expired = self._held(), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        over = {k: x for k, x in held.items() if x[2] is not None and (self._cleaned(x[2]) < mark or self._cleaned(x[2]) <= expired)}
        self._keep({k: x for k, x in held.items() if k not in over}, None)  # the timer is gone as it has expired
        for k, x in over.items():
            if x[1] is not None:
                yield self._row(k, x, "Cleaned")

    def close(self) -> None:
        pass


def alert_store(raised: DataFrame, resolutions: DataFrame, retention: timedelta = timedelta(hours=24), delay: str = "24 hours", buckets: int = BUCKETS) -> DataFrame:
    """(event_id, alert, severity, status, raised_at, resolved_at): a row each time an alert is raised, resolved or cleaned.

    raised: (event_id, ts, alert, severity); resolutions: (event_id, alert, resolved_at); both are streams.
    """
    a = raised.selectExpr("event_id", "alert", "severity", "ts at", "false resolution").withWatermark("at", delay)
    b = resolutions.selectExpr("event_id", "alert", "string(null) severity", "resolved_at at", "true resolution").withWatermark("at", delay)
    events = a.unionByName(b).withColumn("micros", F.unix_micros("at")).withColumn("bucket", F.pmod(F.xxhash64("event_id", "alert"), F.lit(buckets)))
    out = "event_id long, alert string, severity string, status string, raised long, resolved long"
    rows = events.groupBy("bucket").transformWithState(AlertStore(retention), out, "Update", "EventTime")
    return rows.select("event_id", "alert", "severity", "status", F.timestamp_micros("raised").alias("raised_at"), F.timestamp_micros("resolved").alias("resolved_at"))


class Expiring(StatefulProcessor):
    """An entry for each key: it ends `sliding` after its last use, and `absolute` after it was made, if that is sooner.

    A use at or after the end makes a new entry. A use that arrives late, from before the entry's last use, counts as a hit and moves no
    time.
    """

    def __init__(self, sliding: timedelta, absolute: timedelta):
        self.sliding, self.absolute = sliding // timedelta(microseconds=1), absolute // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "created long, used long, hits long")

    def _end(self, created: int, used: int) -> int:
        return min(used + self.sliding, created + self.absolute)

    def _row(self, key: tuple, entry: tuple) -> Row:
        return Row(key=key[0], created=entry[0], used=entry[1], hits=entry[2], ended=self._end(entry[0], entry[1]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        entry = self.entry.get()
        entry = tuple(entry) if entry else None
        timer = self._end(*entry[:2]) if entry else None
        for at in sorted(r.micros for r in rows):
            if entry and at >= self._end(*entry[:2]):
                yield self._row(key, entry)
                entry = None
            entry = (entry[0], max(entry[1], at), entry[2] + 1) if entry else (at, at, 0)
        end = self._end(*entry[:2])
        self.entry.update(entry)
        if timer != end:
            if timer is not None:
                self.handle.deleteTimer(timer // 1000)
            self.handle.registerTimer(end // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        entry = self.entry.get()
        if entry:
            self.entry.clear()
            yield self._row(key, tuple(entry))

    def close(self) -> None:
        pass


def expiring_cache(uses: DataFrame, key: str, at: str = "ts", sliding: timedelta = timedelta(minutes=15), absolute: timedelta = timedelta(hours=1), delay: str = "1 hour") -> DataFrame:
    """(key, created, used, hits, ended): each entry of the cache when it has ended. `uses` is a stream of look-ups by key."""
    events = uses.select(F.col(key).alias("key"), F.col(at).alias("at")).withWatermark("at", delay).withColumn("micros", F.unix_micros("at"))
    out = "key string, created long, used long, hits long, ended long"
    rows = events.groupBy("key").transformWithState(Expiring(sliding, absolute), out, "Append", "EventTime")
    return rows.select("key", *(F.timestamp_micros(c).alias(c) for c in ("created", "used")), "hits", F.timestamp_micros("ended").alias("ended"))
