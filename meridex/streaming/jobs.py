"""Structured Streaming twins of ingest and counters. Event times are zoned timestamps, as watermarks need."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.commits import write_batch_chunks
from ..sources.sinks import upsert_table

HOUR = 3600
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_starting = threading.Lock()


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, whatever the session is set to.

    Map states and timers need it: Spark's default provider refuses them. A stream copies the session's settings when it
    starts, so the session gets its own back and other streams don't notice.
    """
    with _starting:
        before = spark.conf.get(PROVIDER)
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            yield
        finally:
            spark.conf.set(PROVIDER, before)


def upsert_stream(stream: DataFrame, path: str, keys: list[str], hash_column: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch is an upsert by content hash; a batch that is run again changes nothing."""
    put = lambda batch, _: upsert_table(batch.sparkSession, path, batch, keys, hash_column)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def hourly_counts(stream: DataFrame, entity: str, ts: str, late: str = "2 hours") -> DataFrame:
    """(entity, hour_start, n), final once the watermark has passed the hour."""
    per = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), F.col(entity).alias("entity")).agg(F.count("*").alias("n"))
    return per.select("entity", F.col("window.start").alias("hour_start"), "n")


def rolling_counts(stream: DataFrame, entity: str, ts: str, size: str = "24 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(entity, until, n): events in [until - size, until), for each step."""
    per = stream.withWatermark(ts, late).groupBy(F.window(ts, size, step), F.col(entity).alias("entity")).agg(F.count("*").alias("n"))
    return per.select("entity", F.col("window.end").alias("until"), "n")


def activity_runs(stream: DataFrame, entity: str, ts: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(entity, first, until, n): sessions of events without a gap."""
    per = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), F.col(entity).alias("entity")).agg(F.count("*").alias("n"))
    return per.select("entity", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("until"), "n")


def deduplicated(stream: DataFrame, identity: list[str], ts: str, late: str = "2 hours") -> DataFrame:
    """The first of the records of one identity that arrive within the watermark of each other."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(identity)


def interval_join(events: DataFrame, forecasts: DataFrame, key: str, ts: str, issued: str, ahead: str = "24 hours", late: str = "2 hours") -> DataFrame:
    """Events with the forecasts of their key that were issued at most `ahead` before them; both sides watermarked."""
    e = events.withWatermark(ts, late).alias("e")
    f = forecasts.withWatermark(issued, late).alias("f")
    near = F.expr(f"e.{key} = f.{key} and f.{issued} <= e.{ts} and f.{issued} > e.{ts} - interval {ahead}")
    return e.join(f, near).select("e.*", *[F.col(f"f.{c}").alias(f"forecast_{c}") for c in forecasts.columns if c != key])


class PriorCounters(StatefulProcessor):
    """Strictly prior counts at the arrival of each hour's events: in all and in windows, and the hours since the last.

    State of an entity: its hours with events as a list in time order (a map: hour -> count, next hour), and one row with
    the total, the last hour, and for each window its sum and first hour. A new hour moves the windows on: it reads the
    hours that leave one, each once, and writes its own and the one before; hours older than the largest window and the
    allowed delay are removed on the way. A timer clears the hours of an entity that has been silent for that long.

    Late hours (not after the last one seen) get counts of what has arrived of before them, and count for later rows only;
    that walks the list. What is later than the watermark Spark drops before it comes here.
    """

    def __init__(self, windows: dict[str, int], late_hours: int):
        self.windows = windows
        self.spans = [*windows.values(), max(windows.values()) + late_hours]  # the last one: how long hours are kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        spans = ", ".join(f"sum{k} long, first{k} long" for k in range(len(self.spans)))
        self.row = handle.getValueState("row", f"total long, last long, gone long, timer long, {spans}")
        self.hours = handle.getMapState("hours", "hour long", "n long, next long")

    def _load(self) -> None:
        got = self.row.get() if self.row.exists() else (0, None, None, None, *(0, None) * len(self.spans))
        (self.total, self.last, self.gone, self.timer), rest = got[:4], got[4:]
        self.sums, self.firsts = list(rest[::2]), list(rest[1::2])
        self.known: dict[int, list] = {}
        self.changed: set[int] = set()

    def _hour(self, hour: int) -> list:
        if hour not in self.known:
            self.known[hour] = list(self.hours.getValue((hour,)))
        return self.known[hour]

    def _put(self, hour: int, n: int, following: int | None) -> None:
        self.known[hour] = [n, following]
        self.changed.add(hour)

    def _advance(self, hour: int) -> None:
        """Moves all windows on to end before `hour`; hours that leave the last one are removed."""
        for k, span in enumerate(self.spans):
            while self.firsts[k] is not None and self.firsts[k] < hour - span:
                at = self.firsts[k]
                n, following = self._hour(at)
                self.sums[k] -= n
                self.firsts[k] = following
                if k == len(self.spans) - 1:
                    self.gone = at
                    self.changed.discard(at)
                    del self.known[at]
                    if self.hours.containsKey((at,)):
                        self.hours.removeKey((at,))

    def _append(self, hour: int, n: int) -> tuple:
        self._advance(hour)
        out = (self.total, *self.sums[:-1], float(hour - self.last) if self.last is not None else -1.0)
        if self.firsts[-1] is not None:
            self._put(self.last, self._hour(self.last)[0], hour)
        self._put(hour, n, None)
        for k in range(len(self.spans)):
            self.sums[k] += n
            self.firsts[k] = hour if self.firsts[k] is None else self.firsts[k]
        self.total, self.last = self.total + n, hour
        return out

    def _insert(self, hour: int, n: int) -> tuple | None:
        """A late hour; None if it is older than all that is kept."""
        if hour < self.last - self.spans[-1]:
            return None
        kept, at = [], self.firsts[-1]
        while at is not None:
            kept.append(at)
            at = self._hour(at)[1]
        before = [h for h in kept if h < hour]
        counted = lambda hours: sum(self._hour(h)[0] for h in hours)
        previous = before[-1] if before else self.gone
        out = (self.total - counted(h for h in kept if h >= hour), *(counted(h for h in before if h >= hour - w) for w in self.windows.values()), float(hour - previous) if previous is not None else -1.0)
        if hour in kept:
            self._put(hour, self._hour(hour)[0] + n, self._hour(hour)[1])
        else:
            self._put(hour, n, next((h for h in kept if h > hour), None))
            if before:
                self._put(before[-1], self._hour(before[-1])[0], hour)
        for k, span in enumerate(self.spans):
            if hour >= self.last - span:
                self.sums[k] += n
                self.firsts[k] = hour if self.firsts[k] is None else min(hour, self.firsts[k])
        self.total += n
        return out

    def _save(self) -> None:
        for hour in self.changed:
            self.hours.updateValue((hour,), tuple(self.known[hour]))
        spans = (x for pair in zip(self.sums, self.firsts, strict=True) for x in pair)
        self.row.update((self.total, self.last, self.gone, self.timer, *spans))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(rows).groupby("hour", as_index=False)["n"].sum().sort_values("hour")
        self._load()
        out = []
        for hour, n in zip(got["hour"].tolist(), got["n"].tolist(), strict=True):
            made = self._append(hour, n) if self.last is None or hour > self.last else self._insert(hour, n)
            if made is not None:
                out.append((key[0], hour, n, *made))
        until = (self.last + self.spans[-1] + 1) * HOUR * 1000
        if until != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            self.handle.registerTimer(until)
            self.timer = until
        self._save()
        yield pd.DataFrame(out, columns=["entity", "hour", "n", "prior_total", *self.windows, "hours_since_prev"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        self.hours.clear()
        self.sums, self.firsts, self.gone, self.timer = [0] * len(self.spans), [None] * len(self.spans), self.last, None
        self._save()
        yield pd.DataFrame(columns=["entity", "hour", "n", "prior_total", *self.windows, "hours_since_prev"])

    def close(self) -> None:
        pass


COUNTER_WINDOWS = {"prior_24h": 24, "prior_7d": 168, "prior_30d": 720}


def prior_counters(hourly: DataFrame, windows: dict[str, int] | None = None, late_hours: int = 24) -> DataFrame:
    """The stateful twin of the batch counters over a stream of (entity, hour, n), hours being counted from 1970.

    Rows more than `late_hours` behind the latest hour of all entities are dropped; see `PriorCounters` for late ones. The
    stream is to be started within `state_in_rocksdb`.
    """
    windows = COUNTER_WINDOWS if windows is None else windows
    out = f"entity {hourly.schema['entity'].dataType.simpleString()}, hour long, n long, prior_total long, {', '.join(f'{w} long' for w in windows)}, hours_since_prev double"
    timed = hourly.select("entity", F.col("hour").cast("long").alias("hour"), F.col("n").cast("long").alias("n"), F.timestamp_seconds(F.col("hour") * HOUR).alias("at"))
    return timed.withWatermark("at", f"{late_hours} hours").groupBy("entity").transformWithStateInPandas(PriorCounters(windows, late_hours), out, "append", "EventTime")


def freshness(stream: DataFrame, provider: str, ts: str, ttl_seconds: int, clock: str = "current_timestamp()") -> DataFrame:
    """(provider, last, age_seconds, degraded): the last reading of each provider, in update mode."""
    last = stream.groupBy(F.col(provider).alias("provider")).agg(F.max(ts).alias("last"))
    age = F.unix_seconds(F.expr(clock)) - F.unix_seconds("last")
    return last.select("provider", "last", age.alias("age_seconds"), (age > ttl_seconds).alias("degraded"))


WATCHED = "provider string, last timestamp, degraded boolean"


def freshness_watch(stream: DataFrame, provider: str, ts: str, ttl_seconds: int) -> DataFrame:
    """(provider, last, degraded) whenever a provider reads or has been silent for `ttl_seconds` of processing time.

    The timer starts anew with each reading; a provider that stays silent is reported once. To be run with a
    processing-time trigger: one that ends with its input would wait for timers.
    """

    def watch(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            yield pd.DataFrame({"provider": [key[0]], "last": [pd.Timestamp(last, unit="us")], "degraded": [True]})
            state.update((last,))
            return
        seen = max([int(p["us"].max()) for p in parts], default=None)
        last = max(x for x in (seen, state.get[0] if state.exists else None) if x is not None)
        state.update((last,))
        state.setTimeoutDuration(ttl_seconds * 1000)
        yield pd.DataFrame({"provider": [key[0]], "last": [pd.Timestamp(last, unit="us")], "degraded": [False]})

    rows = stream.select(F.col(provider).cast("string").alias("provider"), F.unix_micros(ts).alias("us")).where("us is not null")
    return rows.groupBy("provider").applyInPandasWithState(watch, WATCHED, "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def append_chunks(stream: DataFrame, path: str, by: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Scored chunks, committed by micro-batch: all batches keep their rows, and one that is run again adds none.

    Streams that write to one path need names of their own; the checkpoint's path is the default.
    """
    known = name or checkpoint

    def put(batch: DataFrame, number: int) -> None:
        write_batch_chunks(batch, path, by, f"{known}:{number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
