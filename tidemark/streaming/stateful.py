"""Operators with state of their own over unbounded ticks and checks: alerts, values that expire, and subscriptions that change.

Ticks and changes that lack a value are left out.

All three decide by event time: what a batch brings is kept until the watermark has passed it, so the result doesn't depend on how rows are dealt over batches, and rows
that come later than the watermark are left out by Spark. State is read and written once for each key and batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.quality import FAILURES, HEALTHY, POOR, daily_health

LATE = "5 minutes"
_WHOLE = "event_id is not null and asset is not null and ts is not null and price is not null"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_rocksdb(spark: SparkSession) -> None:
    """State with several variables and timers needs this store."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Alerts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "type string", "opened date")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.open.updateValue((initialState.type,), (initialState.opened,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r.date):  # few: a row for each day that is over
            failures, rate = r.out_of_range + r.outlier, r.success_rate
            for kind, stands, severe in (("canary_failed", failures > 0, failures >= FAILURES), ("high_outlier_rate", rate < HEALTHY, rate < POOR)):
                if stands and not self.open.containsKey((kind,)):
                    self.open.updateValue((kind,), (r.date,))
                    yield Row(provider=key[0], type=kind, event="opened", date=r.date, severity="critical" if severe else "warning")
            if r.passed and self.open.containsKey(("canary_failed",)):
                self.open.removeKey(("canary_failed",))
                yield Row(provider=key[0], type="canary_failed", event="resolved", date=r.date, severity=None)


def alert_events(checks: DataFrame, open_alerts: DataFrame | None = None, late: str = "1 day") -> DataFrame:
    """provider, type, event (opened, resolved), date, severity from a stream of ``checks`` (provider, ts, status).

    Checks are counted by provider and day (with a sum in each task first, so a busy provider is no one task's work), and a day is judged once when the
    watermark, ``late`` behind the newest check, has passed its end. The state of a provider is the set of its open alerts, which begins with the stored ``open_alerts`` (provider, type, opened).
    An alert that is open isn't raised again. canary_failed resolves on a day on which all checks are ok; the low rate has no end of its own.
    """
    with_rocksdb(checks.sparkSession)
    days = daily_health(checks.withWatermark("ts", late).withColumn("date", F.window("ts", "1 day")))
    judged = days.select("provider", F.col("date.start").cast("date").alias("date"), "out_of_range", "outlier", "passed", "success_rate")
    start = None if open_alerts is None else open_alerts.select("provider", "type", "opened").groupBy("provider")
    return judged.groupBy("provider").transformWithState(_Alerts(), "provider string, type string, event string, date date, severity string", "Append", "None", start)


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[us]").astype(np.int64)


_CHUNK = 100_000


def _timer(us: int) -> int:
    """The first millisecond at ``us`` or after it: watermarks and timers have no finer ones."""
    return -(-us // 1000)


class _LastValues(StatefulProcessor):
    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "first long, last long, event_id long, price double")

    def _runs(self, ticks: pd.DataFrame) -> list[tuple]:
        ticks = ticks.assign(us=_micros(ticks["ts"])).sort_values(["us", "event_id"], kind="stable")
        us = ticks["us"].to_numpy()
        starts = np.flatnonzero(np.diff(us, prepend=us[0] - self.ttl) >= self.ttl)
        ends = np.append(starts[1:], len(us)) - 1
        return [(int(us[s]), int(us[e]), int(ticks["event_id"].iat[e]), float(ticks["price"].iat[e])) for s, e in zip(starts, ends)]

    def _merged(self, runs: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for run in sorted(runs):
            if out and run[0] < out[-1][1] + self.ttl:
                out[-1] = (out[-1][0], *max(out[-1][1:], run[1:]))
            else:
                out.append(run)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, more = self._merged([tuple(r) for r in self.runs.get()]), []
        for ticks in rows:  # of a batch's ticks only one frame is held, and runs
            more += self._runs(ticks) if len(ticks) else []
            if len(more) > max(len(out), _CHUNK):
                out, more = self._merged(out + more), []
        out = self._merged(out + more)
        self.runs.put(out)
        self.handle.registerTimer(_timer(out[0][1] + self.ttl))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, runs = timerValues.getCurrentWatermarkInMs() * 1000, [tuple(r) for r in self.runs.get()]
        over = [r for r in runs if r[1] + self.ttl <= now]
        left = runs[len(over) :]  # in order of time
        if over:
            self.runs.put(left) if left else self.runs.clear()
        if left:
            self.handle.registerTimer(_timer(left[0][1] + self.ttl))
        at = pd.to_datetime([r[1] for r in over], unit="us")
        yield pd.DataFrame({"asset": key[0], "ts": at, "price": [r[3] for r in over], "expired_at": at + pd.Timedelta(self.ttl, "us")})


def expired_values(ticks: DataFrame, seconds: int = 60, late: str = LATE) -> DataFrame:
    """asset, ts, price, expired_at: the last value of an asset each time that no newer one came for ``seconds``, from a stream of ``ticks`` (event_id, asset, ts, price).

    An asset's state is its runs of ticks that lie less than ``seconds`` apart, of which the last may still grow; a timer closes a run when the watermark passes its last tick's
    time to live, and then the asset leaves the state. A tick at the very end of that time finds the old value gone.
    """
    with_rocksdb(ticks.sparkSession)
    marked = ticks.where(_WHOLE).select("event_id", "asset", "ts", "price").withWatermark("ts", late)
    return marked.groupBy("asset").transformWithStateInPandas(_LastValues(seconds * 1_000_000), "asset string, ts timestamp, price double, expired_at timestamp", "Append", "EventTime")


class _Subscribed(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changes = handle.getListState("changes", "us long, active boolean")
        self.waiting = handle.getListState("waiting", "us long, event_id long, price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for given in rows:
            if not len(given):
                continue
            given = given.assign(us=_micros(given["ts"]))
            changes, ticks = given[given["active"].notna()], given[given["active"].isna()]
            if len(changes):
                self.changes.appendList([(int(m), bool(a)) for m, a in zip(changes["us"], changes["active"])])
            if len(ticks):
                self.waiting.appendList([(int(m), int(e), float(p)) for m, e, p in zip(ticks["us"], ticks["event_id"], ticks["price"])])
            least = int(given["us"].min()) if least is None else min(least, int(given["us"].min()))
        self.handle.registerTimer(_timer(least + 1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        changes = np.fromiter((tuple(c) for c in self.changes.get()), [("us", "i8"), ("active", "?")])
        changes = changes[np.lexsort((~changes["active"], changes["us"]))]  # of one time an unsubscription comes last
        past = int(np.searchsorted(changes["us"], now))
        kept = changes[max(0, past - 1) :]  # the last known state, and what is to come
        kept = kept if len(kept) > 1 or (len(kept) and kept["active"][0]) else kept[:0]  # nothing is the same as not subscribed
        left, parts, waiting = [], [], (tuple(w) for w in self.waiting.get())
        while len(some := np.fromiter(islice(waiting, _CHUNK), [("us", "i8"), ("event_id", "i8"), ("price", "f8")])):
            at = np.searchsorted(changes["us"], some["us"], "right") - 1
            due = some["us"] < now
            left.append(some[~due])
            told = due & (at >= 0)
            told[told] = changes["active"][at[told]]
            parts.append(some[told])  # 24 bytes a tick
        left = np.concatenate(left) if left else np.zeros(0, [("us", "i8")])
        self.changes.put(kept.tolist()) if len(kept) else self.changes.clear()
        self.waiting.put(left.tolist()) if len(left) else self.waiting.clear()
        if len(left):
            self.handle.registerTimer(_timer(int(left["us"].min()) + 1))
        yield pd.DataFrame()
        for told in parts:
            yield pd.DataFrame({"event_id": told["event_id"], "asset": key[0], "ts": told["us"].astype("datetime64[us]"), "price": told["price"]})


def subscribed_ticks(ticks: DataFrame, changes: DataFrame, late: str = LATE) -> DataFrame:
    """event_id, asset, ts, price of the stream's ``ticks`` whose asset is subscribed at their time, by a stream of ``changes`` (asset, ts, active).

    A change holds from its own time on; of changes at one time an unsubscription wins; before its first change an asset isn't subscribed. Each stream has a watermark, and a tick is told when both have
    passed it, so a change that comes after its ticks (within ``late``) counts. An asset's state is its last change, later ones, and ticks that wait.
    """
    with_rocksdb(ticks.sparkSession)
    t = ticks.where(_WHOLE).select("event_id", "asset", "ts", "price", F.lit(None).cast("boolean").alias("active")).withWatermark("ts", late)
    c = changes.where("asset is not null and ts is not null and active is not null").select(F.lit(None).cast("long").alias("event_id"), "asset", "ts", F.lit(None).cast("double").alias("price"), "active").withWatermark("ts", late)
    return t.union(c).groupBy("asset").transformWithStateInPandas(_Subscribed(), "event_id long, asset string, ts timestamp, price double", "Append", "EventTime")
