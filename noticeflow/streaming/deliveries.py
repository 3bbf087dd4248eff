"""Streams with timers (2.T): leases that run out between batches, limits whose state goes when their window ends, a queue without repeats.

Each key keeps its own state variables; event-time timers fire when the stream's watermark passes them. The states are those of
noticeflow.operators.delivery, so a stream gives the rows of the batch fold, however its input is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from noticeflow.operators.delivery import DELIVERY_LOG, ENDED, LEASE_S, LIMITED, WINDOW_S, Delivery, Window

#: The state store that keyed timers need; set it on the session before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _seconds(column: pd.Series) -> list[int]:
    return [int(x.timestamp()) if x.tzinfo else int(x.tz_localize("UTC").timestamp()) for x in column]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")], dtype=object)


class Deliveries(StatefulProcessor):
    """State of an event: its status and when it is due (one variable), and the token of its lease (another)."""

    def __init__(self, lease_s: int, backoff_s: int):
        self.lease_s, self.backoff_s = lease_s, backoff_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.delivery = handle.getValueState("delivery", "status string, attempts int, due long, told boolean")
        self.lease = handle.getValueState("lease", "token long")

    def _load(self) -> Delivery:
        if not self.delivery.exists():
            return Delivery(self.lease_s, self.backoff_s)
        status, attempts, due, told = self.delivery.get()
        token = self.lease.get()[0] if self.lease.exists() else None
        return Delivery(self.lease_s, self.backoff_s, status, attempts, token, due, told)

    def _save(self, d: Delivery) -> None:
        self.delivery.update((d.status, d.attempts, d.due, d.told))
        if d.status == "sending":
            self.lease.update((d.token,))
        else:
            self.lease.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d, out = self._load(), []
        table = pd.concat(list(rows))
        table = table.assign(_at=_seconds(table["at"])).sort_values(["_at", "seq"])
        for seq, at, action, token, good, retryable in zip(*(table[c].tolist() for c in ("seq", "_at", "action", "token", "good", "retryable"))):
            out += d.apply(int(seq), at, action, None if pd.isna(token) else int(token), bool(good), bool(retryable))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if d.due is not None and not d.told and d.status not in ENDED:
            self.handle.registerTimer(d.due * 1000)
        self._save(d)
        yield _frame([(key[0], *row) for row in out], DELIVERY_LOG)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        d = self._load()
        out = d.pass_time(expiredTimerInfo.getExpiryTimeInMs() // 1000)
        self._save(d)
        yield _frame([(key[0], *row) for row in out], DELIVERY_LOG)

    def close(self) -> None:
        pass


def delivery_stream(ops: DataFrame, *, late: str = "0 seconds", lease_s: int = LEASE_S, backoff_s: int = 1) -> DataFrame:
    """D26 on a stream of operations (at: timestamp): the rows of `delivery_log`; what becomes due without another operation comes from a timer.

    Operations of an event must come in the order of `at` across batches; rows later than `late` are dropped.
    """
    asked = ops.select("event_id", "seq", "at", "action", "token", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("retryable", F.lit(False)).alias("retryable"))
    return asked.withWatermark("at", late).groupBy("event_id").transformWithStateInPandas(Deliveries(lease_s, backoff_s), outputStructType=DELIVERY_LOG, outputMode="append", timeMode="eventTime")


class Limits(StatefulProcessor):
    """State of a (scope, actor): its window's start, and its hits. Both go when the window has ended."""

    def __init__(self, most: int, window_s: int):
        self.most, self.window_s = most, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long")
        self.hits = handle.getValueState("hits", "hits int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start = self.window.get()[0] if self.window.exists() else None
        w = Window(self.most, self.window_s, start, self.hits.get()[0] if self.hits.exists() else 0)
        table = pd.concat(list(rows))
        table = table.assign(_at=_seconds(table["at"])).sort_values(["_at", "seq"])
        out = [(*key, int(seq), *w.hit(at)) for seq, at in zip(table["seq"].tolist(), table["_at"].tolist())]
        if w.start != start:
            if start is not None:
                self.handle.deleteTimer((start + self.window_s) * 1000)
            self.handle.registerTimer((w.start + self.window_s) * 1000)
        self.window.update((w.start,))
        self.hits.update((w.hits,))
        yield _frame(out, LIMITED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.window.exists() and (self.window.get()[0] + self.window_s) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
            self.hits.clear()
        yield _frame([], LIMITED)

    def close(self) -> None:
        pass


def limit_stream(hits: DataFrame, most: int, *, window_s: int = WINDOW_S, late: str = "0 seconds") -> DataFrame:
    """2.T on a stream of hits (at: timestamp): the rows of `limited`. A key without hits for a window keeps no state."""
    return hits.select("scope", "actor", "seq", "at").withWatermark("at", late).groupBy("scope", "actor").transformWithStateInPandas(Limits(most, window_s), outputStructType=LIMITED, outputMode="append", timeMode="eventTime")


def queued_once(jobs: DataFrame, *, key: str = "job_key", at: str = "at", kept: str = "1 hour") -> DataFrame:
    """2.T: a job whose key came within `kept` isn't queued again; keys are forgotten when the watermark is that far beyond them."""
    return jobs.withWatermark(at, kept).dropDuplicatesWithinWatermark([key])
