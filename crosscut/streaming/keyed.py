"""State for each caller that ends by itself: quotas that reject within the stream, windows that a timer closes.

Streams need the RocksDB state store (STORE). A caller's rows of one micro-batch meet in one call, as each decision rests on the ones before it; they hold
three numbers each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import KEEP_DAYS, MONTHLY_TOKENS, WEBHOOK_LIMIT

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DAY_MS = 24 * 3600 * 1000


def _rows(rows: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """The rows of one caller in order."""
    return sorted(t for f in rows for t in f[list(columns)].itertuples(index=False, name=None))


class QuotaGate(StatefulProcessor):
    """Lets requests through while the tokens that were let through this month are below the limit. The month's sum is forgotten after ttl_days."""

    def __init__(self, limit: int, ttl_days: int):
        self.limit, self.ttl_ms = limit, ttl_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getMapState("used", "month string", "tokens long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, used = [], {}
        for ts, event, tokens in _rows(rows, "ts", "event_id", "tokens"):
            month = ts.strftime("%Y-%m")
            if month not in used:
                used[month] = self.used.getValue((month,))[0] if self.used.containsKey((month,)) else 0
            allowed = used[month] < self.limit
            out.append((key[0], event, month, used[month], allowed))
            used[month] += (0 if pd.isna(tokens) else int(tokens)) if allowed else 0
        for month, tokens in used.items():
            self.used.updateValue((month,), (tokens,))
        yield pd.DataFrame(out, columns=["installation_id", "event_id", "month", "used", "allowed"])

    def close(self) -> None:
        pass


def quota_gate(events: DataFrame, limit: int = MONTHLY_TOKENS, ttl_days: int = KEEP_DAYS) -> DataFrame:
    """(installation_id, event_id, month, used, allowed) of each request of a stream or table (installation_id, ts, event_id, tokens).

    Its state ends by the clock, so a stream of it always has another batch: run it by a processing time or once. used is what was
    let through in the month before the request. Null tokens are 0; requests without an installation share one quota.
    """
    out = "installation_id long, event_id long, month string, used long, allowed boolean"
    x = events.select("installation_id", "ts", "event_id", "tokens").where("ts is not null")
    return x.groupBy("installation_id").transformWithStateInPandas(QuotaGate(limit, ttl_days), out, "append", "ProcessingTime")


class HitWindows(StatefulProcessor):
    """Windows that begin with a caller's first request after the last window; a timer gives a window out at its end and forgets the caller."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.length = limit, pd.Timedelta(seconds=seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start timestamp, requests long")

    def _row(self, key: Any, start: pd.Timestamp, n: int) -> tuple:
        return (key[0], start, n, max(n - self.limit, 0))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["caller", "start", "requests", "rejected"])

    def _ends(self, start: pd.Timestamp) -> int:
        return int(pd.Timestamp(start).value // 1_000_000 + self.length.value // 1_000_000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, n = self.window.get() if self.window.exists() else (None, 0)
        start = None if start is None else pd.Timestamp(start)
        before, done = start, []
        for (ts,) in _rows(rows, "ts"):
            if start is None or ts - start >= self.length:
                if start is not None:
                    done.append(self._row(key, start, n))
                start, n = ts, 0
            n += 1
        if before is not None and before != start:
            self.handle.deleteTimer(self._ends(before))
        if before != start:
            self.handle.registerTimer(self._ends(start))
        self.window.update((start.to_pydatetime(), n))
        yield self._frame(done)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done = []
        if self.window.exists():
            start, n = self.window.get()
            done.append(self._row(key, pd.Timestamp(start), n))
            self.window.clear()
        yield self._frame(done)

    def close(self) -> None:
        pass


def hit_windows(events: DataFrame, limit: int = WEBHOOK_LIMIT, seconds: int = 60, by: str = "installation_id", late: str = "10 seconds") -> DataFrame:
    """(caller, start, requests, rejected) of a stream's windows, each once, when event time has passed its end; nothing is kept of callers that are done."""
    out = "caller long, start timestamp, requests long, rejected long"
    x = events.select(by, "ts").where("ts is not null").withWatermark("ts", late)
    return x.groupBy(by).transformWithStateInPandas(HitWindows(limit, seconds), out, "append", "EventTime")
