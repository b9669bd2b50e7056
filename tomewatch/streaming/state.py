"""Streaks of failures as a stateful processor: rows in order of event time across micro-batches, and state that ends.

It needs the session's state store to be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FailureStreaks(StatefulProcessor):
    """Per key: rows wait in a map until the watermark has passed them, then count in order of time and id.

    A row is emitted whenever rows of the key have counted. A key without rows for ``idle_ms`` of event time is forgotten;
    its next row starts at zero. Timers on the watermark's clock drive both.
    """

    def __init__(self, key: str, idle_ms: int, limit: int = 3):
        self.key, self.idle_ms, self.limit = key, idle_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streak = handle.getValueState("streak", "streak long, at long")
        self.waiting = handle.getMapState("waiting", "at long, id long", "failed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            for at, i, failed in zip(part["at_ms"].tolist(), part["id"].tolist(), part["failed"].tolist(), strict=True):
                self.waiting.updateValue((at, i), (bool(failed),))
                first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(k), v[0]) for k, v in self.waiting.iterator())
        due = [r for r in rows if r[0][0] <= now]
        streak, last = self.streak.get() if self.streak.exists() else (0, 0)
        for (at, i), failed in due:
            if last and at - last > self.idle_ms:
                streak = 0
            streak, last = streak + 1 if failed else 0, at
            self.waiting.removeKey((at, i))
        if len(rows) > len(due):
            self.handle.registerTimer(rows[len(due)][0][0])
        elif last + self.idle_ms <= now:
            self.streak.clear()
            self.waiting.clear()
        else:
            self.handle.registerTimer(last + self.idle_ms)
        if due:
            if len(rows) > len(due) or last + self.idle_ms > now:
                self.streak.update((streak, last))
            yield pd.DataFrame({self.key: [key[0]], "streak": [streak], "unreachable": [streak >= self.limit], "at": [pd.Timestamp(last, unit="ms")]})

    def close(self) -> None:
        pass


def failure_streaks_in_order(events: DataFrame, key: str = "user_id", at: str = "ts", id_col: str = "event_id", failed: str = "failed", late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """The streak of each key whenever its rows have counted: (key, streak, unreachable, at), late rows up to ``late`` in their place."""
    kept = events.withWatermark(at, late).selectExpr(f"`{key}`", f"`{at}`", f"unix_millis(`{at}`) as at_ms", f"`{id_col}` as id", f"`{failed}` as failed")
    return kept.groupBy(key).transformWithStateInPandas(FailureStreaks(key, idle_ms), f"`{key}` long, streak long, unreachable boolean, at timestamp", "Append", "EventTime")
