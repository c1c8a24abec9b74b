"""Streaming state with event-time timers (``transformWithState``): reordering that waits so long and no longer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The state store that such state needs; set before the first stream of a session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class TimedReorder(StatefulProcessor):
    """Per run: the next number, how many went out, when the run counts as idle, and the waiting numbers with their deadlines."""

    def __init__(self, run: str, wait_ms: int, idle_ms: int, limit: int, flush: float):
        self.run, self.wait, self.idle, self.limit, self.flush = run, wait_ms, idle_ms, limit, flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "expected long, sent long, idle long")
        self.waiting = handle.getMapState("waiting", "seq long", "deadline long")

    def _load(self) -> tuple[int, int, int, dict[int, int]]:
        head = self.head.get() if self.head.exists() else (0, 0, 0)
        return *head, ({k[0]: v[0] for k, v in self.waiting.iterator()} if self.waiting.exists() else {})

    def _rows(self, key: tuple, sent: int, out: list[tuple[int, bool]]) -> pd.DataFrame:
        return pd.DataFrame({self.run: [key[0]] * len(out), "place": range(sent, sent + len(out)), "seq": [s for s, _ in out], "forced": [f for _, f in out]})

    @staticmethod
    def _ready(waiting: dict[int, int], expected: int, out: list[tuple[int, bool]]) -> int:
        while waiting.pop(expected, None) is not None:
            out.append((expected, False))
            expected += 1
        return expected

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        expected, sent, idle, before = self._load()
        waiting, latest = dict(before), 0
        for pdf in rows:
            out: list[tuple[int, bool]] = []
            for seq, ms in zip(pdf["seq"], pdf["ms"], strict=True):
                latest = max(latest, int(ms))
                if seq >= expected:
                    waiting.setdefault(int(seq), int(ms) + self.wait)
                    expected = self._ready(waiting, expected, out)
                if len(waiting) >= self.limit:
                    for s in sorted(waiting)[: max(1, int(len(waiting) * self.flush))]:
                        del waiting[s]
                        out.append((s, True))
                        expected = s + 1
                    expected = self._ready(waiting, expected, out)
            if out:
                yield self._rows(key, sent, out)
                sent += len(out)
        for s in before.keys() - waiting.keys():
            self.waiting.removeKey((s,))
        for s in waiting.keys() - before.keys():
            self.waiting.updateValue((s,), (waiting[s],))
            self.handle.registerTimer(waiting[s])
        if latest + self.idle > idle:
            if idle:
                self.handle.deleteTimer(idle)
            idle = latest + self.idle
            self.handle.registerTimer(idle)
        self.head.update((expected, sent, idle))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        expected, sent, idle, waiting = self._load()
        due, out = [s for s, deadline in waiting.items() if deadline <= now], []
        if due:
            for s in sorted(s for s in waiting if s <= max(due)):
                del waiting[s]
                self.waiting.removeKey((s,))
                out.append((s, True))
                expected = s + 1
            held = set(waiting)
            expected = self._ready(waiting, expected, out)
            for s in held - set(waiting):
                self.waiting.removeKey((s,))
            yield self._rows(key, sent, out)
        if waiting or now < idle:
            self.head.update((expected, sent + len(out), idle))
        else:
            self.head.clear()

    def close(self) -> None:
        pass


def reorder_timed(items: DataFrame, run: str, seq: str, ts: str, wait_s: float = 30.0, late: str = "0 seconds", idle_s: float = 3600.0, limit: int = 128, flush: float = 0.75) -> DataFrame:
    """(run, place, seq, forced): each run's numbers from 0 once and in order; ``place`` counts what a run has sent.

    A number that waits for an earlier one goes out when the watermark (``late`` behind the newest ``ts``) passes its own
    time by ``wait_s``, together with all smaller ones that wait; or, at ``limit`` waiting ones, with the first ``flush``
    share of them.  What was missing is given up then (``forced``), and left out if it still comes.  So state is at most ``limit``
    numbers a run, and a run without rows for ``idle_s`` loses its state: should it come back, it starts from 0 and
    waits once.  Rows of which a column is null, and rows older than the watermark, are left out.  The session's state
    store has to be ``STATE_STORE``."""
    if limit < 1 or not 0 < flush <= 1 or wait_s < 0 or idle_s < wait_s:
        raise ValueError("a limit of at least 1, a share up to 1, and an idle time no shorter than the wait")
    time = F.col(ts).cast("timestamp")
    rows = items.select(F.col(run), F.col(seq).cast("long").alias("seq"), time.alias("_time")).where(F.col(run).isNotNull() & F.col("seq").isNotNull() & F.col("_time").isNotNull())
    rows = rows.withWatermark("_time", late).withColumn("ms", F.unix_millis("_time"))
    kind = {f.name: f.dataType.simpleString() for f in items.schema}[run]
    machine = TimedReorder(run, int(wait_s * 1000), int(idle_s * 1000), limit, flush)
    return rows.groupBy(run).transformWithStateInPandas(machine, f"`{run}` {kind}, place long, seq long, forced boolean", "append", "EventTime")
