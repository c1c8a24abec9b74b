"""Structured Streaming twins: watermarked digests, TTL joins, reordering, breaker state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.operators.machines import Breaker


def stream_digest(events: DataFrame, ts: str, stage: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Moments per stage and window; rows later than the watermark are left out, so state is bounded."""
    timed = events.withColumn("t", F.col(ts).cast("timestamp")).withWatermark("t", late)
    c = F.col(value)
    return timed.groupBy(F.window("t", window), F.col(stage).alias("stage")).agg(F.count(c).alias("event_count"), F.sum(c).alias("total"), F.min(c).alias("min"), F.max(c).alias("max"), F.approx_percentile(c, F.lit(0.95)).alias("p95"))


def ttl_join(requests: DataFrame, results: DataFrame, key: str, ttl: str) -> DataFrame:
    """Each request (key, ts) with its result within the time to live; requests past it come with a null result (left outer)."""
    a = requests.select(F.col(key).alias("k"), F.col("ts").alias("asked")).withWatermark("asked", ttl)
    b = results.select(F.col(key).alias("rk"), F.col("ts").alias("answered"), F.col("payload")).withWatermark("answered", ttl)
    return a.join(b, F.expr(f"k = rk and answered >= asked and answered <= asked + interval {ttl}"), "leftOuter").select(F.col("k").alias(key), "asked", "answered", "payload")


def reorder(items: DataFrame, run: str, seq: str, limit: int = 128, flush: float = 0.75) -> DataFrame:
    """Emits each run's items once, in contiguous order of seq; at ``limit`` waiting ones the first ``flush`` share goes out
    in order and the gap is given up."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, waiting = (state.get[0], set(state.get[1])) if state.exists else (0, set())
        out: list[int] = []
        for pdf in batches:
            waiting |= {int(s) for s in pdf[seq] if s >= expected}
            while True:
                while expected in waiting:
                    waiting.remove(expected)
                    out.append(expected)
                    expected += 1
                if len(waiting) < limit:
                    break
                for s in sorted(waiting)[: max(1, int(len(waiting) * flush))]:
                    waiting.remove(s)
                    out.append(s)
                    expected = s + 1
        state.update((expected, sorted(waiting)))
        yield pd.DataFrame({run: [key[0]] * len(out), seq: out})

    kind = {f.name: f.dataType.simpleString() for f in items.schema}[run]
    return items.groupBy(run).applyInPandasWithState(step, f"`{run}` {kind}, `{seq}` long", "expected long, waiting array<long>", "append", GroupStateTimeout.NoTimeout)


def breaker_stream(attempts: DataFrame, key: str, **settings) -> DataFrame:
    """State of each key's circuit breaker after each micro-batch of attempts (key, ts seconds, ok)."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Breaker(**settings)
        if state.exists:
            machine.state, machine.failed, machine.good, machine.opened = state.get
        n = 0
        for pdf in batches:
            for ts, ok in pdf.sort_values("ts")[["ts", "ok"]].itertuples(index=False):
                machine.step(float(ts), bool(ok))
                n += 1
        state.update((machine.state, machine.failed, machine.good, machine.opened))
        yield pd.DataFrame({key: [k[0]], "state": [machine.state], "attempts": [n]})

    kind = {f.name: f.dataType.simpleString() for f in attempts.schema}[key]
    return attempts.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, state string, attempts long", "state string, failed int, good int, opened double", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is available now, gathered in a memory table of that name; for tests and small reports."""
    spark = stream.sparkSession
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
