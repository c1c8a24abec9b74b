"""Ingestion: bounded queues, worker counts, retries and failures, replayed over the rows that record them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators.machines import fold_rows
from strandline.operators.ordered import last_n


@dataclass
class BoundedQueue:
    """A queue that refuses items beyond its capacity and counts what it made wait; capacity moves within its bounds."""

    capacity: int = 32
    least: int = 1
    most: int = 1024
    depth: int = 0
    blocked_puts: int = 0
    blocked_gets: int = 0

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.capacity <= self.most:
            raise ValueError("a queue's capacity lies between positive bounds")

    def resize(self, capacity: int) -> None:
        """Items beyond a smaller capacity stay; new ones wait."""
        if not self.least <= capacity <= self.most:
            raise ValueError("capacity out of bounds")
        self.capacity = capacity

    def step(self, put: bool) -> dict:
        done = self.depth < self.capacity if put else self.depth > 0
        if done:
            self.depth += 1 if put else -1
        elif put:
            self.blocked_puts += 1
        else:
            self.blocked_gets += 1
        return {"done": done, "depth": self.depth, "depth_ratio": self.depth / self.capacity, "blocked_puts": self.blocked_puts, "blocked_gets": self.blocked_gets}


def replay_queue(events: DataFrame, queue: str, order: str, put: str, **settings) -> DataFrame:
    """What each put or get of a queue met: whether it went through at once, the depth, and how many were blocked so far."""
    out = fold_rows(events, queue, order, [put], lambda: BoundedQueue(**settings), lambda q, x: q.step(bool(x)), "queue", "struct<done: boolean, depth: int, depth_ratio: double, blocked_puts: int, blocked_gets: int>")
    return out.select(queue, order, "queue.*")


def worker_counts(events: DataFrame, keys: list[str], order: str, spawned: Column) -> DataFrame:
    """Workers active and spawned after each spawn or exit; exits of nobody don't count, so the walk is reflected at 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_walk", F.sum(F.when(spawned, 1).otherwise(-1)).over(w))
    active = F.col("_walk") - F.least(F.min("_walk").over(w), F.lit(0))
    return rows.withColumn("active_workers", active).withColumn("total_spawned", F.count_if(spawned).over(w)).drop("_walk")


def retried(df: DataFrame, outcomes: Column, draws: Column, most: int = 2, backoff_s: float = 0.02, jitter_s: float = 0.01) -> DataFrame:
    """decoded, attempts, retries and seconds waited of items, from the outcomes of their attempts in order (null is a
    failure) and a uniform draw for each wait.  An item stops at its first success or after ``most`` attempts."""
    tried = F.transform(F.slice(outcomes, 1, most), lambda ok: F.coalesce(ok, F.lit(False)))
    hit = F.array_position(tried, True)
    attempts = F.when(hit > 0, hit).otherwise(F.size(tried)).cast("int")
    retries = F.greatest(attempts - 1, F.lit(0))
    waited = F.aggregate(F.slice(draws, F.lit(1), retries), F.lit(0.0), lambda total, u: total + backoff_s + u * jitter_s)
    return df.withColumns({"decoded": hit > 0, "attempts": attempts, "retries": retries, "waited_s": waited})


def failure_report(failures: DataFrame, keys: list[str], stage: str, order: list[str], most: int = 256) -> DataFrame:
    """Per run and stage: all failures, and how many of them are among the run's last ``most``, which the report holds."""
    kept = last_n(failures, keys, order, most).groupBy(*keys, stage).agg(F.count("*").alias("kept"))
    counts = failures.groupBy(*keys, stage).agg(F.count("*").alias("failures"))
    return counts.join(kept, [*keys, stage], "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
