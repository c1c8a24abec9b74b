"""Control-plane operators: recovery order, tuning, buffers with expiry, memo caches, frame status, reports of a run."""

from __future__ import annotations

import heapq
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.canonical import ordered_digest
from strandline.operators.machines import fold_rows


def recovery_order(actions: DataFrame, keys: list[str], inserted: str, capacity: int = 256) -> DataFrame:
    """place of each of the newest ``capacity`` actions (severity, queued_at_s, stage, seq_id): tripped first, then by time."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(inserted))
    kept = actions.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= capacity).drop("r")
    order = Window.partitionBy(*keys).orderBy(F.when(F.col("severity") == "tripped", 0).otherwise(1), "queued_at_s", "stage", "seq_id")
    return kept.withColumn("place", F.row_number().over(order) - 1)


def contiguous(items: DataFrame, keys: list[str], seq: str, start: int = 0) -> DataFrame:
    """ready: whether all numbers from ``start`` up to this one are there; repeats and earlier numbers are left out."""
    once = items.where(F.col(seq) >= start).dropDuplicates([*keys, seq])
    w = Window.partitionBy(*keys).orderBy(seq)
    return once.withColumn("ready", F.row_number().over(w) == F.col(seq) - start + 1)


def frame_status(frames: DataFrame, keys: list[str], order: str, least: int = 20) -> DataFrame:
    """status, method and failure_reason of frames (match_count, drop_reason, feature_error, pose_error, relocalized).

    A frame after a lost one has nothing to match against, so its matches count as none: only the row before matters."""
    c, w = F.col, Window.partitionBy(*keys).orderBy(order)
    lost = c("drop_reason").isNotNull() | c("feature_error").isNotNull()
    first, before = F.row_number().over(w) == 1, F.coalesce(F.lag(lost).over(w), F.lit(False))
    few = before | (F.coalesce(c("match_count"), F.lit(0)) < least)
    moved, broken = F.coalesce(c("relocalized"), F.lit(False)), c("pose_error").isNotNull()
    cases = [
        (c("drop_reason").isNotNull(), "dropped", "tracking_drop", c("drop_reason")),
        (c("feature_error").isNotNull(), "skipped", "feature_failure", c("feature_error")),
        (first, "bootstrap", "bootstrap", F.lit(None)),
        ((few | broken) & moved, "relocalized", "relocalization", F.lit(None)),
        (few, "skipped", "insufficient_matches", F.lit("min_matches")),
        (broken, "failure", "pose_failure", c("pose_error")),
    ]
    status, method, reason = F.lit("ok"), F.lit("pose"), F.lit(None).cast("string")
    for when, s, m, why in reversed(cases):
        status, method, reason = F.when(when, s).otherwise(status), F.when(when, m).otherwise(method), F.when(when, why).otherwise(reason)
    return frames.withColumns({"status": status, "method": method, "failure_reason": reason})


@dataclass
class Tuner:
    """Queue capacity and workers of a stage after its smoothed depth: at 0.8 the queue grows a step, at 0.3 it shrinks;
    workers come one by one at 0.75 and go at 0.2."""

    alpha: float = 0.25
    least: int = 8
    most: int = 128
    by: int = 8
    least_workers: int = 2
    most_workers: int = 8
    capacity: int = 32
    workers: int = 2
    smooth: float | None = None

    def step(self, ratio: float) -> dict:
        self.smooth = ratio if self.smooth is None else self.alpha * ratio + (1 - self.alpha) * self.smooth
        moves = []
        if self.smooth >= 0.8 and self.capacity < self.most:
            self.capacity = min(self.capacity + self.by, self.most)
            moves.append("queue_scale_up")
        elif self.smooth <= 0.3 and self.capacity > self.least:
            self.capacity = max(self.capacity - self.by, self.least)
            moves.append("queue_scale_down")
        if self.smooth >= 0.75 and self.workers < self.most_workers:
            self.workers += 1
            moves.append("worker_scale_up")
        elif self.smooth <= 0.2 and self.workers > self.least_workers:
            self.workers -= 1
            moves.append("worker_scale_down")
        return {"smooth": self.smooth, "capacity": self.capacity, "workers": self.workers, "moves": moves}


def tune(samples: DataFrame, stage: str, order: str, ratio: str, **settings) -> DataFrame:
    """What the tuner does after each pressure sample of a stage."""
    out = fold_rows(samples, stage, order, [ratio], lambda: Tuner(**settings), lambda t, x: t.step(float(x)), "tuning", "struct<smooth: double, capacity: int, workers: int, moves: array<string>>")
    return out.select(stage, order, "tuning.*")


@dataclass
class PendingBuffer:
    """At most ``capacity`` waiting frames, each for ``ttl`` seconds; when full, the oldest goes or the new one is rejected."""

    capacity: int = 64
    ttl: float = 1.0
    drop_oldest: bool = True
    waiting: OrderedDict = field(default_factory=OrderedDict)
    deadlines: list = field(default_factory=list)

    def step(self, ts: float, seq: int, kind: str) -> list[dict]:
        out, late = [], []
        while self.deadlines and self.deadlines[0][0] <= ts:
            due, s = heapq.heappop(self.deadlines)
            if self.waiting.get(s) == due:
                del self.waiting[s]
                late.append(s)
        out += [{"seq": s, "fate": "expired"} for s in sorted(late)]
        if kind == "result":
            return [*out, {"seq": seq, "fate": "orphan" if self.waiting.pop(seq, None) is None else "matched"}]
        if seq in self.waiting:
            return [*out, {"seq": seq, "fate": "duplicate"}]
        if len(self.waiting) >= self.capacity:
            if not self.drop_oldest:
                return [*out, {"seq": seq, "fate": "rejected"}]
            out.append({"seq": self.waiting.popitem(last=False)[0], "fate": "dropped"})
        self.waiting[seq] = ts + self.ttl
        heapq.heappush(self.deadlines, (ts + self.ttl, seq))
        return out


def pending_fates(events: DataFrame, run: str, order: str, ts: str, seq: str, kind: str, **settings) -> DataFrame:
    """run, order, seq, fate: what each frame or result event (kind frame, result) settles.  State is bounded by capacity and
    by the frames of one time to live."""
    out = fold_rows(events, run, order, [ts, seq, kind], lambda: PendingBuffer(**settings), lambda b, t, s, k: b.step(float(t), int(s), k) or None, "fates", "array<struct<seq: bigint, fate: string>>")
    return out.select(run, order, F.inline("fates"))


@dataclass
class Memo:
    """Least recently used entries, each valid for ``ttl`` seconds since it was put."""

    capacity: int = 64
    ttl: float = 1.0
    items: OrderedDict = field(default_factory=OrderedDict)

    def step(self, ts: float, key: str) -> bool:
        put = self.items.get(key)
        hit = put is not None and ts - put <= self.ttl
        if not hit:
            self.items.pop(key, None)
            self.items[key] = ts
        self.items.move_to_end(key)
        while len(self.items) > self.capacity:
            self.items.popitem(last=False)
        return hit


def memo_hits(calls: DataFrame, worker: str, order: str, ts: str, key: str, **settings) -> DataFrame:
    """Whether each call of a worker finds its key in the cache."""
    return fold_rows(calls, worker, order, [ts, key], lambda: Memo(**settings), lambda m, t, k: m.step(float(t), k), "hit", "boolean")


def metric_series(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """series: the values of each key in order."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda p: p[value]).alias("series"))


def determinism_report(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name of (artifact type, ...) digests of two runs with status match, mismatch or missing.  Of repeated names the
    largest digest counts, so the report doesn't hang on row order."""
    left, right = (d.groupBy(*keys).agg(F.max("digest").alias(n)) for d, n in ((a, "digest_a"), (b, "digest_b")))
    state = F.when(F.col("digest_a").isNull() | F.col("digest_b").isNull(), "missing").when(F.col("digest_a") == F.col("digest_b"), "match").otherwise("mismatch")
    return left.join(right, keys, "full_outer").withColumn("status", state)


def determinism_status(report: DataFrame, keys: list[str]) -> DataFrame:
    """pass if all match."""
    return report.groupBy(*keys).agg(F.when(F.bool_and(F.col("status") == "match"), "pass").otherwise("fail").alias("status"), F.count("*").alias("artifacts"))


def control_plane_report(snapshots: DataFrame, events: DataFrame, keys: list[str], snapshot: Column, event: Column) -> DataFrame:
    """snapshot_digest over stages in name order, event_digest over merged events, and digest of both."""

    def digest(df: DataFrame, order: list[str], text: Column, name: str) -> DataFrame:
        return ordered_digest(df.withColumn("_text", text), keys, order, "_text").select(*keys, F.col("digest").alias(name))

    both = digest(snapshots, ["stage"], snapshot, "snapshot_digest").join(digest(events, ["timestamp_s", "stage", "seq_id"], event, "event_digest"), keys, "full_outer")
    return both.withColumn("digest", F.sha2(F.concat_ws(":", "snapshot_digest", "event_digest"), 256))
