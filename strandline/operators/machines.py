"""Feedback state machines and order-dependent estimators: one key's rows in order, as batch groups or streaming state."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import STATE_RANK as RANK
from strandline.functions.scalars import derived_seed


def fold_rows(df: DataFrame, key: str, order: str, fields: list[str], start: Callable, step: Callable, name: str, kind: str) -> DataFrame:
    """(key, order, name): ``step(state, *fields)`` of each row in order, from ``start()`` for each key; None leaves a row out.

    Rows stream through sorted partitions, so neither many small keys nor one large key costs memory."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(key, order, *[F.col(f).alias(f"_{i}") for i, f in enumerate(fields)]).repartition(key).sortWithinPartitions(key, order)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in batches:
            out = []
            for k, *values in zip(pdf[key], *(pdf[f"_{i}"] for i in range(len(fields))), strict=True):
                if not same(k, now):
                    now, state = k, start()
                out.append(step(state, *values))
            pdf = pdf[[key, order]].assign(**{name: out})
            yield pdf[pdf[name].notna()]

    return rows.mapInPandas(task, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{name}` {kind}")


def fold_groups(df: DataFrame, key: str, order: list[str], fields: list[str], start: Callable, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """The rows that ``step(state, *fields)`` and, after a key's last row, ``finish(state)`` list, each behind its key.

    Rows stream like those of ``fold_rows``: only the state and one batch are in memory."""
    kind, names = {f.name: f.dataType.simpleString() for f in df.schema}[key], [part.split()[0] for part in schema.split(", ")]
    rows = df.select(key, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(f).alias(f"_{i}") for i, f in enumerate(fields)])
    rows = rows.repartition(key).sortWithinPartitions(key, *[f"_o{i}" for i in range(len(order))])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out = []
            for k, *values in zip(pdf[key], *(pdf[f"_{i}"] for i in range(len(fields))), strict=True):
                if state is None or not same(k, now):
                    if state is not None:
                        out += [(now, *row) for row in finish(state)]
                    now, state = k, start()
                out += [(now, *row) for row in step(state, *values)]
            yield pd.DataFrame(out, columns=[key, *names])
        if state is not None:
            yield pd.DataFrame([(now, *row) for row in finish(state)], columns=[key, *names])

    return rows.mapInPandas(task, f"`{key}` {kind}, {schema}")


def same(a, b) -> bool:
    """Equal keys; null, which pandas may hold as NaN, is one key."""
    return a is b or a == b or a != a and b != b


@dataclass
class Breaker:
    """closed opens at ``failures`` failures (in all, or in a row), half-opens after ``cooldown`` s, closes after ``successes``."""

    failures: int = 5
    cooldown: float = 1.0
    successes: int = 2
    consecutive: bool = False
    state: str = "closed"
    failed: int = 0
    good: int = 0
    opened: float = 0.0

    def step(self, ts: float, ok: bool) -> str:
        if self.state == "open" and ts - self.opened >= self.cooldown:
            self.state, self.good = "half_open", 0
        if ok:
            if self.state == "half_open":
                self.good += 1
                if self.good >= self.successes:
                    self.state, self.failed = "closed", 0
            elif self.consecutive and self.state == "closed":
                self.failed = 0
        elif self.state != "open":
            self.failed += 1
            if self.state == "half_open" or self.failed >= self.failures:
                self.state, self.opened = "open", ts
        return self.state


@dataclass
class QuantileMarkers:
    """Five-marker streaming quantile (Jain and Chlamtac): exact below five values, the middle marker at five."""

    q: float
    seen: int = 0
    first: list[float] = field(default_factory=list)
    height: list[float] = field(default_factory=list)
    place: list[float] = field(default_factory=list)
    goal: list[float] = field(default_factory=list)

    def add(self, x: float) -> None:
        self.seen += 1
        if self.seen <= 5:
            self.first.append(x)
            if self.seen == 5:
                self.height, self.place = sorted(self.first), [1, 2, 3, 4, 5]
                self.goal = [1, 1 + 2 * self.q, 1 + 4 * self.q, 3 + 2 * self.q, 5]
            return
        h, n = self.height, self.place
        h[0], h[4] = min(h[0], x), max(h[4], x)
        cell = next((i for i in range(3) if x < h[i + 1]), 3)
        for i in range(cell + 1, 5):
            n[i] += 1
        for i, rate in enumerate((0, self.q / 2, self.q, (1 + self.q) / 2, 1)):
            self.goal[i] += rate
        for i in (1, 2, 3):
            d = self.goal[i] - n[i]
            if d >= 1 and n[i + 1] - n[i] > 1 or d <= -1 and n[i - 1] - n[i] < -1:
                s = 1 if d > 0 else -1
                bent = h[i] + s / (n[i + 1] - n[i - 1]) * ((n[i] - n[i - 1] + s) * (h[i + 1] - h[i]) / (n[i + 1] - n[i]) + (n[i + 1] - n[i] - s) * (h[i] - h[i - 1]) / (n[i] - n[i - 1]))
                h[i] = bent if h[i - 1] < bent < h[i + 1] else h[i] + s * (h[i + s] - h[i]) / (n[i + s] - n[i])
                n[i] += s

    def value(self) -> float:
        if self.seen < 5:
            return float(np.quantile(self.first, self.q)) if self.first else 0.0
        return self.height[2]


@dataclass
class Reading:
    """What a stage reports: its state, errors among its last events, the largest pressure ratio, and two running counters."""

    state: str
    errors: int = 0
    ratio: float | None = None
    pressure: int = 0
    opens: int = 0


@dataclass
class _Stage:
    state: str
    since: float
    good: int = 0
    pressure: int = 0
    opens: int = 0


@dataclass
class Supervisor:
    """Health of one run's stages: errors and escalations raise the states asked for, these spread to stages downstream, and
    recovery takes a cooldown and healthy updates in a row.

    A degraded stage counts healthy updates anew whenever it stays degraded, so it settles only where ``settle`` is 1; that
    is what the machine being matched does.  Escalations queue actions, of which the newest ``capacity`` are kept."""

    upstream: dict[str, tuple[str, ...]]
    cooldown: float = 0.5
    streak: int = 2
    settle: int = 2
    errors: tuple[int, int] = (2, 4)
    ratios: tuple[float, float] = (0.8, 0.95)
    growth: tuple[int, int] = (1, 3)
    opens: int = 1
    capacity: int = 128
    stages: dict[str, _Stage] = field(default_factory=dict)
    queue: deque = field(default_factory=deque)
    queued: int = 0

    @property
    def state(self) -> dict[str, str]:
        return {s: x.state for s, x in self.stages.items()}

    @property
    def recovery(self) -> list[tuple[str, str, str]]:
        """(stage, type, severity) of the queued actions: tripped first, then by time, stage and number."""
        return [(s, kind, level) for level, _, s, _, kind in sorted(self.queue, key=lambda x: (x[0] != "tripped", *x[1:4]))]

    def _raised(self, asked: Reading, now: _Stage) -> list[tuple[str, str, str]]:
        """(type, severity, reason) of a stage's escalations; its counters move on."""
        grown, opened = max(asked.pressure - now.pressure, 0), max(asked.opens - now.opens, 0)
        now.pressure, now.opens = asked.pressure, asked.opens
        level, why, out = None, [], []
        if asked.ratio is not None and asked.ratio >= self.ratios[0]:
            level = "tripped" if asked.ratio >= self.ratios[1] else "degraded"
            why.append(f"ratio={asked.ratio:.3f}")
        if grown >= self.growth[1] > 0 or level is None and grown >= self.growth[0] > 0:
            level = "tripped" if grown >= self.growth[1] > 0 else "degraded"
            why.append(f"delta={grown}")
        if level:
            out.append(("backpressure", level, f"backpressure({','.join(why)})"))
        if opened >= self.opens > 0:
            out.append(("circuit_breaker", "tripped", f"circuit_breaker(delta={opened})"))
        return out

    def _spread(self, want: dict[str, str]) -> None:
        for _ in want:  # as many passes as there are stages
            for s in sorted(want):
                ups = {want.get(u, "healthy") for u in self.upstream.get(s, ())}
                if "tripped" in ups and want[s] != "tripped" or ups & {"degraded", "recovering"} and want[s] == "healthy":
                    want[s] = "degraded"

    def _next(self, now: _Stage, want: str, ts: float) -> tuple[str, str]:
        """The state that follows, and why."""
        why = "snapshot"
        if now.state == "tripped" and want in ("healthy", "degraded") and ts - now.since >= self.cooldown:
            want, why = "recovering", "cooldown_elapsed"
        if now.state == "recovering":
            now.good = now.good + 1 if want == "healthy" else 0
            if want == "tripped":
                why = "retrip"
            elif want == "healthy":
                want, why = ("healthy", "recovered") if now.good >= self.streak else ("recovering", "awaiting_stability")
            else:
                want, why = "recovering", "hold_recovering"
        if now.state == "degraded" and want == "healthy":
            now.good += 1
            want, why = ("healthy", "stabilized") if now.good >= self.settle else ("degraded", "awaiting_stability")
        if want in ("tripped", "degraded"):
            now.good = 0
        return want, why

    def update(self, ts: float, asked: dict[str, Reading | str]) -> list[tuple[float, str, str, str, str]]:
        """(time, stage, old, new, reason) of the stages that change."""
        asked = {s: Reading(r) if isinstance(r, str) else r for s, r in asked.items()}
        want, moves = {}, []
        for s in sorted(asked):
            r, now = asked[s], self.stages.setdefault(s, _Stage("healthy", ts))
            state = r.state.lower().strip()
            state = "healthy" if state == "idle" else state
            if r.errors >= self.errors[1] > 0:
                state = "tripped"
            elif r.errors >= self.errors[0] > 0 and state not in ("tripped", "recovering"):
                state = "degraded"
            for kind, level, _ in self._raised(r, now):
                state = state if RANK.get(state, 0) >= RANK[level] else level
                self.queued += 1
                self.queue.append((level, ts, s, self.queued, kind))
                while len(self.queue) > self.capacity:
                    self.queue.popleft()
            want[s] = state
        self._spread(want)
        for s in sorted(want):
            now = self.stages[s]
            old, (new, why) = now.state, self._next(now, want[s], ts)
            if new != old:
                now.state, now.since = new, ts
                moves.append((ts, s, old, new, why))
        return moves


def breaker_states(df: DataFrame, key: str, order: str, ts: str, ok: str, **settings) -> DataFrame:
    """State after each attempt."""
    return fold_rows(df, key, order, [ts, ok], lambda: Breaker(**settings), lambda b, t, good: b.step(float(t), bool(good)), "state", "string")


def marker_quantiles(df: DataFrame, key: str, order: str, value: str, at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """n and the estimates of each key's values in order; values stream, so a large key costs no memory."""

    def add(markers: list[QuantileMarkers], x: float) -> tuple:
        for m in markers:
            m.add(float(x))
        return ()

    names = ", ".join(f"p{round(q * 100)} double" for q in at)
    return fold_groups(df, key, [order], [value], lambda: [QuantileMarkers(q) for q in at], add, lambda markers: [(markers[0].seen, *(m.value() for m in markers))], f"n long, {names}")


def supervise(df: DataFrame, run: str, upstream: dict[str, tuple[str, ...]], **settings) -> DataFrame:
    """Transitions of asked(run, tick, stage, asked), and errors, ratio, pressure, opens where df has them: all stages of a
    run share state, so a run's ticks stream in order and only one tick's stages are held."""
    more = [c for c in ("errors", "ratio", "pressure", "opens") if c in df.columns]

    class Run:
        def __init__(self) -> None:
            self.machine, self.tick, self.asked = Supervisor(upstream, **settings), None, {}

        def close(self) -> list[tuple[float, str, str, str, str]]:
            return self.machine.update(self.tick, self.asked) if self.asked else []

        def step(self, tick: float, stage: str, asked: str, *values) -> list[tuple[float, str, str, str, str]]:
            moves = []
            if tick != self.tick:
                moves, self.tick, self.asked = self.close(), float(tick), {}
            given = {n: (float if n == "ratio" else int)(v) for n, v in zip(more, values, strict=True) if v is not None and v == v}
            self.asked[stage] = Reading(asked, **given)
            return moves

    return fold_groups(df, run, ["tick", "stage"], ["tick", "stage", "asked", *more], Run, Run.step, Run.close, "tick double, stage string, old string, new string, reason string")


def failure_plan(steps: DataFrame, kinds: dict[str, float], seed: int) -> DataFrame:
    """At most one failure for each row of steps(stage, step): kinds in order, each with its probability, by the first eight
    bytes of sha256("seed:stage:step:kind")."""
    hit = F.lit(None).cast("string")
    for kind, p in reversed(kinds.items()):
        u = derived_seed(F.lit(seed), F.concat_ws(":", F.col("stage"), F.col("step").cast("string"), F.lit(kind))) / 2147483647.0
        hit = F.when(u < p, kind).otherwise(hit)
    return steps.select("stage", "step", hit.alias("failure_type")).where("failure_type is not null")
