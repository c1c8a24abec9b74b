"""Order-dependent operators: windows over keyed, totally ordered rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.scalars import is_error_event
from strandline.operators.machines import fold_groups


def merge_events(*streams: DataFrame, span_s: float = 3600.0) -> DataFrame:
    """Union of (stage, event_type, message, metadata, timestamp_s) rows with seq_id per stage and the global order's columns.

    seq_id counts each stage's events by time, type, message and metadata; (timestamp_s, stage, seq_id) is total.  Events are
    numbered inside spans of time, and each span starts where the counts of those before end, so no task sorts a stage."""
    rows = streams[0]
    for more in streams[1:]:
        rows = rows.unionByName(more)
    rows = rows.withColumn("span", F.coalesce(F.floor(F.col("timestamp_s") / span_s), F.lit(-(2**62))))
    before = Window.partitionBy("stage").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("stage", "span").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("stage").alias("_stage"), F.col("span").alias("_span"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    w = Window.partitionBy("stage", "span").orderBy("timestamp_s", "event_type", "message", "metadata")
    rows = rows.withColumn("place", F.row_number().over(w) - 1)
    rows = rows.join(counts, rows["stage"].eqNullSafe(counts["_stage"]) & (rows["span"] == counts["_span"]))
    return rows.withColumn("seq_id", (F.col("start") + F.col("place")).cast("long")).drop("_stage", "_span", "span", "start", "place")


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest n rows of each key; Spark prunes by rank before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def error_counts(df: DataFrame, n: int = 64) -> DataFrame:
    """Error events among each stage's last n, in the order of ``merge_events``, and what they ask for: degraded from 2,
    tripped from 4.  Only the last n of each task are shuffled."""
    recent = last_n(df, ["stage"], ["timestamp_s", "event_type", "message", "metadata"], n)
    counted = recent.groupBy("stage").agg(F.count_if(is_error_event(F.col("event_type"), F.col("message"))).alias("errors"), F.count("*").alias("seen"))
    return counted.withColumn("asked", F.when(F.col("errors") >= 4, "tripped").when(F.col("errors") >= 2, "degraded").otherwise("healthy"))


def relative_time(df: DataFrame, keys: list[str], order: str, ts: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("relative_s", F.col(ts) - F.first(ts).over(w))


def monotonic(df: DataFrame, keys: list[str], order: str, ts: str) -> DataFrame:
    """Whether each key's stamps are all there and never fall."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = df.withColumn("falls", F.coalesce(F.col(ts) < F.lag(ts).over(w), F.lit(False)))
    return step.groupBy(*keys).agg((F.count(ts) == F.count("*")).alias("complete"), (~F.bool_or("falls")).alias("monotonic"), F.count("*").alias("n"))


def counter_delta(df: DataFrame, keys: list[str], order: str, counter: str, warn: float, trip: float) -> DataFrame:
    """Growth of a counter since the row before, and the state it asks for.  Counters start from 0, absent ones are 0, and
    growth is never negative."""
    w = Window.partitionBy(*keys).orderBy(order)
    now = F.coalesce(counter, F.lit(0))
    delta = F.greatest(now - F.coalesce(F.lag(now).over(w), F.lit(0)), F.lit(0))
    return df.withColumn("delta", delta).withColumn("asked", F.when(F.col("delta") >= trip, "tripped").when(F.col("delta") >= warn, "degraded").otherwise("healthy"))


def versus_previous(df: DataFrame, keys: list[str], order: str, value: str, most: float) -> DataFrame:
    """Each run against the one before: baseline at first, else regressed above a relative growth."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("previous", F.lag(value).over(w)).withColumn("delta", F.col(value) - F.col("previous"))
    rel = F.try_divide(F.col("delta"), F.abs("previous"))
    return out.withColumn("status", F.when(F.col("previous").isNull(), "baseline").when(rel > most, "regressed").otherwise("pass"))


def solver_gate(df: DataFrame, keys: list[str], order: str, cost: str = "cost", iterations: str = "iterations", limits: dict[str, float] | None = None) -> DataFrame:
    """Each solve against the one before it, whatever that one's status: deltas, ratios (null after 0), the limits
    (max_cost, max_iterations, max_cost_ratio, max_iteration_ratio) it breaks in this order, and baseline, pass or regressed."""
    limits = {"max_cost_ratio": 0.25, "max_iteration_ratio": 0.5} if limits is None else limits
    w = Window.partitionBy(*keys).orderBy(order)
    out = df
    for name, column in (("cost", cost), ("iteration", iterations)):
        last = F.lag(column).over(w)
        out = out.withColumn(f"{name}_delta", F.col(column) - last).withColumn(f"{name}_ratio", F.try_divide(F.col(f"{name}_delta").cast("double"), F.abs(last)))
    broken = {"max_cost": F.col(cost), "max_iterations": F.col(iterations), "max_cost_ratio": F.col("cost_ratio"), "max_iteration_ratio": F.col("iteration_ratio")}
    found = F.array_compact(F.array(*[F.when(c > limits[n], n) for n, c in broken.items() if limits.get(n) is not None], F.lit(None).cast("string")))
    out = out.withColumn("triggered", found)
    first = F.col("cost_delta").isNull() & F.col("iteration_delta").isNull()
    return out.withColumn("status", F.when(F.size("triggered") > 0, "regressed").when(first, "baseline").otherwise("pass"))


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int | None) -> DataFrame:
    """At most the first n rows of each sequence, as a source with a frame limit gives; None is no limit."""
    if n is None:
        return df
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def throughput(df: DataFrame, keys: list[str], order: str, elapsed_s: Column) -> DataFrame:
    """Rows so far, their share of the key's rows, and rows a second."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.count("*").over(w)
    return df.withColumn("seen", seen).withColumn("progress", seen / F.count("*").over(Window.partitionBy(*keys))).withColumn("rate", F.try_divide(seen, elapsed_s))


def carry_forward(df: DataFrame, keys: list[str], order: str, columns: list[str], n: int = 120) -> DataFrame:
    """Missing values take the last known one; then the newest n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return last_n(df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}), keys, [order], n)


def averaging(alpha: float) -> tuple[Callable, Callable]:
    """Start and step of y = alpha x + (1 - alpha) y from y = x at first; null and NaN values leave y as it is."""

    def step(state: list, x: float | None) -> float | None:
        if x is not None and x == x:
            state[0] = x if state[0] is None else alpha * x + (1 - alpha) * state[0]
        return state[0]

    return lambda: [None], step


def moving_average(df: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """The last average of each key (see ``averaging``) and its number of rows.  Rows stream through a fold."""
    average = averaging(alpha)[1]

    def step(state: list, x: float | None) -> tuple:
        state[1] += 1
        average(state, x)
        return ()

    rows = df.select(key, order, F.col(value).cast("double").alias(value))
    return fold_groups(rows, key, [order], [value], lambda: [None, 0], step, lambda s: [tuple(s)], "ema double, n long")


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Fixed bins, half open but for the last; values outside are left out."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def choose_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a composite order."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("r = 1").drop("r")


def replace_key(store: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Upsert: rows of keys in ``new`` give way."""
    return store.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
