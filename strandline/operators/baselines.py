"""Baseline comparison, gates, severity and readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import BOUNDS, STATE_RANK, STATUS_RANK, known_status, metric_status, normal_state, ratio, severity, worst


def compare(current: DataFrame, baseline: DataFrame, thresholds: DataFrame) -> DataFrame:
    """current(key, metric, value), baseline(key, metric, value), thresholds(metric, max_delta, min_delta, max_ratio, min_ratio).

    Metrics that only the baseline has are left out; without a threshold a metric passes."""
    b = baseline.select("key", "metric", F.col("value").alias("baseline"))
    rows = current.select("key", "metric", F.col("value").alias("current")).join(b, ["key", "metric"], "left").join(thresholds, "metric", "left")
    rows = rows.withColumn("delta", F.col("current") - F.col("baseline")).withColumn("ratio", ratio(F.col("delta"), F.col("baseline")))
    status = metric_status(*(F.col(c) for c in ("baseline", "delta", "ratio", *BOUNDS)))
    return rows.withColumn("status", status).select("key", "metric", "baseline", "current", "delta", "ratio", *BOUNDS, "status")


def gate(compared: DataFrame) -> DataFrame:
    """Per key: pass only if every metric passes."""
    return compared.groupBy("key").agg(F.when(F.bool_and(F.col("status") == "pass"), "pass").otherwise("regressed").alias("status"), F.count("*").alias("metrics"), F.count_if(F.col("status") != "pass").alias("failing"))


def severity_scores(compared: DataFrame, weights: DataFrame, default: float = 1.0, telemetry: DataFrame | None = None, telemetry_weights: DataFrame | None = None) -> DataFrame:
    """Per key: weighted sums of squared severities of metrics and of telemetry metrics, the root of both as score, all
    weights, and the worst severity.  Metrics without a weight take the default."""

    def rows(df: DataFrame, named: DataFrame | None, name: str) -> DataFrame:
        df = df.withColumn("severity", severity(*(F.col(c) for c in ("status", "delta", "ratio", *BOUNDS))))
        df = df.withColumn("weight", F.lit(None).cast("double")) if named is None else df.join(named.select("metric", "weight"), "metric", "left")
        w = F.coalesce("weight", F.lit(default))
        square = w * F.col("severity") * F.col("severity")
        return df.select("key", "severity", w.alias("weight"), *[(square if name == n else F.lit(0.0)).alias(n) for n in ("metrics_penalty", "telemetry_penalty")])

    both = rows(compared, weights, "metrics_penalty")
    if telemetry is not None:
        both = both.unionByName(rows(telemetry, telemetry_weights, "telemetry_penalty"))
    found = both.groupBy("key").agg(F.sum("metrics_penalty").alias("metrics_penalty"), F.sum("telemetry_penalty").alias("telemetry_penalty"), F.sum("weight").alias("total_weight"), F.max("severity").alias("worst"))
    return found.withColumn("score", F.sqrt(F.col("metrics_penalty") + F.col("telemetry_penalty")))


def run_status(df: DataFrame) -> DataFrame:
    """error over budget_exceeded over missing_baseline over regressed over pass, of (return_code, runtime_s, memory_bytes and their budgets, comparison)."""
    over_time, over_memory = (F.coalesce(F.col(a) > F.col(b), F.lit(False)) for a, b in (("runtime_s", "runtime_budget_s"), ("memory_bytes", "memory_budget_bytes")))
    status = F.when(F.coalesce("return_code", F.lit(0)) != 0, "error").when(over_time | over_memory, "budget_exceeded").when(F.col("comparison").isin("missing_baseline", "regressed"), F.col("comparison")).otherwise("pass")
    return df.withColumns({"runtime_budget": F.when(over_time, "over").otherwise("ok"), "memory_budget": F.when(over_memory, "over").otherwise("ok"), "status": status})


def run_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("runs"), F.sum("runtime_s").alias("runtime_total"), F.avg("runtime_s").alias("runtime_mean"), F.max("runtime_s").alias("runtime_max"), F.min("runtime_s").alias("runtime_min"), F.max("memory_bytes").alias("memory_max"))


def stage_health(df: DataFrame) -> DataFrame:
    """State of counters(stage, breaker, errors, depth, capacity): open breaker tripped, half open recovering, errors degraded."""
    state = F.when(F.col("breaker") == "open", "tripped").when(F.col("breaker") == "half_open", "recovering").when(F.col("errors") > 0, "degraded").otherwise("healthy")
    return df.withColumn("state", state).withColumn("depth_ratio", F.coalesce(F.try_divide(F.col("depth"), F.col("capacity")), F.lit(0.0)))


def state_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(normal_state(F.col("state")).alias("state")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("stage")).alias("stages"))


def global_state(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(worst(STATE_RANK, normal_state(F.col("state"))), F.lit("healthy")).alias("global_state"), F.count("*").alias("stages"))


def readiness(parts: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """The worst of the parts' statuses; what is not pass, warn or fail is unknown, and with strict regressed is fail."""
    s = F.when(F.lit(strict) & (F.col("status") == "regressed"), "fail").otherwise(known_status(F.col("status")))
    return parts.groupBy(*keys).agg(F.coalesce(worst(STATUS_RANK, s), F.lit("pass")).alias("status"), F.count("*").alias("parts"))


def status_of_state(df: DataFrame) -> DataFrame:
    """Readiness of a stage's state; any other state, idle among them, is unknown."""
    s = F.lower("state")
    return df.withColumn("status", F.when(s.isin("tripped", "error", "failed", "halted"), "fail").when(s.isin("degraded", "recovering"), "warn").when(s.isin("healthy", "ok"), "pass").otherwise("unknown"))
