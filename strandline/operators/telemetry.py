"""Telemetry digests, trackers and drift."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import artifact_name, metric_name
from strandline.operators import scans

QUANTILES = (0.5, 0.9, 0.95, 0.99)


def normalise_events(df: DataFrame) -> DataFrame:
    """stage, duration_s, memory_delta and correlation_id of events(name, duration_s, metadata map)."""
    return df.select(F.coalesce("name", F.lit("unknown")).alias("stage"), F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"), F.col("metadata")["memory_delta_bytes"].try_cast("double").alias("memory_delta"), F.nullif(F.col("metadata")["correlation_id"], F.lit("")).alias("correlation_id"))


def quantiles(column: str, exact: bool = True, at: tuple[float, ...] = QUANTILES) -> list[Column]:
    """Exact quantiles keep each distinct value of a group; the approximate ones have a fixed size."""
    make = F.percentile if exact else F.percentile_approx
    return [make(F.col(column), F.lit(q)).alias(f"p{round(q * 100)}") for q in at]


def moments(column: str, sample: bool = True) -> list[Column]:
    c = F.col(column)
    var, std = (F.var_samp, F.stddev_samp) if sample else (F.var_pop, F.stddev_pop)
    return [F.count(c).alias("event_count"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.coalesce(var(c), F.lit(0.0)).alias("variance"), F.coalesce(std(c), F.lit(0.0)).alias("stdev")]


def digest(df: DataFrame, stage: str = "stage", value: str = "duration_s", exact: bool = True, overall: bool = True) -> DataFrame:
    """Per stage, and over all (stage null) unless told not to: count, moments with sample variance (0 for one event), quantiles.

    Exact quantiles are selected by ranks, so that no task holds a stage; ``exact=False`` takes one pass with fixed-size sketches."""
    rows = df.select(F.col(stage).alias("stage"), F.col(value).alias("v"))
    if not exact:
        return (rows.rollup if overall else rows.groupBy)("stage").agg(*moments("v"), *quantiles("v", False))
    names = {f"p{round(q * 100)}": q for q in QUANTILES}
    levels = rows.withColumn("whole", F.lit(False))
    if overall:
        levels = levels.withColumn("whole", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("stage", F.when(~F.col("whole"), F.col("stage")))
    found = scans.exact_quantiles(levels, ["stage", "whole"], "v", names)
    out = levels.groupBy("stage", "whole").agg(*moments("v"))
    return scans.same_keys(out, found, ["stage", "whole"], "left").drop("whole")


def memory_digest(df: DataFrame, stage: str = "stage", memory: str = "memory_delta") -> DataFrame:
    """The same over events that carry a memory delta."""
    return digest(df.where(F.col(memory).isNotNull()), stage, memory)


def tracker(df: DataFrame, keys: list[str], value: str, exact: bool = True) -> DataFrame:
    """Count, mean, population deviation, extremes, quantiles."""
    return df.groupBy(*keys).agg(*moments(value, sample=False), *quantiles(value, exact))


def trackers(df: DataFrame, keys: list[str], values: list[str], exact: bool = True) -> DataFrame:
    """One tracker for each measure, in one pass over the rows."""
    long = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "measure", "value")
    return tracker(long, [*keys, "measure"], "value", exact)


def flatten_metrics(summary: DataFrame, prefix: str = "telemetry_stage", names: tuple[str, ...] = ("event_count", "total", "mean", "max", "p95")) -> DataFrame:
    """Long (metric, value) rows of per-stage summaries."""
    long = summary.where("stage is not null").select(metric_name(F.col("stage")).alias("s"), *[F.col(n).cast("double").alias(n) for n in names]).unpivot("s", list(names), "m", "value")
    return long.select(F.concat_ws("_", F.lit(prefix), "s", "m").alias("metric"), F.coalesce("value", F.lit(0.0)).alias("value"))


def summary_metrics(df: DataFrame, stage: str = "stage", value: str = "duration_s", memory: str = "memory_delta", exact: bool = True) -> DataFrame:
    """Long (metric, value) rows of a run's events: six over all, and sixteen of each stage, 0 where nothing was measured."""
    of = {f"m_{n}": c for n, c in (("count", F.count(memory)), ("total", F.sum(memory)), ("mean", F.avg(memory)), ("max", F.max(memory)), ("stdev", F.stddev_samp(memory)))}
    of |= {n: c for n, c in (("count", F.count(value)), ("total", F.sum(value)), ("mean", F.avg(value)), ("max", F.max(value)), ("stdev", F.stddev_samp(value)))}
    aggs = [c.cast("double").alias(n) for n, c in of.items()]
    aggs += [q.cast("double").alias(f"{p}p{round(at * 100)}") for p, column in (("", value), ("m_", memory)) for at, q in zip(QUANTILES, quantiles(column, exact), strict=True)]
    rows = df.rollup(F.col(stage).alias("stage")).agg(*aggs, F.grouping_id().alias("level"))
    over_all = {"event_count": "count", "total_duration_s": "total", "mean_duration_s": "mean", "memory_event_count": "m_count", "total_memory_delta_bytes": "m_total", "mean_memory_delta_bytes": "m_mean"}
    names = ("mean", "p50", "p90", "p95", "p99", "max", "stdev")
    of_stage = {"count": "count"} | {f"{n}_duration_s": n for n in names} | {"memory_delta_count": "m_count"} | {f"memory_delta_{n}_bytes": f"m_{n}" for n in names}
    out = None
    for level, columns, prefix in ((1, over_all, F.lit("telemetry_")), (0, of_stage, F.concat(F.lit("telemetry_stage_"), metric_name(F.col("stage")), F.lit("_")))):
        some = rows.where(F.col("level") == level).select(prefix.alias("prefix"), *[F.col(c).alias(n) for n, c in columns.items()])
        some = some.unpivot("prefix", list(columns), "m", "value").select(F.concat("prefix", "m").alias("metric"), F.coalesce("value", F.lit(0.0)).alias("value"))
        out = some if out is None else out.unionByName(some)
    return out


def correlation_min(df: DataFrame, stage: str = "stage", cid: str = "correlation_id") -> DataFrame:
    """The least correlation id of each stage, and whether there are several; empty ids don't count."""
    c = F.nullif(F.col(cid), F.lit(""))
    return df.groupBy(stage).agg(F.min(c).alias("correlation_id"), (F.min(c) != F.max(c)).alias("conflict")).where("correlation_id is not null")


#: Drift policies by name: status of (baseline, current, delta, limit).  Others can be added.
DRIFT_POLICIES: dict[str, Callable[[Column, Column, Column, float], Column]] = {
    "relative": lambda b, c, d, most: F.when(b <= 0, F.when(d > 0, "warn").otherwise("pass")).when(d / b > most, "fail").otherwise("pass"),
    "absolute": lambda b, c, d, most: F.when(F.abs(d) > most, "fail").otherwise("pass"),
}


def drift(baseline: DataFrame, current: DataFrame, metrics: tuple[str, ...], policies: Mapping[str, float]) -> DataFrame:
    """Findings of policies (name to limit) over stages present in both summaries."""
    b, c = (x.where("stage is not null").select("stage", *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics]).unpivot("stage", list(metrics), "metric", v) for x, v in ((baseline, "baseline"), (current, "current")))
    both = c.join(b, ["stage", "metric"]).withColumn("delta", F.col("current") - F.col("baseline"))
    found = [DRIFT_POLICIES[n](F.col("baseline"), F.col("current"), F.col("delta"), most).alias(f"{n}_status") for n, most in policies.items()]
    return both.select("stage", "metric", "baseline", "current", "delta", *found)


def summarize_relocalization(df: DataFrame, keys: list[str], latency: str, success: Column) -> DataFrame:
    """Attempts, successes, rate and latency of search events; zeros where there are none."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if(success).alias("successes"), z(F.try_divide(F.count_if(success), F.count("*"))).alias("success_rate"), z(F.avg(latency)).alias("latency_mean"), z(F.percentile(F.col(latency), F.lit(0.5))).alias("latency_p50"), z(F.percentile(F.col(latency), F.lit(0.95))).alias("latency_p95"))


def relocalized_frames(df: DataFrame, keys: list[str], frame: str, ok: Column, lost: Column, matches: str) -> DataFrame:
    """Match statistics of relocalized frames, and the gap from the first loss to the first one after it."""
    loss = df.where(lost).groupBy(*keys).agg(F.min(frame).alias("loss"))
    hits = df.where(ok).join(loss, keys, "left")
    return hits.groupBy(*keys).agg(F.count("*").alias("frames"), F.avg(matches).alias("match_mean"), F.percentile(F.col(matches), F.lit(0.5)).alias("match_p50"), F.percentile(F.col(matches), F.lit(0.95)).alias("match_p95"), F.min(F.when(F.col(frame) > F.col("loss"), F.col(frame) - F.col("loss"))).alias("recovery_gap")).withColumn("recovered", F.col("recovery_gap").isNotNull())


def diagnostics(df: DataFrame, keys: list[str], matches: str, inliers: str, parallax: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("frame_count"), F.avg(matches).alias("match_mean"), F.avg(inliers).alias("inlier_mean"), F.avg(parallax).alias("parallax_mean"), F.median(parallax).alias("parallax_median"))


def category_ratios(df: DataFrame, dims: list[str], failure_dims: tuple[str, ...] = ()) -> DataFrame:
    """dimension, category, n, ratio: shares of all rows, or of rows that have a value for failure dimensions.

    One pass: the dimensions are unpivoted after a partial count of their combinations."""
    combos = df.groupBy(*dims).agg(F.count("*").alias("n"))
    long = combos.select("n", *[F.col(d).cast("string").alias(d) for d in dims]).unpivot("n", dims, "dimension", "category")
    counts = long.groupBy("dimension", "category").agg(F.sum("n").alias("n"))
    base = long.where(~F.col("dimension").isin(*failure_dims) | F.col("category").isNotNull() if failure_dims else F.lit(True)).groupBy("dimension").agg(F.sum("n").alias("of"))
    return counts.where("category is not null").join(F.broadcast(base), "dimension").select("dimension", "category", "n", (F.col("n") / F.col("of")).alias("ratio"))  # one row a dimension


def diagnostics_metrics(df: DataFrame, matches: str, inliers: str, ratio: str, parallax: str, score: str, dims: dict[str, str], failure: str = "failure") -> DataFrame:
    """Long (metric, value) rows of a run's frames: counts and means, the median parallax, and count and share of each category
    of the dimensions (name to column); shares of ``failure`` are of the rows that have one."""
    over_all = df.agg(*[c.cast("double").alias(n) for n, c in (("diag_frame_count", F.count("*")), ("diag_match_mean", F.avg(matches)), ("diag_inlier_mean", F.avg(inliers)), ("diag_inlier_ratio_mean", F.avg(ratio)), ("diag_parallax_median", F.median(parallax)), ("diag_score_mean", F.avg(score)))])
    long = over_all.withColumn("k", F.lit(0)).unpivot("k", over_all.columns, "metric", "value").select("metric", "value")
    shares = category_ratios(df.select(*[F.col(c).cast("string").alias(n) for n, c in dims.items()]), list(dims), (failure,) if failure in dims else ())
    shares = shares.select("dimension", artifact_name(F.col("category")).alias("category"), F.col("n").cast("double").alias("count"), "ratio").unpivot(["dimension", "category"], ["count", "ratio"], "m", "value")
    return long.unionByName(shares.select(F.concat_ws("_", F.lit("diag"), "dimension", "category", "m").alias("metric"), "value"))


def macro_means(long: DataFrame) -> DataFrame:
    """The mean of each metric over the sequences that have it, as rows without a sequence."""
    known = long.where("value is not null and not isnan(value)")
    return known.groupBy("metric").agg(F.avg("value").alias("value")).select(F.lit(None).cast("string").alias("sequence"), "metric", "value")
