"""The registered queries over the driver's tables, each beside the SQL that a second engine answers it with.

``events`` stand for telemetry (event_type is the stage, value a duration, user_id a run), ``orders`` and ``lineitem`` for
trajectories and diagnostics, ``embeddings`` for histograms, ``nation`` and ``supplier`` for dependency edges and
``documents`` for artifacts.  Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import canonical, scalars
from strandline.operators import baselines, graphs, joins, loops, machines, ordered, similarity, telemetry, trajectory

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Rounded to six decimals; -0 becomes 0."""
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


def seconds(ts: str = "ts"):
    """Epoch seconds of a time without zone."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("event_type").alias("stage"), F.col("value").alias("duration_s"), seconds().alias("ts"), F.get_json_object("props", "$.k").cast("double").alias("memory_delta"))


STATS = ("total", "mean", "min", "max", "variance", "stdev", "p50", "p90", "p95", "p99")
_STATS_SQL = """count({v}) as event_count, round(sum({v}), 6) as total, round(avg({v}), 6) as mean, round(min({v}), 6) as min, round(max({v}), 6) as max,
 round(coalesce({var}({v}), 0), 6) as variance, round(coalesce({std}({v}), 0), 6) as stdev, round(quantile_cont({v}, 0.5), 6) as p50, round(quantile_cont({v}, 0.9), 6) as p90,
 round(quantile_cont({v}, 0.95), 6) as p95, round(quantile_cont({v}, 0.99), 6) as p99"""


def stats_sql(v: str, sample: bool = True) -> str:
    return _STATS_SQL.format(v=v, var="var_samp" if sample else "var_pop", std="stddev_samp" if sample else "stddev_pop")


EV = "(select event_id, user_id, event_type as stage, value as duration_s, epoch_us(ts) / 1e6 as ts, cast(json_extract_string(props, '$.k') as double) as memory_delta from events)"


@query(f"select stage, {stats_sql('duration_s')} from {EV} group by rollup(stage)")
def telemetry_digest(spark, sf_dir):
    return r6(telemetry.digest(events(spark, sf_dir)), *STATS)


@query(f"select stage, {stats_sql('memory_delta')} from {EV} where memory_delta is not null group by rollup(stage)")
def telemetry_memory_digest(spark, sf_dir):
    return r6(telemetry.memory_digest(events(spark, sf_dir)), *STATS)


@query(f"select user_id, stage, {stats_sql('duration_s', False)} from {EV} group by user_id, stage")
def tracker_summary(spark, sf_dir):
    return r6(telemetry.tracker(events(spark, sf_dir), ["user_id", "stage"], "duration_s"), *STATS)


@query(f"""with s as (select stage, {stats_sql('duration_s')} from {EV} group by stage),
l as (unpivot (select stage, cast(event_count as double) as event_count, total, mean, max, p95 from s) on event_count, total, mean, max, p95 into name m value v)
select 'telemetry_stage_' || trim(regexp_replace(lower(trim(stage)), '[^a-z0-9]', '_', 'g'), '_') || '_' || m as metric, round(v, 6) as value from l""")
def telemetry_metric_flatten(spark, sf_dir):
    return r6(telemetry.flatten_metrics(telemetry.digest(events(spark, sf_dir))), "value")


@query(f"""with h as (select *, ts >= (select (min(ts) + max(ts)) / 2 from {EV}) as late from {EV}),
s as (select stage, late, avg(duration_s) as mean, quantile_cont(duration_s, 0.95) as p95 from h group by stage, late),
l as (unpivot s on mean, p95 into name metric value v),
j as (select b.stage, b.metric, b.v as baseline, c.v as current, c.v - b.v as delta from l b join l c on b.stage = c.stage and b.metric = c.metric and not b.late and c.late)
select stage, metric, round(baseline, 6) as baseline, round(current, 6) as current, round(delta, 6) as delta,
 case when baseline <= 0 then case when delta > 0 then 'warn' else 'pass' end when delta / baseline > 0.02 then 'fail' else 'pass' end as relative_status,
 case when abs(delta) > 0.5 then 'fail' else 'pass' end as absolute_status from j""")
def telemetry_drift(spark, sf_dir):
    e = events(spark, sf_dir)
    middle = e.agg(((F.min("ts") + F.max("ts")) / 2).alias("m")).first()["m"]
    halves = [telemetry.digest(e.where(test), overall=False) for test in (F.col("ts") < middle, F.col("ts") >= middle)]
    return r6(telemetry.drift(*halves, ("mean", "p95"), {"relative": 0.02, "absolute": 0.5}), "baseline", "current", "delta")


@query(f"select stage, min('u' || user_id) as correlation_id, count(distinct user_id) > 1 as conflict from {EV} group by stage")
def correlation_min(spark, sf_dir):
    return telemetry.correlation_min(events(spark, sf_dir).withColumn("correlation_id", F.concat(F.lit("u"), F.col("user_id"))))


@query("""select l_returnflag as method, count(*) as frame_count, round(avg(l_quantity), 6) as match_mean, round(avg(l_extendedprice), 6) as inlier_mean, round(avg(l_discount), 6) as parallax_mean, round(median(l_discount), 6) as parallax_median from lineitem group by 1""")
def diagnostics_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "method")
    return r6(telemetry.diagnostics(rows, ["method"], "l_quantity", "l_extendedprice", "l_discount"), "match_mean", "inlier_mean", "parallax_mean", "parallax_median")


@query("""with d as (select l_returnflag as method, l_linestatus as status, case when l_tax > 0.06 then 'tax_' || l_linenumber end as failure from lineitem),
l as (select 'method' as dimension, method as category from d union all select 'status', status from d union all select 'failure', failure from d)
select dimension, category, count(*) as n, round(count(*) / sum(count(*)) over (partition by dimension), 6) as ratio from l where category is not null group by 1, 2""")
def diagnostics_category_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("status"), F.when(F.col("l_tax") > 0.06, F.concat(F.lit("tax_"), F.col("l_linenumber"))).alias("failure"))
    return r6(telemetry.category_ratios(d, ["method", "status", "failure"], ("failure",)), "ratio")


@query(f"""select user_id, count(*) as attempts, count(*) filter (memory_delta > 50) as successes, round(count(*) filter (memory_delta > 50) / count(*), 6) as success_rate,
 round(avg(duration_s), 6) as latency_mean, round(quantile_cont(duration_s, 0.5), 6) as latency_p50, round(quantile_cont(duration_s, 0.95), 6) as latency_p95 from {EV} where stage = 'view' group by user_id""")
def relocalization_events(spark, sf_dir):
    e = events(spark, sf_dir).where(F.col("stage") == "view")
    return r6(telemetry.summarize_relocalization(e, ["user_id"], "duration_s", F.col("memory_delta") > 50), "success_rate", "latency_mean", "latency_p50", "latency_p95")


@query(f"""with loss as (select user_id, min(event_id) as loss from {EV} where stage = 'error' group by 1),
h as (select e.*, loss from {EV} e left join loss using (user_id) where stage = 'purchase')
select user_id, count(*) as frames, round(avg(duration_s), 6) as match_mean, round(quantile_cont(duration_s, 0.5), 6) as match_p50, round(quantile_cont(duration_s, 0.95), 6) as match_p95,
 min(case when event_id > loss then event_id - loss end) as recovery_gap, min(case when event_id > loss then event_id - loss end) is not null as recovered from h group by user_id""")
def relocalization_frames(spark, sf_dir):
    e = events(spark, sf_dir)
    return r6(telemetry.relocalized_frames(e, ["user_id"], "event_id", F.col("stage") == "purchase", F.col("stage") == "error", "duration_s"), "match_mean", "match_p50", "match_p95")


_THRESHOLDS = {"mean": 0.5, "p95": {"max_ratio": 0.05}, "max": {"direction": "lower", "tolerance": 0.0}, "min": {"direction": "higher", "tolerance": 0.01}, "n": {}}


def _compare_sql(v: str = "duration_s") -> str:
    return f"""t(metric, max_delta, min_delta, max_ratio, min_ratio) as (values ('mean', 0.5::double, null::double, null::double, null::double), ('p95', null, null, 0.05, null), ('max', 0.0, null, null, null), ('min', null, -0.01, null, null)),
s as (select 'run' || user_id as key, event_id % 2 as half, avg({v}) as mean, quantile_cont({v}, 0.95) as p95, max({v}) as max, min({v}) as min, count(*)::double as n from {EV} group by 1, 2),
l as (unpivot s on mean, p95, max, min, n into name metric value v),
j as (select c.key, c.metric, b.v as baseline, c.v as current, c.v - b.v as delta, case when b.v <> 0 then (c.v - b.v) / abs(b.v) end as ratio, t.max_delta, t.min_delta, t.max_ratio, t.min_ratio
 from (select * from l where half = 1) c left join (select * from l where half = 0) b on b.key = c.key and b.metric = c.metric left join t on t.metric = c.metric),
k as (select *, case when max_delta is null and min_delta is null and max_ratio is null and min_ratio is null then 'pass' when baseline is null then 'missing_baseline' when (max_ratio is not null or min_ratio is not null) and ratio is null then 'regressed'
 when coalesce(delta > max_delta, false) or coalesce(delta < min_delta, false) or coalesce(ratio > max_ratio, false) or coalesce(ratio < min_ratio, false) then 'regressed' else 'pass' end as status from j)"""


_COMPARE_SQL = _compare_sql()


def _compared(spark, sf_dir, value: str = "duration_s") -> DataFrame:
    d = F.col(value)
    e = events(spark, sf_dir).select(F.concat(F.lit("run"), F.col("user_id")).alias("key"), (F.col("event_id") % 2).alias("half"), value)
    s = e.groupBy("key", "half").agg(F.avg(d).alias("mean"), F.percentile(d, F.lit(0.95)).alias("p95"), F.max(d).alias("max"), F.min(d).alias("min"), F.count("*").cast("double").alias("n"))
    long = s.unpivot(["key", "half"], ["mean", "p95", "max", "min", "n"], "metric", "value")
    limits = spark.createDataFrame(scalars.threshold_rows(_THRESHOLDS), "metric string, max_delta double, min_delta double, max_ratio double, min_ratio double")
    return baselines.compare(long.where("half = 1"), long.where("half = 0"), limits)


@query(f"with {_COMPARE_SQL} select key, metric, round(baseline, 6) as baseline, round(current, 6) as current, round(delta, 6) as delta, round(ratio, 6) as ratio, max_delta, min_delta, max_ratio, min_ratio, status from k")
def baseline_compare(spark, sf_dir):
    return r6(_compared(spark, sf_dir), "baseline", "current", "delta", "ratio")


@query(f"with {_COMPARE_SQL} select key, case when bool_and(status = 'pass') then 'pass' else 'regressed' end as status, count(*) as metrics, count(*) filter (status <> 'pass') as failing from k group by key")
def regression_gate_status(spark, sf_dir):
    return baselines.gate(_compared(spark, sf_dir))


_SEVERITY_SQL = """case when status = 'missing_baseline' then 1 else sqrt(
 pow(case when max_delta is null then 0 when delta is null then 1 else greatest((delta - max_delta) / greatest(abs(max_delta), 1e-12), 0) end, 2)
 + pow(case when min_delta is null then 0 when delta is null then 1 else greatest((min_delta - delta) / greatest(abs(min_delta), 1e-12), 0) end, 2)
 + pow(case when max_ratio is null then 0 when ratio is null then 1 else greatest((ratio - max_ratio) / greatest(abs(max_ratio), 1e-12), 0) end, 2)
 + pow(case when min_ratio is null then 0 when ratio is null then 1 else greatest((min_ratio - ratio) / greatest(abs(min_ratio), 1e-12), 0) end, 2)) end"""


@query(f"""with a as (with {_COMPARE_SQL} select key, {_SEVERITY_SQL} as sev, case metric when 'mean' then 2.0 when 'min' then 0.5 else 1.0 end as w, 0 as kind from k),
b as (with {_compare_sql('memory_delta')} select key, {_SEVERITY_SQL} as sev, case metric when 'p95' then 3.0 else 1.0 end as w, 1 as kind from k),
c as (select key, coalesce(sum(w * sev * sev) filter (kind = 0), 0) as m, coalesce(sum(w * sev * sev) filter (kind = 1), 0) as t, sum(w) as total_weight, max(sev) as worst from (select * from a union all select * from b) group by key)
select key, round(sqrt(m + t) / 1e6, 6) as score, round(sqrt(m) / 1e6, 6) as metrics_score, round(sqrt(t) / 1e6, 6) as telemetry_score, total_weight, round(worst / 1e6, 6) as worst from c""")
def severity_score(spark, sf_dir):
    weights = spark.createDataFrame([("mean", 2.0), ("min", 0.5)], "metric string, weight double")
    telemetry_weights = spark.createDataFrame([("p95", 3.0)], "metric string, weight double")
    s = baselines.severity_scores(_compared(spark, sf_dir), weights, 1.0, _compared(spark, sf_dir, "memory_delta"), telemetry_weights)
    c = F.col
    s = s.select("key", (c("score") / 1e6).alias("score"), (F.sqrt("metrics_penalty") / 1e6).alias("metrics_score"), (F.sqrt("telemetry_penalty") / 1e6).alias("telemetry_score"), "total_weight", (c("worst") / 1e6).alias("worst"))
    return r6(s, "score", "metrics_score", "telemetry_score", "worst")  # a bound of 0 makes huge values


@query(f"""with r as (with {_COMPARE_SQL} select key, metric, case when status = 'missing_baseline' then 1 when max_ratio is null then 0 when ratio is null then 1 else greatest((ratio - max_ratio) / max_ratio, 0) end as penalty from k where metric = 'p95')
select key, round(penalty, 6) as penalty from r""")
def ratio_penalties(spark, sf_dir):
    """How far runs exceed a bound on the ratio, in units of the bound."""
    rows = _compared(spark, sf_dir).where("metric = 'p95'")
    return r6(rows.select("key", scalars.severity(*(F.col(c) for c in ("status", "delta", "ratio", *scalars.BOUNDS))).alias("penalty")), "penalty")


@query("""with o as (select o_orderkey as run, o_totalprice / 1000 as runtime_s, o_custkey as memory_bytes, case when o_orderpriority like '1%' then 1 else 0 end as return_code, case o_orderstatus when 'F' then 'regressed' when 'P' then 'missing_baseline' else 'pass' end as comparison from orders)
select status, runtime_budget, memory_budget, count(*) as n from (select *, case when runtime_s > 200 then 'over' else 'ok' end as runtime_budget, case when memory_bytes > 1000 then 'over' else 'ok' end as memory_budget,
 case when return_code <> 0 then 'error' when runtime_s > 200 or memory_bytes > 1000 then 'budget_exceeded' when comparison in ('regressed', 'missing_baseline') then comparison else 'pass' end as status from o) group by 1, 2, 3""")
def governance_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("runtime_s"), F.col("o_custkey").alias("memory_bytes"), F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(0).alias("return_code"), F.when(F.col("o_orderstatus") == "F", "regressed").when(F.col("o_orderstatus") == "P", "missing_baseline").otherwise("pass").alias("comparison"), F.lit(200.0).alias("runtime_budget_s"), F.lit(1000).alias("memory_budget_bytes"))
    return baselines.run_status(o).groupBy("status", "runtime_budget", "memory_budget").agg(F.count("*").alias("n"))


@query("select o_orderpriority as suite, count(*) as runs, round(sum(o_totalprice), 4) as runtime_total, round(avg(o_totalprice), 6) as runtime_mean, max(o_totalprice) as runtime_max, min(o_totalprice) as runtime_min, max(o_custkey) as memory_max from orders group by 1")
def run_statistics(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("suite"), F.col("o_totalprice").alias("runtime_s"), F.col("o_custkey").alias("memory_bytes"))
    return r6(baselines.run_statistics(o, ["suite"]), "runtime_mean").withColumn("runtime_total", F.round("runtime_total", 4))


_LOOPS = """select l_orderkey * 10 + l_linenumber as sample_id, l_quantity as match_count, floor(l_quantity * (1 - l_discount * 5)) as inlier_count, l_tax * 40 as e1, l_discount * 150 as e2, l_tax * 15 as e3, l_linenumber * 2.0 as gap_s, l_returnflag <> 'N' as expected from lineitem"""
_LOOPS_SQL = f"""a as ({_LOOPS}), b as (select *, coalesce(inlier_count / nullif(match_count, 0), 0) as ratio from a),
c as (select *, (least(1, match_count / 20) + least(1, ratio / 0.6) + greatest(0, 1 - e1 / 2.0) + greatest(0, 1 - e2 / 10.0) + greatest(0, 1 - e3 / 1.0)) / 5 as geometric, case when gap_s < 5 then 0 when gap_s <= 12 then 1 else greatest(0, 1 - (gap_s - 12) / 12) end as temporal from b),
d as (select *, 0.7 * geometric + 0.3 * temporal as combined from c),
e as (select *, concat_ws(',', case when match_count < 20 then 'match_count' end, case when ratio < 0.6 then 'inlier_ratio' end, case when e1 > 2 then 'reprojection_error' end, case when gap_s < 5 then 'temporal_separation' end, case when gap_s > 12 then 'temporal_out_of_range' end,
 case when e2 > 10 then 'rotation_error' end, case when e3 > 1 then 'translation_error' end, case when geometric < 0.7 then 'geometric_score' end, case when temporal < 0.6 then 'temporal_score' end, case when combined < 0.75 then 'combined_score' end) as reasons, reasons = '' as accepted from d)"""


def _loops(spark, sf_dir) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("sample_id"), c("l_quantity").alias("match_count"), F.floor(c("l_quantity") * (1 - c("l_discount") * 5)).alias("inlier_count"), (c("l_tax") * 40).alias("mean_reprojection_error"), (c("l_discount") * 150).alias("rotation_error_deg"), (c("l_tax") * 15).alias("translation_error"), (c("l_linenumber") * 2.0).alias("query_timestamp_s"), F.lit(0.0).alias("candidate_timestamp_s"), (c("l_returnflag") != "N").alias("expected_match"))
    return loops.score_loops(rows, min_matches=20, min_ratio=0.6, max_reprojection=2.0, min_gap_s=5.0, max_gap_s=12.0, max_translation=1.0)


@query(f"with {_LOOPS_SQL} select sample_id, round(geometric, 6) as geometric, round(temporal, 6) as temporal, round(combined, 6) as combined, reasons, accepted from e")
def loop_validation(spark, sf_dir):
    return r6(_loops(spark, sf_dir).select("sample_id", "geometric", "temporal", "combined", F.array_join("reasons", ",").alias("reasons"), "accepted"), "geometric", "temporal", "combined")


@query(f"""with {_LOOPS_SQL}, f as (select count(*) filter (expected and accepted) as tp, count(*) filter (not expected and accepted) as fp, count(*) filter (not expected and not accepted) as tn, count(*) filter (expected and not accepted) as fn from e)
select *, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall from f""")
def loop_confusion(spark, sf_dir):
    return r6(loops.confusion(_loops(spark, sf_dir), []), "accuracy", "precision", "recall")


@query("""select l_orderkey, l_linenumber, case when l_quantity < 20 then 'low_inlier_count' when l_discount < 0.03 then 'low_inlier_ratio' when l_tax < 0.02 then 'low_parallax' when l_returnflag = 'N' and l_linenumber * 4 < 8 then 'cheirality_inliers' when l_returnflag = 'N' and l_discount * 10 < 0.5 then 'cheirality_ratio' end as failure_reason,
 case when l_quantity < 40 then 'warning' when l_discount * 10 < 0.2 then 'error' when l_discount * 10 < 0.35 then 'warning' else 'ok' end as status from lineitem""")
def stability_gates(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_quantity").alias("inliers"), c("l_discount").alias("inlier_ratio"), c("l_tax").alias("parallax"), F.when(c("l_returnflag") == "N", "essential").otherwise("homography").alias("method"), (c("l_linenumber") * 4).alias("cheirality_inliers"), (c("l_discount") * 10).alias("cheirality_ratio"))
    out = loops.first_failing_gate(rows, 20, 0.03, 0.02, 8, 0.5)
    return out.select("l_orderkey", "l_linenumber", "failure_reason", loops.tracking_status(c("inliers"), c("cheirality_ratio")).alias("status"))


@query(f"select stage, least(floor((duration_s - 0) / 2.5), 19)::int as bin, count(*) as n from {EV} where duration_s between 0 and 50 group by 1, 2")
def residual_histogram(spark, sf_dir):
    return ordered.histogram(events(spark, sf_dir), ["stage"], "duration_s", 0.0, 50.0, 20)


def _stage_events(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    kind = F.when(F.col("memory_delta") > 90, "read_failure").when(F.col("memory_delta") > 80, "queue").otherwise("ok")
    message = F.when(F.col("memory_delta") < 5, "Timeout waiting").otherwise("")
    return e.select("event_id", "user_id", "stage", kind.alias("event_type"), message.alias("message"), F.col("event_id").cast("string").alias("metadata"), F.round("ts", 0).alias("timestamp_s"))


_SE = f"(select event_id, user_id, stage, case when memory_delta > 90 then 'read_failure' when memory_delta > 80 then 'queue' else 'ok' end as event_type, case when memory_delta < 5 then 'Timeout waiting' else '' end as message, cast(event_id as varchar) as metadata, round(ts, 0) as timestamp_s from {EV})"
_MERGED = f"(select *, row_number() over (partition by stage order by timestamp_s, event_type, message, metadata) - 1 as seq_id from {_SE})"


@query(f"select event_id, stage, timestamp_s, seq_id from {_MERGED}")
def event_merge_order(spark, sf_dir):
    e = _stage_events(spark, sf_dir)
    return ordered.merge_events(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1")).select("event_id", "stage", "timestamp_s", "seq_id")


@query(f"""with m as (select *, row_number() over (partition by stage order by timestamp_s desc, seq_id desc) as r from {_MERGED}),
c as (select stage, count(*) filter (regexp_matches(lower(event_type || ' ' || message), 'error|failure|timeout|exception|circuit|tripped|dropped')) as errors, count(*) as seen from m where r <= 64 group by stage)
select *, case when errors >= 4 then 'tripped' when errors >= 2 then 'degraded' else 'healthy' end as asked from c""")
def error_window_counts(spark, sf_dir):
    return ordered.error_counts(_stage_events(spark, sf_dir))


@query(f"select user_id, event_id, stage from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from {EV}) where r <= 16")
def ring_buffer_lastn(spark, sf_dir):
    return ordered.last_n(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 16).select("user_id", "event_id", "stage")


_HEALTH = f"(select user_id, stage, case when max(memory_delta) > 98 then 'open' when max(memory_delta) > 96 then 'half_open' else 'closed' end as breaker, count(*) filter (memory_delta < 3) as errors, count(*) as depth from {EV} group by 1, 2)"
_HEALTH_STATE = f"(select *, case when breaker = 'open' then 'tripped' when breaker = 'half_open' then 'recovering' when errors > 0 then 'degraded' else 'healthy' end as state from {_HEALTH})"


def _health(spark, sf_dir) -> DataFrame:
    m = F.col("memory_delta")
    e = events(spark, sf_dir).groupBy("user_id", "stage").agg(F.when(F.max(m) > 98, "open").when(F.max(m) > 96, "half_open").otherwise("closed").alias("breaker"), F.count_if(m < 3).alias("errors"), F.count("*").alias("depth"), F.lit(64).alias("capacity"))
    return baselines.stage_health(e)


@query(f"select state, count(*) as n, list_sort(list_distinct(list(stage))) as stages from {_HEALTH_STATE} group by state")
def stage_state_counts(spark, sf_dir):
    return baselines.state_counts(_health(spark, sf_dir))


@query(f"""select user_id, case max(case state when 'tripped' then 3 when 'degraded' then 2 when 'recovering' then 1 else 0 end) when 3 then 'tripped' when 2 then 'degraded' when 1 then 'recovering' else 'healthy' end as global_state, count(*) as stages from {_HEALTH_STATE} group by 1""")
def global_state(spark, sf_dir):
    return baselines.global_state(_health(spark, sf_dir), ["user_id"])


@query(f"""with h as (select user_id, case when depth < 2 and state = 'healthy' then 'idle' else state end as state from {_HEALTH_STATE})
select user_id, case max(case state when 'tripped' then 3 when 'degraded' then 2 when 'recovering' then 2 when 'idle' then 1 else 0 end) when 3 then 'fail' when 2 then 'warn' when 1 then 'unknown' else 'pass' end as status, count(*) as parts from h group by 1""")
def readiness_rollup(spark, sf_dir):
    idle = F.when((F.col("depth") < 2) & (F.col("state") == "healthy"), "idle").otherwise(F.col("state"))
    return baselines.readiness(baselines.status_of_state(_health(spark, sf_dir).withColumn("state", idle)), ["user_id"])


@query(f"""with w as (select *, greatest(coalesce(memory_delta, 0) - coalesce(lag(coalesce(memory_delta, 0)) over (partition by user_id, stage order by event_id), 0), 0) as delta from {EV})
select event_id, delta, case when delta >= 60 then 'tripped' when delta >= 30 then 'degraded' else 'healthy' end as asked from w""")
def counter_delta_escalation(spark, sf_dir):
    return ordered.counter_delta(events(spark, sf_dir), ["user_id", "stage"], "event_id", "memory_delta", 30, 60).select("event_id", "delta", "asked")


@query("""with w as (select o_orderkey, o_totalprice, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as previous from orders)
select o_orderkey, previous, round(o_totalprice - previous, 6) as delta, case when previous is null then 'baseline' when (o_totalprice - previous) / nullif(abs(previous), 0) > 0.25 then 'regressed' else 'pass' end as status from w""")
def run_vs_previous_gate(spark, sf_dir):
    return r6(ordered.versus_previous(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", 0.25).select("o_orderkey", "previous", "delta", "status"), "delta")


@query(f"select event_id, round(ts - first_value(ts) over (partition by user_id order by event_id), 3) as relative_s from {EV}")
def relative_time(spark, sf_dir):
    return ordered.relative_time(events(spark, sf_dir), ["user_id"], "event_id", "ts").select("event_id", F.round("relative_s", 3).alias("relative_s"))


@query(f"""with w as (select user_id, ts, coalesce(ts < lag(ts) over (partition by user_id order by event_id), false) as falls from {EV}) select user_id, count(ts) = count(*) as complete, not bool_or(falls) as monotonic, count(*) as n from w group by user_id""")
def monotonic_check(spark, sf_dir):
    return ordered.monotonic(events(spark, sf_dir), ["user_id"], "event_id", "ts")


@query(f"select event_id, count(*) over w as seen, round(count(*) over w / count(*) over (partition by user_id), 6) as progress from {EV} window w as (partition by user_id order by event_id rows unbounded preceding)")
def progress_counts(spark, sf_dir):
    return r6(ordered.throughput(events(spark, sf_dir), ["user_id"], "event_id", F.lit(1.0)).select("event_id", "seen", "progress"), "progress")


@query(f"""with f as (select user_id, event_id, last_value(case when memory_delta > 50 then duration_s end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as metric, row_number() over (partition by user_id order by event_id desc) as r from {EV}) select user_id, event_id, metric from f where r <= 120""")
def client_history(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("metric", F.when(F.col("memory_delta") > 50, F.col("duration_s")))
    return ordered.carry_forward(e, ["user_id"], "event_id", ["metric"]).select("user_id", "event_id", "metric")


@query(f"""with recursive o as (select user_id, duration_s as x, row_number() over (partition by user_id order by event_id) as i from {EV}),
f(user_id, i, y) as (select user_id, i, x from o where i = 1 union all select f.user_id, o.i, 0.3 * o.x + 0.7 * f.y from f join o on o.user_id = f.user_id and o.i = f.i + 1)
select user_id, round(arg_max(y, i), 6) as ema, max(i) as n from f group by user_id""")
def moving_average(spark, sf_dir):
    return r6(ordered.moving_average(events(spark, sf_dir), "user_id", "event_id", "duration_s", 0.3), "ema")


_PTS = "(select l_orderkey as seq, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as idx, l_quantity as x, l_extendedprice / 1000 as y from lineitem)"


def _points(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.row_number().over(w).cast("long").alias("idx"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


@query(f"select seq, idx, round(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 6) as step from {_PTS} window w as (partition by seq order by idx)")
def step_lengths(spark, sf_dir):
    return r6(trajectory.steps(_points(spark, sf_dir), ["seq"], "idx", ["x", "y"]).select("seq", "idx", "step"), "step")


@query(f"""with s as (select seq, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as step from {_PTS} window w as (partition by seq order by idx))
select seq, count(*) as num_poses, round(sum(step), 6) as path_length, round(avg(step), 6) as mean_step, round(max(step), 6) as max_step from s group by seq having count(*) > 1""")
def trajectory_summary(spark, sf_dir):
    return r6(trajectory.summary(_points(spark, sf_dir), ["seq"], "idx", ["x", "y"]), "path_length", "mean_step", "max_step")


@query(f"select seq, idx, round(lead(x, 2) over w - x, 6) as dx, round(lead(y, 2) over w - y, 6) as dy from {_PTS} window w as (partition by seq order by idx)")
def rpe_lead(spark, sf_dir):
    w = Window.partitionBy("seq").orderBy("idx")
    p = _points(spark, sf_dir)
    return r6(p.select("seq", "idx", (F.lead("x", 2).over(w) - F.col("x")).alias("dx"), (F.lead("y", 2).over(w) - F.col("y")).alias("dy")), "dx", "dy")


_PAIRS = f"(select user_id as seq, event_id as idx, duration_s as gx, memory_delta as gy, duration_s * 0.9 - memory_delta * 0.2 + (event_id % 7) as ex, duration_s * 0.2 + memory_delta * 0.9 + (event_id % 5) as ey from {EV})"
_ALIGN = f"""m as (select seq, avg(gx) mgx, avg(gy) mgy, avg(ex) mex, avg(ey) mey, avg(gx * ex) - avg(gx) * avg(ex) a, avg(gx * ey) - avg(gx) * avg(ey) b, avg(gy * ex) - avg(gy) * avg(ex) c, avg(gy * ey) - avg(gy) * avg(ey) d, avg(ex * ex + ey * ey) - avg(ex) * avg(ex) - avg(ey) * avg(ey) v from p group by seq),
t as (select *, atan2(c - b, a + d) th, case when v > 1e-12 then greatest(sqrt(pow(a + d, 2) + pow(c - b, 2)), sqrt(pow(a - d, 2) + pow(b + c, 2))) / v end s from m),
q as (select p.*, s * (cos(th) * ex - sin(th) * ey) + mgx - s * (cos(th) * mex - sin(th) * mey) ax, s * (sin(th) * ex + cos(th) * ey) + mgy - s * (sin(th) * mex + cos(th) * mey) ay from p join t using (seq)),
u as (select seq, sqrt(pow(gx - ax, 2) + pow(gy - ay, 2)) as ate, sqrt(pow(lead(gx, 5) over w - gx - (lead(ax, 5) over w - ax), 2) + pow(lead(gy, 5) over w - gy - (lead(ay, 5) over w - ay), 2)) as rpe from q window w as (partition by seq order by idx)),
z as (select seq, count(*) as num_pairs, sqrt(avg(ate * ate)) as ate_rmse, avg(ate) as ate_mean, median(ate) as ate_median, sqrt(avg(rpe * rpe)) as rpe_rmse, avg(rpe) as rpe_mean, median(rpe) as rpe_median from u group by seq)"""


def _pairs(spark, sf_dir) -> DataFrame:
    g, m, i = F.col("duration_s"), F.col("memory_delta"), F.col("event_id")
    return events(spark, sf_dir).select(F.col("user_id").alias("seq"), i.alias("idx"), g.alias("gx"), m.alias("gy"), (g * 0.9 - m * 0.2 + i % 7).alias("ex"), (g * 0.2 + m * 0.9 + i % 5).alias("ey"))


ERRORS = ("ate_rmse", "ate_mean", "ate_median", "rpe_rmse", "rpe_mean", "rpe_median")


@query(f"with p as {_PAIRS}, {_ALIGN} select seq::varchar as sequence, " + ", ".join(f"round({e}, 6) as {e.upper()}" for e in ERRORS) + " from z")
def evaluation_errors(spark, sf_dir):
    """The error metrics of an evaluation run, of trajectories of any dimension."""
    c = F.col
    p = _pairs(spark, sf_dir).select(c("seq").cast("string").alias("sequence"), "idx", F.array("gx", "gy").alias("g"), F.array("ex", "ey").alias("e"), F.lit(5).alias("delta"))
    return r6(trajectory.error_report(p), *trajectory.ERROR_NAMES)


@query(f"with p as {_PAIRS}, {_ALIGN} select seq, num_pairs, " + ", ".join(f"round({e}, 6) as {e}" for e in ERRORS) + " from z")
def ate_rpe_2d(spark, sf_dir):
    return r6(trajectory.error_stats(_pairs(spark, sf_dir), ["seq"], "idx", 5), *ERRORS)


@query(f"with p as {_PAIRS}, {_ALIGN}, l as (unpivot (select seq, {', '.join(ERRORS)} from z) on {', '.join(ERRORS)} into name metric value v) select metric, round(avg(v), 6) as value, count(*) as sequences from l where v is not null group by metric")
def macro_average(spark, sf_dir):
    e = trajectory.error_stats(_pairs(spark, sf_dir), ["seq"], "idx", 5)
    return r6(trajectory.macro_average(e.unpivot("seq", list(ERRORS), "metric", "value")), "value")


@query(f"""with p as {_PTS}, s as (select *, coalesce(sum(y / 50) over (partition by seq order by idx rows between unbounded preceding and 1 preceding), 0) as h from p)
select seq, idx, round(sum(cos(h) * x) over w, 6) as px, round(sum(sin(h) * x) over w, 6) as py, round(h + y / 50, 6) as yaw from s window w as (partition by seq order by idx rows unbounded preceding)""")
def pose_prefix(spark, sf_dir):
    p = _points(spark, sf_dir).select("seq", "idx", F.col("x").alias("dx"), F.lit(0.0).alias("dy"), (F.col("y") / 50).alias("dyaw"))
    return r6(trajectory.compose_2d(p, ["seq"], "idx").select("seq", "idx", F.col("x").alias("px"), F.col("y").alias("py"), "yaw"), "px", "py", "yaw")


_NEAR = f"""a as (select user_id, event_id as idx, ts from {EV} where stage = 'purchase'), b as (select user_id, event_id as other_idx, ts as other_ts from {EV} where stage = 'error'),
n as (select a.*, other_idx, other_ts - ts as off, row_number() over (partition by a.user_id, idx order by abs(other_ts - ts), other_ts desc, case when other_ts >= ts then other_idx else -other_idx end) as r from a join b on a.user_id = b.user_id and abs(other_ts - ts) <= 3600)"""


def _near(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", F.col("event_id").alias("idx"), "ts", "stage")
    return joins.nearest_in_time(e.where("stage = 'purchase'").drop("stage"), e.where("stage = 'error'").drop("stage"), ["user_id"], 3600.0)


@query(f"with {_NEAR} select user_id, idx, other_idx, round(off, 3) as offset_s from n where r = 1")
def sync_nearest(spark, sf_dir):
    return _near(spark, sf_dir).select("user_id", "idx", "other_idx", F.round("offset_s", 3).alias("offset_s"))


@query(f"with {_NEAR} select user_id, round(avg(off), 3) as offset_mean, round(coalesce(stddev_pop(off), 0), 3) as offset_std, round(max(abs(off)), 3) as offset_max, count(*) as n from n where r = 1 group by user_id")
def sync_offsets(spark, sf_dir):
    return joins.offset_stats(_near(spark, sf_dir), ["user_id"], "offset_s").select("user_id", *[F.round(c, 3).alias(c) for c in ("offset_mean", "offset_std", "offset_max")], "n")


@query(f"""with o as (select user_id, stage, ts, row_number() over (partition by user_id, stage order by event_id) - 1 as idx from {EV})
select a.user_id, a.idx, round(coalesce(b.ts - a.ts, 0), 3) as offset_s from o a join o b on a.user_id = b.user_id and a.idx = b.idx and a.stage = 'purchase' and b.stage = 'error'""")
def sync_by_index(spark, sf_dir):
    w = Window.partitionBy("user_id", "stage").orderBy("event_id")
    o = events(spark, sf_dir).select("user_id", "stage", "ts", (F.row_number().over(w) - 1).alias("idx"))
    out = joins.by_position(o.where("stage = 'purchase'"), o.where("stage = 'error'"), ["user_id"])
    return out.select("user_id", "idx", F.round("offset_s", 3).alias("offset_s"))


_DIGESTS = "(select lang, doc_id // 2 as name, doc_id % 2 as side, sha256(text) as digest from documents)"


@query(f"""with d as {_DIGESTS}, a as (select * from d where side = 0), b as (select * from d where side = 1)
select coalesce(a.lang, b.lang) as lang, coalesce(a.name, b.name) as name, case when a.digest is null then 'missing_left' when b.digest is null then 'missing_right' when a.digest = b.digest then 'match' else 'mismatch' end as status from a full outer join b on a.lang = b.lang and a.name = b.name""")
def artifact_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.floor(F.col("doc_id") / 2).alias("name"), (F.col("doc_id") % 2).alias("side"), F.sha2("text", 256).alias("digest"))
    return joins.artifact_diff(d.where("side = 0"), d.where("side = 1"), ["lang", "name"]).select("lang", "name", "status")


@query("select source, lang, sha256(string_agg(sha256(text), '' order by doc_id)) as digest, count(*) as n from documents group by 1, 2")
def ordered_stream_digest(spark, sf_dir):
    return canonical.ordered_digest(table(spark, sf_dir, "documents"), ["source", "lang"], ["doc_id"], "text")


@query("""with recursive n as (select 'nation' || n_nationkey as stage, 'region' || n_regionkey as needs from nation union all select 'supplier' || s_suppkey, 'nation' || s_nationkey from supplier),
s as (select 'region' || r_regionkey as stage, case when r_regionkey = 1 then 'tripped' when r_regionkey = 2 then 'recovering' else 'healthy' end as state from region union all select 'nation' || n_nationkey, 'healthy' from nation union all select 'supplier' || s_suppkey, case when s_suppkey % 7 = 0 then 'tripped' when s_suppkey % 5 = 0 then 'recovering' else 'healthy' end from supplier),
one as (select s.stage, case when u.state = 'tripped' and s.state <> 'tripped' or u.state in ('degraded', 'recovering') and s.state = 'healthy' then 'degraded' else s.state end as state from s left join n on n.stage = s.stage left join s u on u.stage = n.needs),
two as (select s.stage, case when u.state = 'tripped' and s.state <> 'tripped' or u.state in ('degraded', 'recovering') and s.state = 'healthy' then 'degraded' else s.state end as state from one s left join n on n.stage = s.stage left join one u on u.stage = n.needs)
select stage, state from two""")
def dependency_propagation(spark, sf_dir):
    c, t = F.col, lambda n: table(spark, sf_dir, n)
    name = lambda p, k: F.concat(F.lit(p), c(k))
    needs = t("nation").select(name("nation", "n_nationkey").alias("stage"), name("region", "n_regionkey").alias("needs")).union(t("supplier").select(name("supplier", "s_suppkey"), name("nation", "s_nationkey")))
    states = t("region").select(name("region", "r_regionkey").alias("stage"), F.when(c("r_regionkey") == 1, "tripped").when(c("r_regionkey") == 2, "recovering").otherwise("healthy").alias("state"))
    states = states.union(t("nation").select(name("nation", "n_nationkey"), F.lit("healthy"))).union(t("supplier").select(name("supplier", "s_suppkey"), F.when(c("s_suppkey") % 7 == 0, "tripped").when(c("s_suppkey") % 5 == 0, "recovering").otherwise("healthy")))
    return joins.propagate(states, needs, 2)


_COS = "with e as (select vec_id as id, embedding::double[] as v from embeddings), s as (select a.id as query_id, b.id as id, round(list_cosine_similarity(a.v, b.v), 9) as score from e a join e b on a.id <> b.id and a.id % 20 = 0)"


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query(f"{_COS} select query_id, id, round(score, 6) as score, r as rank from (select *, row_number() over (partition by query_id order by score desc, id) as r from s) where r <= 5")
def similarity_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return r6(similarity.cosine_top_k(v.select("id", "v"), v.where("id % 20 = 0").select("id", "v"), 5), "score").select("query_id", "id", "score", "rank")


@query(f"{_COS} select query_id, id, round(score, 6) as score from s where score > 0.35 qualify row_number() over (partition by query_id order by score desc, id) <= 20")
def similarity_detect(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return r6(similarity.cosine_top_k(v.select("id", "v"), v.where("id % 20 = 0").select("id", "v"), 20, least=0.35).select("query_id", "id", "score"), "score")


@query("""with e as (select vec_id as id, label, embedding::double[] as v from embeddings), s as (select a.id as a, b.id as b, round(list_cosine_similarity(a.v, b.v), 9) as score from e a join e b on a.label = b.label and a.id % 2 = 0 and b.id % 2 = 1),
r as (select *, row_number() over (partition by a order by score desc, b) i, row_number() over (partition by b order by score desc, a) j from s) select a, b, round(score, 6) as score from r where i = 1 and j = 1""")
def mutual_nn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    left, right = (v.where(F.col("id") % 2 == k).select("label", "id", "v") for k in (0, 1))
    return r6(similarity.mutual_cosine(left, right, "label"), "score")


_CENTRES = [[round(((7 * k + 3 * j) % 11 - 5) / 20, 2) for j in range(64)] for k in range(6)]
_CENTRES_SQL = ", ".join(f"({k}, {c}::double[])" for k, c in enumerate(_CENTRES))
_ASSIGN = f"with w(word, c) as (values {_CENTRES_SQL}), e as (select vec_id as id, label, embedding::double[] as v from embeddings), d as (select id, label, word, list_distance(v, c) as distance, row_number() over (partition by id order by list_distance(v, c), word) as r from e, w)"


def _assigned(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir).select("id", "label", F.col("v").cast("array<double>").alias("v"))
    return similarity.assign_centroids(v, _CENTRES)


@query(f"{_ASSIGN} select id, word, round(distance, 6) as distance from d where r = 1")
def centroid_assign(spark, sf_dir):
    return r6(_assigned(spark, sf_dir).select("id", "word", "distance"), "distance")


@query(f"{_ASSIGN} select label, word, count(*) as n, round(count(*) / sum(count(*)) over (partition by label), 6) as share from d where r = 1 group by label, word")
def bow_histogram(spark, sf_dir):
    return r6(similarity.word_histogram(_assigned(spark, sf_dir), ["label"]), "share")


@query("""select p_partkey, coalesce(nullif(trim(regexp_replace(p_name, '[^A-Za-z0-9_-]', '_', 'g'), '_'), ''), 'run') as artifact, coalesce(nullif(trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]', '_', 'g'), '_'), ''), 'unknown') as metric from part""")
def name_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.artifact_name(F.col("p_name")).alias("artifact"), scalars.metric_name(F.col("p_type")).alias("metric"))


@query("select c_custkey, (('0x' || substr(sha256(c_custkey || ':' || c_mktsegment), 1, 16))::ubigint % 2147483647)::bigint as seed from customer")
def seed_derivation(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.derived_seed(F.col("c_custkey"), F.col("c_mktsegment")).alias("seed"))


@query(f"""with w as (select event_id, duration_s / 3 as a, pow(duration_s / 10, 2) as z from {EV}), m as (select *, a + pi() - floor((a + pi()) / (2 * pi())) * 2 * pi() - pi() as wrapped from w)
select event_id, round(wrapped, 6) as wrapped, round(case when z <= 1 then z else 2 * sqrt(z) - 1 end, 6) as huber, round(ln(1 + z), 6) as cauchy, round(case when z <= 1 then (1 - pow(1 - z, 3)) / 6 else 1.0 / 6 end, 6) as tukey from m""")
def scalar_math(spark, sf_dir):
    z = F.pow(F.col("duration_s") / 10, F.lit(2.0))
    rows = events(spark, sf_dir).select("event_id", scalars.wrap_angle(F.col("duration_s") / 3).alias("wrapped"), *[scalars.robust_loss(k, z)[0].alias(k) for k in ("huber", "cauchy", "tukey")])
    return r6(rows, "wrapped", "huber", "cauchy", "tukey")


@query("""with k as (select 'o' || o_orderpriority as key, o_orderkey as value from orders where o_orderkey % 3 = 0), n as (select 'o' || o_orderpriority as key, -o_orderkey as value from orders where o_orderkey % 3 = 1 and o_orderpriority < '3')
select * from k where key not in (select key from n) union all select * from n""")
def baseline_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderpriority")).alias("key"), F.col("o_orderkey").alias("value"), "o_orderpriority")
    new = o.where((F.col("value") % 3 == 1) & (F.col("o_orderpriority") < "3")).select("key", (-F.col("value")).alias("value"))
    return ordered.replace_key(o.where(F.col("value") % 3 == 0).select("key", "value"), new)


@query("""select l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_extendedprice desc, l_linenumber) as r from lineitem) where r = 1""")
def argmax_composite(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return ordered.choose_best(rows, ["l_orderkey"], [F.desc("l_quantity"), F.desc("l_extendedprice"), F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""with e as (select s_suppkey % 5 as graph_id, s_suppkey as i, s_suppkey + 5 as j from supplier), v as (select s_suppkey % 5 as graph_id, s_suppkey as id, s_suppkey / 10.0 as x, s_acctbal / 1000 as y, s_nationkey / 4.0 as yaw from supplier),
r as (select e.graph_id, i, j, cos(a.yaw) * (b.x - a.x) + sin(a.yaw) * (b.y - a.y) - 1 as rx, -sin(a.yaw) * (b.x - a.x) + cos(a.yaw) * (b.y - a.y) as ry, b.yaw - a.yaw - 0.1 + pi() as t from e join v a on a.graph_id = e.graph_id and a.id = i join v b on b.graph_id = e.graph_id and b.id = j)
select graph_id, i, j, round(rx, 6) as rx, round(ry, 6) as ry, round(t - floor(t / (2 * pi())) * 2 * pi() - pi(), 6) as ryaw from r""")
def se2_residuals(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), F.col
    g = (c("s_suppkey") % 5).alias("graph_id")
    v = s.select(g, c("s_suppkey").alias("id"), (c("s_suppkey") / 10.0).alias("x"), (c("s_acctbal") / 1000).alias("y"), (c("s_nationkey") / 4.0).alias("yaw"))
    e = s.select(g, c("s_suppkey").alias("i"), (c("s_suppkey") + 5).alias("j"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.1).alias("dyaw"))
    return r6(graphs.se2_residuals(v, e), "rx", "ry", "ryaw")


@query()
def pose_graph_se2(spark, sf_dir):
    """A chain with noisy starts for each region's nations, closed by one loop edge."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("graph_id"), "n_nationkey")
    w = Window.partitionBy("graph_id").orderBy("n_nationkey")
    n = n.withColumn("id", (F.row_number().over(w) - 1).cast("long"))
    k = F.col("id")
    v = n.select("graph_id", "id", F.array(F.cos(k * 1.3) + 0.1 * k, F.sin(k * 1.3), k * 1.3 + 0.05 * (k % 2)).alias("state"))
    e = n.where("id > 0").select("graph_id", (k - 1).alias("i"), k.alias("j"), F.array(F.lit(1.0), F.lit(0.2), F.lit(1.2566)).alias("meas"), F.lit(1.0).alias("weight"))
    loop = n.groupBy("graph_id").agg(F.max("id").alias("i")).select("graph_id", "i", F.lit(0).cast("long").alias("j"), F.array(F.lit(1.0), F.lit(0.2), F.lit(1.2566)).alias("meas"), F.lit(1.0).alias("weight"))
    return graphs.optimise_graphs(v, e.union(loop), "se2")


def _markers_sql(q: float, m: str) -> str:
    """A recursive table m: five heights h, places n and goals g for each user, one row on at a time; the middle markers move one after the other."""
    def moved(i: int) -> str:
        h, n = (lambda k: f"h{i + k}"), (lambda k: f"n{i + k}")
        bent = f"{h(0)} + s / ({n(1)} - {n(-1)}) * (({n(0)} - {n(-1)} + s) * ({h(1)} - {h(0)}) / ({n(1)} - {n(0)}) + ({n(1)} - {n(0)} - s) * ({h(0)} - {h(-1)}) / ({n(0)} - {n(-1)}))"
        line = f"case when s > 0 then {h(0)} + ({h(1)} - {h(0)}) / ({n(1)} - {n(0)}) else {h(0)} - ({h(-1)} - {h(0)}) / ({n(-1)} - {n(0)}) end"
        sign = f"case when g{i} - n{i} >= 1 and {n(1)} - {n(0)} > 1 then 1.0::double when g{i} - n{i} <= -1 and {n(-1)} - {n(0)} < -1 then -1.0::double else 0.0::double end as s"
        return f"(select * replace (case when s = 0 then {h(0)} when {h(-1)} < bent and bent < {h(1)} then bent else {line} end as h{i}, n{i} + s as n{i}) from (select *, {bent} as bent from (select * exclude (s, bent), {sign} from {{}})))"

    cell = "case when x < h2 then 1 when x < h3 then 2 when x < h4 then 3 else 4 end"
    names = ["user_id", "k", *[f"{m}{i}" for m in "hng" for i in range(1, 6)]]
    taken = f"(select {m}.user_id, e.k, least(h1, x) as h1, h2, h3, h4, greatest(h5, x) as h5, " + ", ".join(f"n{i} + case when {i} > {cell} then 1 else 0 end as n{i}" for i in range(1, 6)) + ", " + ", ".join(f"g{i} + {r}::double as g{i}" for i, r in enumerate((0.0, q / 2, q, (1 + q) / 2, 1.0), 1)) + f", 0.0::double as s, 0.0::double as bent from {m} join e on e.user_id = {m}.user_id and e.k = {m}.k + 1)"
    for i in (2, 3, 4):
        taken = moved(i).format(taken)
    five = ", ".join(f"list_sort(list(x))[{i}] as h{i}" for i in range(1, 6))
    return f"""{m}({', '.join(names)}) as (select user_id, 5::bigint, {five}, {', '.join(f'{i}.0::double' for i in range(1, 6))}, {', '.join(f'{g}::double' for g in (1, 1 + 2 * q, 1 + 4 * q, 3 + 2 * q, 5))} from e where k <= 5 group by user_id having count(*) = 5
 union all select {', '.join(names)} from {taken})"""


@query(f"""with recursive e as (select user_id, duration_s::double as x, row_number() over (partition by user_id order by event_id) as k from {EV}),
{_markers_sql(0.5, 'mid')}, {_markers_sql(0.95, 'high')}, a as (select user_id, arg_max(h3, k) as p50 from mid group by user_id), b as (select user_id, arg_max(h3, k) as p95 from high group by user_id),
f as (select user_id, count(*) as n, quantile_cont(x, 0.5) as few50, quantile_cont(x, 0.95) as few95 from e group by user_id)
select user_id, n, round(coalesce(p50, few50), 6) as p50, round(coalesce(p95, few95), 6) as p95 from f left join a using (user_id) left join b using (user_id)""")
def p2_quantile(spark, sf_dir):
    return r6(machines.marker_quantiles(events(spark, sf_dir), "user_id", "event_id", "duration_s"), "p50", "p95")


@query(f"""with recursive e as (select user_id, event_id, ts, coalesce(memory_delta >= 20, false) as ok, row_number() over (partition by user_id order by event_id) as n from {EV}),
f(user_id, event_id, n, state, failed, good, opened) as (select distinct user_id, null::bigint, 0::bigint, 'closed', 0, 0, 0.0::double from e
 union all select user_id, event_id, n, case when ok and s = 'half_open' and g >= 2 then 'closed' when not ok and (s = 'half_open' or s = 'closed' and f >= 5) then 'open' else s end,
 case when ok and s = 'half_open' and g >= 2 then 0 else f end, g, case when not ok and (s = 'half_open' or s = 'closed' and f >= 5) then ts else opened end
 from (select *, case when not ok and s <> 'open' then failed + 1 else failed end as f, case when s = 'half_open' then case when state = 'open' then 0 else good end + ok::int else good end as g
  from (select e.user_id, e.event_id, e.n, e.ts, e.ok, f.state, f.failed, f.good, f.opened, case when f.state = 'open' and e.ts - f.opened >= 3600 then 'half_open' else f.state end as s from f join e on e.user_id = f.user_id and e.n = f.n + 1)))
select user_id, event_id, state from f where n > 0""")
def breaker_fsm(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ok", F.coalesce(F.col("memory_delta") >= 20, F.lit(False)))
    return machines.breaker_states(e, "user_id", "event_id", "ts", "ok", failures=5, cooldown=3600.0)


_ASKED = f"""a as (select user_id, floor(ts / 86400)::double as tick, stage, case when max(memory_delta) > 97 then 'tripped' when max(memory_delta) > 90 then 'degraded' else 'healthy' end as asked from {EV} group by 1, 2, 3),
p as (select a.*, u.asked as view_asked from a left join a u on u.user_id = a.user_id and u.tick = a.tick and u.stage = 'view'),
c as (select *, case when stage = 'click' and (view_asked = 'tripped' and asked <> 'tripped' or view_asked = 'degraded' and asked = 'healthy') then 'degraded' else asked end as d from p),
q as (select c.user_id, c.tick, c.stage, case when c.stage = 'purchase' and (u.d = 'tripped' and c.asked <> 'tripped' or u.d = 'degraded' and c.asked = 'healthy') then 'degraded' else c.d end as want, row_number() over (partition by c.user_id, c.stage order by c.tick) as n from c left join c u on u.user_id = c.user_id and u.tick = c.tick and u.stage = 'click')"""


@query(f"""with recursive {_ASKED},
f(user_id, stage, n, tick, old, state, since, good, reason) as (select user_id, stage, 0::bigint, tick, 'healthy', 'healthy', tick, 0, '' from q where n = 1
 union all select user_id, stage, n, tick, s, new, case when new <> s then tick else since end, case when new in ('tripped', 'degraded') then 0 else g end, why
 from (select *, case when s = 'recovering' and d = 'tripped' then 'tripped' when s = 'recovering' and d = 'healthy' then case when g >= 2 then 'healthy' else 'recovering' end when s = 'recovering' then 'recovering' when s = 'degraded' and d = 'healthy' then case when g >= 2 then 'healthy' else 'degraded' end else d end as new,
   case when s = 'recovering' and d = 'tripped' then 'retrip' when s = 'recovering' and d = 'healthy' then case when g >= 2 then 'recovered' else 'awaiting_stability' end when s = 'recovering' then 'hold_recovering' when s = 'degraded' and d = 'healthy' then case when g >= 2 then 'stabilized' else 'awaiting_stability' end when s = 'tripped' and d = 'recovering' then 'cooldown_elapsed' else 'snapshot' end as why
  from (select *, case when s = 'recovering' then case when d = 'healthy' then good + 1 else 0 end when s = 'degraded' and d = 'healthy' then good + 1 else good end as g
   from (select q.user_id, q.stage, q.n, q.tick, f.state as s, f.since, f.good, case when f.state = 'tripped' and q.want <> 'tripped' and q.tick - f.since >= 2 then 'recovering' else q.want end as d from f join q on q.user_id = f.user_id and q.stage = f.stage and q.n = f.n + 1))))
select user_id, tick, stage, old, state as new, reason from f where n > 0 and old <> state""")
def supervisor_fsm(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", (F.floor(F.col("ts") / 86_400)).cast("double").alias("tick"), "stage", "memory_delta")
    worst = F.max(F.col("memory_delta"))
    asked = e.groupBy("user_id", "tick", "stage").agg(F.when(worst > 97, "tripped").when(worst > 90, "degraded").otherwise("healthy").alias("asked"))
    return machines.supervise(asked, "user_id", {"click": ("view",), "purchase": ("click",)}, cooldown=2.0)


@query(f"""with recursive p as (select seq, idx, x, y, y / 50 as yaw, x / 50 as match_ratio from {_PTS}),
f(seq, idx, x, y, yaw, keyframe) as (select seq, idx, x, y, yaw, true from p where idx = 1
 union all select seq, idx, case when k then nx else x end, case when k then ny else y end, case when k then nyaw else yaw end, k
 from (select p.seq, p.idx, f.x, f.y, f.yaw, p.x as nx, p.y as ny, p.yaw as nyaw, sqrt(pow(p.x - f.x, 2) + pow(p.y - f.y, 2)) >= 10 or degrees(acos(greatest(-1, least(1, cos(p.yaw - f.yaw))))) >= 5 or p.match_ratio <= 0.25 as k from f join p on p.seq = f.seq and p.idx = f.idx + 1))
select seq, idx, keyframe from f""")
def keyframe_select(spark, sf_dir):
    c = F.col
    p = _points(spark, sf_dir).select("seq", "idx", trajectory.planar_pose(c("x"), c("y"), c("y") / 50).alias("pose"), (c("x") / 50).alias("match_ratio"))
    return trajectory.keyframes(p, "seq", "idx", far=10.0)


_DRAW = "(('0x' || substr(sha256('7:' || stage || ':' || step || ':{kind}'), 1, 16))::ubigint % 2147483647) / 2147483647.0"


@query(f"""with s as (select event_type as stage, event_id as step from events), f as (select *, case when {_DRAW.format(kind='timeout')} < 0.02 then 'timeout' when {_DRAW.format(kind='error')} < 0.05 then 'error' end as failure_type from s)
select * from f where failure_type is not null""")
def failure_plan(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("event_id").alias("step"))
    return machines.failure_plan(steps, {"timeout": 0.02, "error": 0.05}, 7)


_WIDE = ", ".join(f"{f} as {p}{n}" for p, v in (("", "duration_s"), ("m_", "memory_delta")) for n, f in (("count", f"count({v})::double"), ("total", f"sum({v})::double"), ("mean", f"avg({v})"), ("max", f"max({v})::double"), ("stdev", f"stddev_samp({v})"), ("p50", f"quantile_cont({v}, 0.5)"), ("p90", f"quantile_cont({v}, 0.9)"), ("p95", f"quantile_cont({v}, 0.95)"), ("p99", f"quantile_cont({v}, 0.99)")))
_OF_ALL = {"event_count": "count", "total_duration_s": "total", "mean_duration_s": "mean", "memory_event_count": "m_count", "total_memory_delta_bytes": "m_total", "mean_memory_delta_bytes": "m_mean"}
_OF_STAGE = {"count": "count", "memory_delta_count": "m_count"} | {f"{n}_duration_s": n for n in ("mean", "p50", "p90", "p95", "p99", "max", "stdev")} | {f"memory_delta_{n}_bytes": f"m_{n}" for n in ("mean", "p50", "p90", "p95", "p99", "max", "stdev")}


@query(f"with a as (select {_WIDE} from {EV}), s as (select stage, {_WIDE} from {EV} group by stage) " + " union all ".join([f"select 'telemetry_{n}' as metric, round(coalesce({c}, 0), 6) as value from a" for n, c in _OF_ALL.items()] + [f"select 'telemetry_stage_' || trim(regexp_replace(lower(trim(stage)), '[^a-z0-9]', '_', 'g'), '_') || '_{n}', round(coalesce({c}, 0), 6) from s" for n, c in _OF_STAGE.items()]))
def telemetry_metrics(spark, sf_dir):
    return r6(telemetry.summary_metrics(events(spark, sf_dir)), "value")


@query("""with d as (select l_returnflag as method, l_linestatus as status, case when l_tax > 0.06 then 'tax ' || l_linenumber end as failure, * from lineitem),
l as (select 'method' as dimension, method as category from d union all select 'status', status from d union all select 'failure', failure from d),
n as (select 'diag_' || dimension || '_' || regexp_replace(category, '[^A-Za-z0-9_-]', '_', 'g') as name, count(*)::double as count, count(*) / sum(count(*)) over (partition by dimension) as ratio from l where category is not null group by dimension, category)
select 'diag_frame_count' as metric, count(*)::double as value from d union all select 'diag_match_mean', round(avg(l_quantity), 6) from d union all select 'diag_inlier_mean', round(avg(l_extendedprice), 6) from d union all select 'diag_inlier_ratio_mean', round(avg(l_discount / 7), 6) from d
union all select 'diag_parallax_median', round(median(l_tax), 6) from d union all select 'diag_score_mean', round(avg(l_linenumber), 6) from d union all select name || '_count', count from n union all select name || '_ratio', round(ratio, 6) from n""")
def diagnostics_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("failure", F.when(F.col("l_tax") > 0.06, F.concat(F.lit("tax "), F.col("l_linenumber")))).withColumn("inlier_ratio", F.col("l_discount") / 7)
    return r6(telemetry.diagnostics_metrics(d, "l_quantity", "l_extendedprice", "inlier_ratio", "l_tax", "l_linenumber", {"method": "l_returnflag", "status": "l_linestatus", "failure": "failure"}), "value")
