"""Evaluation runs from JSON configs: trajectories against ground truth, telemetry, diagnostics, baselines, reports; and gates over many runs.

Rows of all sequences are read, aligned and summed up by Spark; what comes to the driver is bounded by the config, a few metrics
for each sequence it names, and is written as small control files."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from threading import Lock
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalars import BOUNDS, threshold_rows
from strandline.operators import baselines, telemetry, trajectory
from strandline.plans.measured import Budget, overall, run_measured, statistics
from strandline.sources import readers, sinks

#: A store of baselines is read and replaced as a whole, by one run of this driver at a time.
_STORES = Lock()
SECTIONS = ("run", "evaluation", "pipeline", "baseline")
#: The numbers of a relocalization report, by their metric's name.
RELOCALIZATION = ("attempts", "successes", "success_rate", "latency_mean_s", "latency_p50_s", "latency_p95_s", "match_count_mean", "match_count_p50", "match_count_p95", "inlier_ratio_mean", "inlier_ratio_p50", "inlier_ratio_p95", "recovery_success", "recovery_frame_gap")


@dataclass(frozen=True)
class Sequence:
    name: str
    gt_path: str
    est_path: str
    format: str = "xy"
    cols: str | None = None
    est_cols: str | None = None
    est_format: str | None = None
    est_run_dir: str | None = None
    rpe_delta: int = 1


@dataclass(frozen=True)
class Goal:
    """What a group of metrics is held against: a key of the store, thresholds, and whether the run becomes the baseline."""

    key: str | None = None
    thresholds: Mapping[str, Any] = field(default_factory=dict)
    write: bool = False


@dataclass(frozen=True)
class Evaluation:
    run_id: str
    dataset: str
    output_dir: str
    seed: int
    sequences: tuple[Sequence, ...]
    config_path: str
    config_hash: str
    pipeline: Mapping[str, Any] | None = None
    telemetry_name: str = "slam_telemetry"
    relocalization_report: str = "relocalization_demo_report.json"
    store: str | None = None
    goals: Mapping[str, Goal] = field(default_factory=dict)

    def resolved(self) -> dict[str, Any]:
        """The config as it was understood, with every path made whole."""
        out = {"run_id": self.run_id, "dataset": self.dataset, "output_dir": self.output_dir, "seed": self.seed, "config_hash": self.config_hash, "telemetry_name": self.telemetry_name}
        out["trajectories"] = [vars(s) for s in self.sequences]
        return out | ({"pipeline": dict(self.pipeline)} if self.pipeline else {}) | ({"baseline": {"store_path": self.store} | {n: vars(g) for n, g in self.goals.items()}} if self.store else {})


def at(path: str, base: str) -> str:
    """A path, or one relative to a folder."""
    return path if path.startswith("/") or "://" in path else posixpath.join(base, path)


def run_layout(run_dir: str, kind: str, name: str) -> str:
    """Where a run keeps an artifact; names of trajectories and diagnostics are made safe, as ``artifact_name`` does."""
    if kind != "telemetry":
        name = re.sub(r"[^\w-]", "_", name).strip("_") or "run"
    return posixpath.join(run_dir, {"trajectory": "trajectories", "telemetry": "telemetry", "diagnostics": "diagnostics"}[kind], f"{name}.{'npz' if kind == 'trajectory' else 'json'}")


def _sequence(raw: Mapping[str, Any], base: str) -> Sequence:
    if raw.get("est_run_dir") and raw.get("est_path"):
        raise ValueError("a sequence has est_path or est_run_dir, not both")
    run_dir, form = at(raw["est_run_dir"], base) if raw.get("est_run_dir") else None, raw.get("est_format")
    if run_dir:
        est, form = run_layout(run_dir, "trajectory", str(raw.get("est_trajectory") or raw["name"])), form or "slam_npz"
    else:
        est = at(raw["est_path"], base)
    return Sequence(str(raw["name"]), at(raw["gt_path"], base), est, raw.get("format", "xy"), raw.get("cols"), raw.get("est_cols"), form, run_dir, int(raw.get("rpe_delta", 1)))


def _odometry_sequences(raw: Mapping[str, Any], base: str) -> list[Sequence]:
    if not raw.get("sequences"):
        raise ValueError("a config of this dataset names its sequences")
    root = at(raw["kitti_root"], base)
    gt, est = at(raw.get("gt_root", posixpath.join(root, "poses")), base), at(raw["est_root"], base)
    name = lambda pattern, s, folder: at(raw.get(pattern, "{sequence}.txt").format(sequence=s), folder)
    return [Sequence(s, name("gt_pattern", s, gt), name("estimate_pattern", s, est), raw.get("format", "kitti_odom"), rpe_delta=int(raw.get("rpe_delta", 1))) for s in map(str, raw["sequences"])]


def load_evaluation(spark: SparkSession, path: str) -> Evaluation:
    """The config of a run: flat, or in sections run, evaluation, pipeline, baseline.  Paths are relative to its folder."""
    text = readers.whole_text(spark, path)
    raw, base = json.loads(text), posixpath.dirname(path)
    if any(s in raw for s in SECTIONS if s != "baseline") or set(raw) == {"baseline"}:
        run, inner = raw.get("run", {}), raw.get("evaluation", {})
        flat = {k: raw[k] for k in ("dataset", "output_dir", "seed", "run_id", "use_run_subdir", "telemetry_name") if k in raw}
        raw = inner | flat | run | {"pipeline": raw.get("pipeline"), "baseline": raw.get("baseline")}
    run_id = str(raw.get("run_id") or posixpath.splitext(posixpath.basename(path))[0])
    dataset = str(raw.get("dataset", "custom"))
    if raw.get("trajectories"):
        sequences = [_sequence(x, base) for x in raw["trajectories"]]
    elif raw.get("trajectories") is None and dataset.lower() == "kitti":
        sequences = _odometry_sequences(raw, base)
    else:
        raise ValueError("a config needs trajectories, or a dataset with sequences")
    output = at(raw.get("output_dir", "reports"), base)
    held = raw.get("baseline") or {}
    goals = {"metrics": Goal(held.get("key"), held.get("thresholds") or {}, bool(held.get("write")))}
    for kind in ("telemetry", "relocalization"):
        mine = held.get(kind) or {}
        key = mine.get("key") or (f"{held['key']}_{kind}" if mine.get("thresholds") and held.get("key") else None)
        goals[kind] = Goal(key, mine.get("thresholds") or {}, bool(mine.get("write")))
    report = (held.get("relocalization") or {}).get("report_name", "relocalization_demo_report.json")
    return Evaluation(run_id, dataset, posixpath.join(output, run_id) if raw.get("use_run_subdir") else output, int(raw.get("seed", 0)), tuple(sequences), path, hashlib.sha256(text.encode()).hexdigest(), raw.get("pipeline"), str(raw.get("telemetry_name", "slam_telemetry")), report, at(held["store_path"], base) if held.get("store_path") else None, goals)


def _positions(spark: SparkSession, s: Sequence) -> DataFrame:
    """name, idx, g, e, delta of a sequence: estimates and truth by place, as far as both go."""
    cols = readers.columns_of(s.format, s.cols)
    gt = readers.text_trajectory(spark, s.gt_path, cols).select("idx", F.col("coords").alias("g"))
    mine = [int(x) for x in s.est_cols.split(",")] if s.est_cols else None
    if s.est_format == "slam_npz":
        axes = mine or list(range(len(cols)))
        est = readers.npz_trajectories(spark, s.est_path).select("idx", F.array(*[F.col("pose")[4 * a + 3] for a in axes]).alias("e"))
    else:
        axes = mine or cols
        est = readers.text_trajectory(spark, s.est_path, axes).select("idx", F.col("coords").alias("e"))
    if len(axes) != len(cols):
        raise ValueError(f"{s.name}: truth has {len(cols)} dimensions, the estimate {len(axes)}")
    return gt.join(est, "idx").select(F.lit(s.name).alias("sequence"), "idx", "g", "e", F.lit(s.rpe_delta).alias("delta"))


def _of_runs(spark: SparkSession, config: Evaluation, path_of: Callable[[Sequence], str], read: Callable[[SparkSession, str], DataFrame]) -> DataFrame | None:
    """What the sequences' run folders hold, by sequence; absent files are left out."""
    there = [(s, path_of(s)) for s in config.sequences if s.est_run_dir and readers.exists(spark, path_of(s))]
    parts = [read(spark, p).withColumn("sequence", F.lit(s.name)) for s, p in there]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _relocalization(spark: SparkSession, path: str) -> DataFrame:
    """Long (metric, value) rows of a report's summary; absent numbers are 0, a report without summary is an error."""
    found = spark.read.schema("relocalization_summary map<string,string>").json(path, multiLine=True)
    held = F.when(F.col("relocalization_summary").isNull(), F.raise_error(F.lit("no relocalization_summary"))).otherwise(F.col("relocalization_summary"))
    truth = lambda v: F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))
    rows = found.select(F.explode(F.array(*[F.struct(F.lit(f"relocalization_{n}").alias("metric"), F.coalesce(truth(held[n]), F.lit(0.0)).alias("value")) for n in RELOCALIZATION])).alias("x"))
    return rows.select("x.*")


def evaluate(spark: SparkSession, config: Evaluation) -> dict[str, DataFrame]:
    """Long (sequence, metric, value) rows of metrics, telemetry and relocalization; sequence null: over all sequences."""
    pairs = reduce(DataFrame.unionByName, [_positions(spark, s) for s in config.sequences])
    long = trajectory.error_report(pairs).unpivot("sequence", list(trajectory.ERROR_NAMES), "metric", "value")
    frames = _of_runs(spark, config, lambda s: run_layout(s.est_run_dir, "diagnostics", "frame_diagnostics"), readers.frame_diagnostics)
    if frames is not None:
        for name in sorted({s.name for s in config.sequences if s.est_run_dir}):
            mine = telemetry.diagnostics_metrics(frames.where(F.col("sequence") == name), "match_count", "inliers", "inlier_ratio", "median_parallax", "score", {"method": "method", "status": "status", "failure": "failure_reason"})
            long = long.unionByName(mine.where("value is not null").select(F.lit(name).alias("sequence"), "metric", "value"))
    out = {"metrics": long.unionByName(telemetry.macro_means(long))}
    events = _of_runs(spark, config, lambda s: run_layout(s.est_run_dir, "telemetry", config.telemetry_name), readers.telemetry_events)
    if events is not None:
        out["telemetry"] = telemetry.summary_metrics(telemetry.normalise_events(events)).select(F.lit(None).cast("string").alias("sequence"), "metric", "value")
    reports = _of_runs(spark, config, lambda s: at(config.relocalization_report, s.est_run_dir), _relocalization)
    if reports is not None:
        rows = reports.select("sequence", "metric", "value")
        out["relocalization"] = rows.unionByName(telemetry.macro_means(rows))
    return out


def held_against(spark: SparkSession, config: Evaluation, found: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Comparisons of each kind of metrics with its baseline, where the store has it."""
    if not config.store:
        return {}
    store, out = readers.baselines(spark, config.store), {}
    for kind, goal in config.goals.items():
        if goal.key is None or kind not in found or store.where(F.col("key") == goal.key).isEmpty():
            continue
        limits = spark.createDataFrame(threshold_rows(goal.thresholds), "metric string, " + ", ".join(f"{b} double" for b in BOUNDS))
        current = found[kind].where("sequence is null").select(F.lit(goal.key).alias("key"), "metric", "value")
        out[kind] = baselines.compare(current, store.where(F.col("key") == goal.key), limits)
    return out


def run_evaluation(spark: SparkSession, config: Evaluation) -> dict[str, Any]:
    """Evaluates, compares, writes all reports below the output folder and new baselines, and returns the summary."""
    now = datetime.now(timezone.utc).isoformat()
    put = lambda name, payload: sinks.write_text(spark, f"{config.output_dir}/{name}", payload if isinstance(payload, str) else json.dumps(payload, indent=2, sort_keys=True))
    put("resolved_config.json", config.resolved())
    put("run_metadata.json", {"run_id": config.run_id, "created_at": now, "config_path": config.config_path, "config_hash": config.config_hash, "seed": config.seed})
    found = evaluate(spark, config)
    held = {kind: {(r["sequence"], r["metric"]): r["value"] for r in df.collect()} for kind, df in found.items()}
    means = {kind: {m: v for (s, m), v in sorted(rows.items(), key=lambda x: x[0][1]) if s is None} for kind, rows in held.items()}
    summary: dict[str, Any] = {"run_id": config.run_id, "dataset": config.dataset, "seed": config.seed, "timestamp": now, "config_path": config.config_path, "config_hash": config.config_hash, "run_dir": config.output_dir}
    summary |= {"aggregate_metrics": means["metrics"], "telemetry_metrics": means.get("telemetry", {}), "relocalization_metrics": means.get("relocalization", {}), "per_sequence": {}}
    lines = ["sequence,metric,value"]
    for s in config.sequences:
        metrics = {m: v for (name, m), v in sorted(held["metrics"].items(), key=lambda x: x[0][1]) if name == s.name}
        if not metrics:
            raise ValueError(f"{s.name}: a trajectory is empty")
        summary["per_sequence"][s.name] = payload = {"metrics": metrics, "metadata": {k: v for k, v in vars(s).items() if v is not None}}
        put(f"{s.name}_metrics.txt", "".join(f"{m} {v:.4f}\n" for m, v in metrics.items()))
        put(f"{s.name}_metrics.json", payload)
        put(f"{s.name}_metrics.csv", "metric,value\n" + "".join(f"{m},{v}\n" for m, v in metrics.items()))
        lines += [f"{s.name},{m},{v}" for m, v in metrics.items()]
    compared = held_against(spark, config, found)
    for kind, df in compared.items():
        rows = {r["metric"]: {k: v for k, v in r.asDict().items() if k not in ("key", "metric")} for r in df.collect()}
        name = "baseline_comparison" if kind == "metrics" else f"{kind}_baseline_comparison"
        summary[name] = {"key": config.goals[kind].key, "status": "pass" if all(r["status"] == "pass" for r in rows.values()) else "regressed", "per_metric": rows}
        put(f"{name}.json", summary[name])
    for kind, goal in config.goals.items():
        if config.store and goal.key and goal.write and kind in means:
            with _STORES:
                sinks.put_baseline(spark, config.store, goal.key, means[kind], config.config_hash, now, {"dataset": config.dataset, "run_id": config.run_id} | ({kind: True} if kind != "metrics" else {}))
    put("summary.json", summary)
    put("summary.csv", "\n".join(lines + [f"aggregate,{m},{v}" for m, v in means["metrics"].items()]) + "\n")
    return summary


def _benchmark(spark: SparkSession, run: Mapping[str, Any], base: str, weights: Mapping[str, Mapping[str, float]], default: float) -> dict[str, Any]:
    """Name, status, severity and metrics of one run of a benchmark config."""
    table = lambda kind: spark.createDataFrame(list(weights[kind].items()), "metric string, weight double")
    config = load_evaluation(spark, at(run["config_path"], base))
    summary, name = run_evaluation(spark, config), run.get("name", config.run_id)
    compared = {kind: summary.get("baseline_comparison" if kind == "metrics" else f"{kind}_baseline_comparison") for kind in ("metrics", "telemetry")}
    absent = any(config.goals[kind].key and compared[kind] is None for kind in compared)
    status = "missing_baseline" if run.get("require_baseline", True) and absent else "regressed" if any(c and c["status"] == "regressed" for c in compared.values()) else "pass"
    rows = {kind: [(name, m, *(r[k] for k in ("status", "delta", "ratio", *BOUNDS))) for m, r in (c or {"per_metric": {}})["per_metric"].items()] for kind, c in compared.items()}
    frames = {kind: spark.createDataFrame(x, "key string, metric string, status string, delta double, ratio double, " + ", ".join(f"{b} double" for b in BOUNDS)) for kind, x in rows.items()}
    score = baselines.severity_scores(frames["metrics"], table("metric"), default, frames["telemetry"], table("telemetry")).first()
    return {"name": name, "status": status, "score": score["score"] if score else 0.0, "config_hash": config.config_hash, "run_dir": config.output_dir, "aggregate_metrics": summary["aggregate_metrics"], "telemetry_metrics": summary["telemetry_metrics"]}


def run_benchmarks(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """Name, status, severity and seconds of each run of a benchmark config, ``max_workers`` at once; a run may have a
    ``runtime_budget_s``.  With fail_fast the first that doesn't pass stops the others, which are left out then.  A run that
    fails has the status error and says why."""
    raw, base = json.loads(readers.whole_text(spark, path)), posixpath.dirname(path)
    if not raw.get("runs"):
        raise ValueError("a benchmark config names its runs")
    named = raw.get("severity") or {}
    default = float(named.get("default_weight", 1.0))
    weights = {kind: {str(k): float(v) for k, v in named.get(f"{kind}_weights", {}).items()} for kind in ("metric", "telemetry")}
    if min([default, *weights["metric"].values(), *weights["telemetry"].values()]) < 0:
        raise ValueError("weights must not be negative")
    runs = {str(i): run for i, run in enumerate(raw["runs"])}
    limits = {i: Budget(float(run["runtime_budget_s"])) for i, run in runs.items() if run.get("runtime_budget_s") is not None}
    fail_fast, began = bool(raw.get("fail_fast", True)), datetime.now(timezone.utc).isoformat()
    found = run_measured(spark, {i: lambda s, run=run: _benchmark(s, run, base, weights, default) for i, run in runs.items()}, limits, int(raw.get("max_workers", 1)), fail_fast, judge=lambda value: value["status"])
    found = [r for r in found if r["status"] != "cancelled"]
    out = []
    for r in found:
        run = runs[r["name"]]
        known = r["value"] or {"name": run.get("name", run["config_path"]), "score": 0.0}
        out.append(known | {"status": r["status"], "runtime_s": r["runtime_s"]} | ({"error": r["error"]} if r["error"] else {}))
    summary = {"status": overall(found), "started_at": began, "finished_at": datetime.now(timezone.utc).isoformat(), "fail_fast": fail_fast, "benchmark_metrics": statistics(found), "runs": out}
    sinks.write_text(spark, at(raw.get("output_path", "reports/ci_benchmark_summary.json"), base), json.dumps(summary, indent=2))
    return out


def govern(spark: SparkSession, runs: Mapping[str, Callable[[SparkSession], Any]], limits: Mapping[str, Budget], store: str, thresholds: Mapping[str, Any] | None = None, require_baseline: bool = True, write: bool = False, at_once: int = 1, fail_fast: bool = True) -> list[dict[str, Any]]:
    """Runs measured (seconds and rows), held to budgets and against the store's baselines of the same names: error, budget_exceeded,
    missing_baseline, regressed or pass.  ``write`` puts what was measured of runs without errors into the store afterwards."""
    results = run_measured(spark, runs, limits, at_once, fail_fast)
    metrics = {r["name"]: {"runtime_s": r["runtime_s"]} | ({"rows": float(r["rows"])} if r["rows"] is not None else {}) for r in results if r["status"] in ("pass", "budget_exceeded")}
    known = readers.baselines(spark, store)
    current = spark.createDataFrame([(n, m, v) for n, values in metrics.items() for m, v in values.items()], "key string, metric string, value double")
    bounds = spark.createDataFrame(threshold_rows(dict(thresholds or {})), "metric string, " + ", ".join(f"{b} double" for b in BOUNDS))
    held = {r["key"] for r in known.where(F.col("key").isin(list(runs))).select("key").distinct().collect()}
    compared = baselines.compare(current, known.where(F.col("key").isin(list(metrics))), bounds)
    worse = {r["key"] for r in compared.where("status <> 'pass'").select("key").distinct().collect()}
    for r in results:
        if r["status"] == "pass":
            r["status"] = "missing_baseline" if require_baseline and r["name"] not in held else "regressed" if r["name"] in worse & held else "pass"
        r["metrics"] = metrics.get(r["name"])
    if write:
        now = datetime.now(timezone.utc).isoformat()
        for name, values in metrics.items():
            sinks.put_baseline(spark, store, name, values, hashlib.sha256(name.encode()).hexdigest(), now)
    return results
