"""A run's folder: its metadata, listings, telemetry recorded by the driver, and the bundle of its results."""

from __future__ import annotations

import json
import time
import tracemalloc
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import telemetry, trajectory
from strandline.sources.layout import listed
from strandline.sources.sinks import write_text

#: What a run's artifacts are listed by.
LISTINGS = {"trajectories": "trajectories/*.npz", "metrics": "metrics/*.json", "maps": "maps/*"}


def now() -> str:
    return datetime.now(UTC).isoformat()


def create_run(spark: SparkSession, base: str, run_id: str, config_path: str, config_hash: str, seed: int, use_subdir: bool = True, resolved: Mapping[str, Any] | None = None, created_at: str | None = None) -> str:
    """The folder of a new run, under a name of its own if asked, with run_metadata.json and, if given, resolved_config.json."""
    created_at = created_at or now()
    stamp = created_at.translate(str.maketrans({":": "", "-": "", "+": "Z"}))
    folder = f"{base}/{run_id}_{stamp}" if use_subdir else base
    facts = {"run_id": run_id, "created_at": created_at, "config_path": config_path, "config_hash": config_hash, "seed": int(seed), "run_dir": folder}
    write_text(spark, f"{folder}/run_metadata.json", json.dumps(facts, indent=2))
    if resolved is not None:
        write_text(spark, f"{folder}/resolved_config.json", json.dumps(resolved, indent=2))
    return folder


def stored(spark: SparkSession, folder: str, kind: str) -> list[str]:
    """Names of a run's trajectories, metrics or maps, sorted."""
    names = [p.rpartition("/")[2] for p in listed(spark, f"{folder}/{LISTINGS[kind]}")]
    return sorted(n if kind == "maps" else n.rpartition(".")[0] for n in names)


@dataclass
class Recorder:
    """Telemetry events of a driver program.  ``flush`` replaces the file with all events so far; ``correlate`` (stage to id)
    fills in the ids that events lack.  Events of executors belong in a table, not here."""

    spark: SparkSession
    path: str
    determinism: Mapping[str, Any] = field(default_factory=dict)
    correlate: Callable[[str], str] | None = None
    events: list[dict[str, Any]] = field(default_factory=list)

    def __call__(self, event: dict[str, Any]) -> None:
        if self.correlate is not None:
            meta = {"stage": event["name"], **event["metadata"]}
            event = event | {"metadata": {"correlation_id": self.correlate(str(meta["stage"])), **meta}}
        self.events.append(event)

    def flush(self) -> None:
        write_text(self.spark, self.path, json.dumps({"recorded_at": now(), "determinism": dict(self.determinism), "events": self.events}, indent=2))


class Timed:
    """``with Timed(name, sink)``: hands the sink one event with duration, success, the error's class and, if asked, memory.

    A sink is any function of an event, a ``Recorder`` among them."""

    def __init__(self, name: str, sink: Callable[[dict[str, Any]], None], metadata: Mapping[str, Any] | None = None, memory: bool = False):
        self.name, self.sink, self.metadata, self.memory = name, sink, dict(metadata or {}), memory

    def __enter__(self) -> Timed:
        if self.memory and not tracemalloc.is_tracing():
            tracemalloc.start()
        self.before = tracemalloc.get_traced_memory()[0] if self.memory else 0
        self.start = time.perf_counter()
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: object) -> None:
        took = time.perf_counter() - self.start
        facts = self.metadata | {"success": kind is None} | ({"error": kind.__name__} if kind else {})
        if self.memory:
            current, peak = tracemalloc.get_traced_memory()
            facts |= {"memory_delta_bytes": current - self.before, "memory_current_bytes": current, "memory_peak_bytes": peak}
        self.sink({"name": self.name, "duration_s": took, "timestamp": now(), "metadata": facts})


def write_bundle(spark: SparkSession, folder: str, poses: DataFrame, diagnostics: DataFrame, determinism: Mapping[str, Any], recorder: Recorder | None = None) -> dict[str, str]:
    """Writes a run's results and returns their paths: poses(idx, x, y, z, ...) and frame diagnostics as tables, the
    trajectory's metrics, the events recorded and the digest of their durations.  A run without poses or frames is an error."""
    if poses.isEmpty() or diagnostics.isEmpty():
        raise ValueError("nothing to write")
    paths = {"trajectory": f"{folder}/trajectories/poses", "metrics": f"{folder}/metrics/run_metrics.json", "diagnostics": f"{folder}/diagnostics/frames"}
    poses.write.mode("overwrite").parquet(paths["trajectory"])
    diagnostics.write.mode("overwrite").json(paths["diagnostics"])
    whole = trajectory.summary(spark.read.parquet(paths["trajectory"]).withColumn("_run", F.lit(0)), ["_run"], "idx", ["x", "y", "z"]).drop("_run").first()
    found = {k: float(v) for k, v in whole.asDict().items()} if whole else {"num_poses": 1.0}
    write_text(spark, paths["metrics"], json.dumps({"name": "run_metrics", "recorded_at": now(), "metrics": found, "determinism": dict(determinism)}, indent=2))
    if recorder is not None and recorder.events:
        recorder.flush()
        seen = spark.createDataFrame([(e["name"], float(e["duration_s"])) for e in recorder.events], "stage string, duration_s double")
        rows = [r.asDict() for r in telemetry.digest(seen).collect()]  # one a stage
        paths |= {"telemetry": recorder.path, "telemetry_summary": f"{folder}/telemetry/summary.json"}
        write_text(spark, paths["telemetry_summary"], json.dumps({"stages": rows}, indent=2, sort_keys=True))
    return paths
