"""Evaluation runs and benchmark gates from config files."""

import json

import numpy as np
import pytest

from strandline.plans import evaluation
from strandline.sources import readers, sinks


def write(path, rows):
    path.write_text("\n".join(" ".join(map(str, r)) for r in rows) + "\n")
    return str(path)


def config(folder, name, **more):
    (folder / name).write_text(json.dumps(more))
    return str(folder / name)


@pytest.fixture
def run_dir(tmp_path):
    run = tmp_path / "run"
    for d in ("trajectories", "telemetry", "diagnostics"):
        (run / d).mkdir(parents=True)
    poses = np.repeat(np.eye(4)[None], 4, axis=0)
    poses[:, 0, 3], poses[:, 1, 3] = [0, 1, 2, 3], [0, 0.1, 1, 0]
    np.savez(run / "trajectories" / "my_walk.npz", poses=poses, timestamps=np.arange(4.0), frame_ids=np.arange(4))
    (run / "telemetry" / "slam_telemetry.json").write_text(json.dumps({"events": [{"name": "Track it", "duration_s": 0.5, "timestamp": "t", "metadata": {"memory_delta_bytes": "10"}}, {"name": "Track it", "duration_s": 1.5, "timestamp": "t", "metadata": {}}]}))
    (run / "diagnostics" / "frame_diagnostics.json").write_text(json.dumps({"entries": [{"frame_id": i, "match_count": 10 * i, "inliers": i, "method": "essential", "status": "ok" if i else "failure", "failure_reason": None if i else "few matches"} for i in range(4)]}))
    (run / "relocalization_demo_report.json").write_text(json.dumps({"relocalization_summary": {"attempts": 4, "success_rate": 0.5, "recovery_success": True}}))
    return run


def test_text_run_and_reports(spark, tmp_path):
    gt, est = write(tmp_path / "gt.txt", [(0, 0), (1, 0), (2, 0.5), (9, 9)]), write(tmp_path / "est.txt", [(0, 0), (1.1, 0), (2.1, 0.4)])
    path = config(tmp_path, "exp.json", run={"run_id": "r1", "seed": 4, "output_dir": "out", "use_run_subdir": True}, pipeline={"kind": "x"}, evaluation={"trajectories": [{"name": "s", "gt_path": gt, "est_path": "est.txt", "cols": "0,1"}]})
    c = evaluation.load_evaluation(spark, path)
    assert c.sequences[0].est_path == est and c.seed == 4 and c.output_dir.endswith("out/r1")
    summary = evaluation.run_evaluation(spark, c)
    g, e = np.array([[0, 0], [1, 0], [2, 0.5]]), np.array([[0, 0], [1.1, 0], [2.1, 0.4]])
    a, b = g[:, 0] + 1j * g[:, 1], e[:, 0] + 1j * e[:, 1]
    a, b = a - a.mean(), b - b.mean()
    s = (np.conj(b) * a).sum() / (np.abs(b) ** 2).sum()
    assert summary["aggregate_metrics"]["ATE_RMSE"] == pytest.approx(np.sqrt((np.abs(a - s * b) ** 2).mean()))
    for name in ("summary.json", "summary.csv", "s_metrics.txt", "s_metrics.json", "s_metrics.csv", "resolved_config.json", "run_metadata.json"):
        assert (tmp_path / "out" / "r1" / name).exists()
    resolved = json.loads((tmp_path / "out" / "r1" / "resolved_config.json").read_text())
    assert resolved["pipeline"] == {"kind": "x"} and resolved["config_hash"] == c.config_hash
    assert (tmp_path / "out" / "r1" / "summary.csv").read_text().startswith("sequence,metric,value\ns,ATE_MEAN,")


def test_run_folder_baselines_and_gate(spark, tmp_path, run_dir):
    gt = write(tmp_path / "gt.txt", [(0, 0), (1, 0), (2, 1), (3, 0)])
    seq = [{"name": "walk", "gt_path": gt, "est_run_dir": "run", "est_trajectory": "my walk", "cols": "0,1"}]
    held = {"store_path": "store.json", "key": "k", "thresholds": {"ATE_RMSE": {"direction": "lower", "tolerance": 0.01}}, "telemetry": {"thresholds": {"telemetry_mean_duration_s": 0.1}}, "relocalization": {"thresholds": {"relocalization_success_rate": {"min_delta": -0.1}}}}
    path = config(tmp_path, "c.json", run_id="c", output_dir="o", trajectories=seq, baseline=held | {"write": True, "telemetry": held["telemetry"] | {"write": True}})
    summary = evaluation.run_evaluation(spark, evaluation.load_evaluation(spark, path))
    assert summary["telemetry_metrics"]["telemetry_stage_track_it_mean_duration_s"] == 1.0 and summary["relocalization_metrics"]["relocalization_recovery_success"] == 1.0
    walk = summary["per_sequence"]["walk"]["metrics"]
    assert walk["diag_match_mean"] == 15 and walk["diag_failure_few_matches_ratio"] == 1.0 and "baseline_comparison" not in summary
    store = {(r["key"], r["metric"]): r["value"] for r in readers.baselines(spark, str(tmp_path / "store.json")).collect()}
    assert store["k", "ATE_RMSE"] == walk["ATE_RMSE"] and store["k_telemetry", "telemetry_event_count"] == 2

    again = evaluation.run_evaluation(spark, evaluation.load_evaluation(spark, config(tmp_path, "d.json", run_id="d", output_dir="o2", trajectories=seq, baseline=held)))
    assert again["baseline_comparison"]["status"] == again["telemetry_baseline_comparison"]["status"] == "pass"
    worse = {"baselines": {"k": {"metrics": {"ATE_RMSE": walk["ATE_RMSE"] - 0.03}}, "k_telemetry": {"metrics": {"telemetry_mean_duration_s": 1.0}}}, "version": 1}
    sinks.write_text(spark, str(tmp_path / "store.json"), json.dumps(worse))
    config(tmp_path, "e.json", run_id="e", output_dir="o3", trajectories=seq, baseline=held | {"key": "none"})
    runs = config(tmp_path, "b.json", runs=[{"name": "first", "config_path": "d.json"}, {"name": "second", "config_path": "e.json"}], severity={"metric_weights": {"ATE_RMSE": 4}}, fail_fast=False, output_path="ci.json")
    got = evaluation.run_benchmarks(spark, runs)
    assert [r["status"] for r in got] == ["regressed", "missing_baseline"] and got[0]["score"] == pytest.approx(4.0) and got[1]["score"] == 0
    report = json.loads((tmp_path / "ci.json").read_text())
    assert report["runs"] == got and report["status"] == "regressed" and report["benchmark_metrics"]["run_count"] == 2
    runs = config(tmp_path, "f.json", runs=[{"name": "absent", "config_path": "none.json"}, {"name": "first", "config_path": "d.json"}, {"config_path": "d.json", "runtime_budget_s": 0.0}], max_workers=2, fail_fast=False, output_path="ci2.json")
    got = evaluation.run_benchmarks(spark, runs)
    assert [r["status"] for r in got] == ["error", "regressed", "budget_exceeded"] and got[0]["error"]["message"]
    runs = config(tmp_path, "g.json", runs=[{"name": "absent", "config_path": "none.json"}, {"name": "first", "config_path": "d.json"}], output_path="ci3.json")
    assert [r["name"] for r in evaluation.run_benchmarks(spark, runs)] == ["absent"]


def test_governed_runs(spark, tmp_path):
    store, runs = str(tmp_path / "store.json"), {"a": lambda s: s.range(50), "b": lambda s: s.range(9)}
    gate = lambda **more: [r["status"] for r in evaluation.govern(spark, runs | more.pop("new", {}), more.pop("limits", {}), store, {"runtime_s": 60.0, "rows": 5.0}, fail_fast=False, **more)]
    assert gate(write=True) == ["missing_baseline", "missing_baseline"]
    assert gate() == ["pass", "pass"]
    assert gate(new={"a": lambda s: s.range(80)}, limits={"b": evaluation.Budget(rows=3)}) == ["regressed", "budget_exceeded"]


def test_configs_that_say_too_little(spark, tmp_path):
    for more in ({"dataset": "custom"}, {"dataset": "kitti", "kitti_root": "a", "est_root": "b"}, {"trajectories": [{"name": "s", "gt_path": "g", "est_path": "e", "est_run_dir": "r"}]}):
        with pytest.raises(ValueError):
            evaluation.load_evaluation(spark, config(tmp_path, "x.json", **more))
    c = evaluation.load_evaluation(spark, config(tmp_path, "kitti.json", dataset="KITTI", kitti_root="data", est_root="est", sequences=["00", 1], rpe_delta=5))
    assert [s.gt_path for s in c.sequences] == [str(tmp_path / "data/poses/00.txt"), str(tmp_path / "data/poses/1.txt")] and c.sequences[0].rpe_delta == 5 and c.run_id == "kitti"
    two = write(tmp_path / "g.txt", [(0, 0, 0)])
    with pytest.raises(ValueError):
        evaluation.evaluate(spark, evaluation.load_evaluation(spark, config(tmp_path, "y.json", trajectories=[{"name": "s", "gt_path": two, "est_path": two, "cols": "0,1,2", "est_cols": "0,1"}])))
