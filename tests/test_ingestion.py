"""Queues, retries, layouts, run folders and model selection."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import geometry, graphs, ingestion, joins, ordered, similarity
from strandline.sources import layout, readers, runs


def test_queue_counts_what_waits():
    q = ingestion.BoundedQueue(capacity=2)
    got = [q.step(p) for p in (False, True, True, True, False)]
    assert [g["done"] for g in got] == [False, True, True, False, True]
    assert (q.depth, q.blocked_puts, q.blocked_gets, got[2]["depth_ratio"]) == (1, 1, 1, 1.0)
    q.resize(1)
    assert not q.step(True)["done"]
    with pytest.raises(ValueError, match="bounds"):
        q.resize(0)


def test_retries_stop_at_the_first_success(spark):
    rows = spark.createDataFrame([(1, [True], [0.5]), (2, [False, True, True], [0.5, 0.5]), (3, [None, False, True], [1.0]), (4, [], [])], "id long, o array<boolean>, u array<double>")
    got = ingestion.retried(rows, F.col("o"), F.col("u")).orderBy("id").collect()
    assert [(r["decoded"], r["attempts"], r["retries"], round(r["waited_s"], 4)) for r in got] == [(True, 1, 0, 0.0), (True, 2, 1, 0.025), (False, 2, 1, 0.03), (False, 0, 0, 0.0)]


def test_workers_never_fall_below_none(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([False, True, True, False, False, False, True])], "k long, i long, s boolean")
    got = ingestion.worker_counts(rows, ["k"], "i", F.col("s")).orderBy("i").collect()
    assert [r["active_workers"] for r in got] == [0, 1, 2, 1, 0, 0, 1] and got[-1]["total_spawned"] == 3


def test_solver_gate_and_lookups(spark):
    runs_ = spark.createDataFrame([(1, 1, 0.0, 10), (1, 2, 5.0, 16), (1, 3, 7.0, 16)], "k long, i long, cost double, iterations long")
    got = ordered.solver_gate(runs_, ["k"], "i").orderBy("i").collect()
    assert [r["status"] for r in got] == ["baseline", "regressed", "regressed"]
    assert [r["triggered"] for r in got] == [[], ["max_iteration_ratio"], ["max_cost_ratio"]] and got[1]["cost_ratio"] is None
    asked, store = spark.createDataFrame([(1,), (1,), (2,)], "k long"), spark.createDataFrame([(1, "a")], "k long, v string")
    assert sorted(r["found"] for r in joins.keyed_lookup(asked, store, "k").collect()) == [False, True, True]
    items = spark.range(100).repartition(7)
    assert [r["id"] for r in similarity.sampled(items, "id", 5, 3).collect()] == [r["id"] for r in similarity.sampled(items.coalesce(1), "id", 5, 3).collect()]
    row = spark.range(1).select(scalars.differing_bytes(F.unhex(F.lit("00ff10")), F.unhex(F.lit("01ff20"))).alias("d"), scalars.number_map(F.create_map(F.lit("a"), F.lit("3.7")), "long")["a"].alias("n")).first()
    assert (row["d"], row["n"]) == (2, 3)


def test_sequences_are_found_and_decoded(spark, tmp_path):
    images = tmp_path / "drives" / "0001" / "image_02" / "data"
    images.mkdir(parents=True)
    for i in (2, 0, 1):
        (images / f"{i}.png").write_bytes(b"ok" if i != 1 else b"bad")
    (images / "timestamps.txt").write_text("2011-09-26 13:02:25.000000\nno time\n2011-09-26 13:02:25.500000\n")
    (tmp_path / "drives" / "calib.txt").write_text("P2: 1\n")
    folder = layout.sequence_folder(spark, str(tmp_path), "0001")
    assert layout.image_folder(spark, folder).endswith("image_02/data") and layout.calibration_file(spark, folder, str(tmp_path)).endswith("drives/calib.txt")
    frames = layout.sequence_frames(spark, str(tmp_path), "0001").orderBy("idx").collect()
    assert [(r["idx"], r["path"][-5:], r["ts"]) for r in frames] == [(0, "0.png", 0.0), (1, "1.png", 0.5), (2, "2.png", None)]
    assert layout.sequence_frames(spark, str(tmp_path), "0001", most=2).count() == 2
    got = layout.decoded(spark, layout.sequence_frames(spark, str(tmp_path), "0001"), lambda b: None if b == b"bad" else len(b), "int").orderBy("idx").collect()
    assert [(r["value"], r["retries"], r["dropped"]) for r in got] == [(2, 0, False), (None, 1, True), (2, 0, False)]
    with pytest.raises(FileNotFoundError):
        layout.sequence_folder(spark, str(tmp_path), "none")
    (tmp_path / "drives" / "0001" / "times.txt").write_text("1.5\n\n2.5\n")
    assert [r["ts"] for r in layout.sequence_stamps(spark, folder, str(images)).orderBy("idx").collect()] == [1.5, 2.5]


def test_run_folder_holds_its_results(spark, tmp_path):
    folder = runs.create_run(spark, str(tmp_path), "r", "c.json", "h", 3, resolved={"a": 1}, created_at="2024-01-02T03:04:05+00:00")
    assert folder.endswith("r_20240102T030405Z0000") and json.loads((tmp_path / folder / "run_metadata.json").read_text())["seed"] == 3
    recorder = runs.Recorder(spark, f"{folder}/telemetry/events.json", {"seed": 3}, lambda stage: f"id-{stage}")
    with runs.Timed("load", recorder, memory=True):
        pass
    with pytest.raises(KeyError), runs.Timed("solve", recorder, {"stage": "s"}):
        raise KeyError("x")
    poses = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(3)], "idx long, x double, y double, z double")
    paths = runs.write_bundle(spark, folder, poses, spark.createDataFrame([(1, "ok")], "frame_id long, status string"), {"seed": 3}, recorder)
    seen = {r["name"]: r["metadata"] for r in readers.telemetry_events(spark, paths["telemetry"]).collect()}
    assert seen["load"]["success"] == "true" and "memory_peak_bytes" in seen["load"]
    assert (seen["solve"]["error"], seen["solve"]["correlation_id"]) == ("KeyError", "id-s")
    assert {r["metric"]: r["value"] for r in readers.metrics(spark, paths["metrics"]).collect()}["path_length"] == 2
    assert runs.stored(spark, folder, "metrics") == ["run_metrics"] and runs.stored(spark, folder, "maps") == []
    with pytest.raises(ValueError, match="nothing"):
        runs.write_bundle(spark, folder, poses.limit(0), poses, {})
    (tmp_path / "none.json").write_text('{"entries": []}')
    with pytest.raises(Exception, match="too few"):
        readers.frame_diagnostics(spark, str(tmp_path / "none.json")).collect()
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        readers.json_report(spark, str(tmp_path / "bad.json"), "status string").collect()


def test_models_are_chosen_by_weighed_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (80, 3)) + [0, 0, 5]
    r, t = graphs.exp_so3(np.array([0.02, 0.1, -0.03])), np.array([1.0, 0.2, 0.1])
    k = np.array([[500.0, 0, 320], [0, 500, 240], [0, 0, 1]])
    a, b = (geometry.transfer(k, p[:, :2] / p[:, 2:]) for p in (x, x @ r.T + t))
    plane = geometry.transfer(np.array([[1.0, 0.02, 30], [0.01, 1, 5], [0, 0, 1]]), a)
    rows = [(n, *map(float, p), *map(float, q)) for n, (u, v) in enumerate(((a, b), (a, plane), (a[:10], b[:10]))) for p, q in zip(u, v, strict=True)]
    df = spark.createDataFrame(rows, "pair long, ua double, va double, ub double, vb double")
    got = {g["pair"]: g for g in geometry.estimate_pairs(df, camera=k.ravel().tolist()).collect()}
    assert got[0]["method"] == "essential" and got[0]["inliers"] >= 75 and got[0]["cheirality_ratio"] > 0.9
    assert (got[2]["method"], got[2]["failure_reason"]) == ("none", "too_few_matches")
    only = geometry.Selection(essential_bias=0.01)
    assert {g["pair"]: g["method"] for g in geometry.estimate_pairs(df, camera=k.ravel().tolist(), how=only).collect()}[1] == "homography"
    assert geometry.adaptive_limit(a, b) == pytest.approx(0.02) and geometry.adaptive_limit(a[:0], b[:0]) == 0.01
    with pytest.raises(ValueError, match="too few"):
        geometry.pose_from_matches(a[:3], b[:3], 1)


def test_solvers_are_found_by_name(spark):
    graphs.register_solver("still", lambda states, edges, kind: (states, "kept", 1, [0.0]))
    try:
        v = spark.createDataFrame([(1, 0, [0.0, 0.0, 0.0]), (1, 1, [1.0, 0.0, 0.0])], "graph_id long, id long, state array<double>")
        e = spark.createDataFrame([(1, 0, 1, [2.0, 0.0, 0.0], 1.0)], "graph_id long, i long, j long, meas array<double>, weight double")
        assert {r["status"] for r in graphs.optimise_graphs(v, e, solver="still").collect()} == {"kept"}
        with pytest.raises(ValueError, match="has that name"):
            graphs.register_solver("still", graphs.supervised)
        with pytest.raises(ValueError, match="no solver"):
            graphs.optimise_graphs(v, e, solver="none")
    finally:
        del graphs.SOLVERS["still"]


def test_losses_meet_where_they_change(spark):
    rows = spark.createDataFrame(pd.DataFrame({"z": [0.0, 4.0, 4.000001, 100.0]}))
    for kind in ("huber", "tukey"):
        got = [tuple(r) for r in rows.select(*[x.cast("double") for x in scalars.robust_loss(kind, F.col("z"), 2.0)]).collect()]
        assert got[0][0] == 0 and got[0][1] == 1 and abs(got[1][0] - got[2][0]) < 1e-5
