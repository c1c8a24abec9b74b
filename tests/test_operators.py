"""Golden cases and brute force for operators, readers, sinks and streaming twins."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import canonical, scalars
from strandline.operators import baselines, geometry, graphs, joins, loops, machines, ordered, similarity, telemetry, trajectory
from strandline.sources import readers, sinks
from strandline.streaming import ops


def test_telemetry_golden(spark):
    e = spark.createDataFrame([("feature", 0.1, {"memory_delta_bytes": "128", "correlation_id": "abc"}), ("feature", 0.2, {}), ("track", 0.3, {"correlation_id": ""}), (None, None, None)], "name string, duration_s double, metadata map<string,string>")
    n = telemetry.normalise_events(e)
    d = {r["stage"]: r for r in telemetry.digest(n).collect()}
    assert d[None]["event_count"] == 4 and d["feature"]["mean"] == pytest.approx(0.15) and d["track"]["variance"] == 0 and d["unknown"]["total"] == 0
    assert telemetry.memory_digest(n).where("stage is null").first()["total"] == 128
    assert [tuple(r) for r in telemetry.correlation_min(n).collect()] == [("feature", "abc", False)]


def test_drift_golden(spark):
    make = lambda v: telemetry.digest(spark.createDataFrame([("track", x) for x in v], "stage string, duration_s double"))
    r = telemetry.drift(make([0.1, 0.2]), make([0.2, 0.3]), ("mean",), {"relative": 0.2, "absolute": 0.05}).first()
    assert (r["relative_status"], r["absolute_status"]) == ("fail", "fail")


def test_streaming_quantile_markers():
    m = machines.QuantileMarkers(0.95)
    for x in (1, 2, 3, 4, 50):
        m.add(x)
    assert m.value() == 3
    rng, m = np.random.default_rng(1), machines.QuantileMarkers(0.9)
    x = rng.normal(size=5000)
    for v in x:
        m.add(v)
    assert m.value() == pytest.approx(np.quantile(x, 0.9), abs=0.05)


def test_baselines_golden(spark):
    cur = spark.createDataFrame([("a", "ate", 0.6), ("a", "rpe", 0.25), ("b", "inlier", 0.52), ("c", "ate", 1.0)], "key string, metric string, value double")
    base = spark.createDataFrame([("a", "ate", 0.5), ("a", "rpe", 0.2), ("b", "inlier", 0.6), ("a", "gone", 1.0)], "key string, metric string, value double")
    lim = spark.createDataFrame([("ate", 0.2, None, None, None), ("rpe", 0.1, None, None, None), ("inlier", None, -0.05, None, None)], "metric string, max_delta double, min_delta double, max_ratio double, min_ratio double")
    got = {r["key"]: r["status"] for r in baselines.gate(baselines.compare(cur, base, lim)).collect()}
    assert got == {"a": "pass", "b": "regressed", "c": "regressed"}
    status = {r["key"]: r["status"] for r in baselines.compare(cur, base, lim).where("metric = 'ate'").collect()}
    assert status == {"a": "pass", "c": "missing_baseline"}


def test_nearest_ties_and_duplicates(spark):
    ref = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 50.0)], "k int, idx long, ts double")
    other = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.5), (1, 2, 2.0), (1, 3, 2.0)], "k int, idx long, ts double")
    got = {r["idx"]: r["other_idx"] for r in joins.nearest_in_time(ref, other, ["k"], 0.5).collect()}
    assert got == {0: 1, 1: 2}
    rng = np.random.default_rng(3)
    a, b = (pd.DataFrame({"k": 1, "idx": range(200), "ts": np.round(np.sort(rng.uniform(0, 60, 200)), 1)}) for _ in range(2))
    got = {r["idx"]: r["other_idx"] for r in joins.nearest_in_time(spark.createDataFrame(a), spark.createDataFrame(b), ["k"], 0.3).collect()}
    for i, t in zip(a["idx"], a["ts"], strict=True):
        near = [(abs(o - t), -o, j if o >= t else -j, j) for j, o in zip(b["idx"], b["ts"], strict=True) if abs(o - t) <= 0.3]
        assert got.get(i) == (min(near)[3] if near else None)


def test_synchronise_and_position(spark):
    ref = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.1)], "k int, idx long, ts double")
    other = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.7)], "k int, idx long, ts double")
    out = joins.synchronise(ref, {"right": other}, ["k"], 0.05)
    assert out.count() == 1 and joins.drop_report(2, out.count()) == (0.5, "error") and joins.by_position(ref, other, ["k"]).count() == 2


def test_loop_samples_golden(spark):
    s = spark.createDataFrame([("good", 12.0, 4.0, 60, 45, 1.0, 5.0, 0.2, True), ("false", 20.0, 19.2, 40, 20, 3.0, 12.0, 0.8, False)], "sample_id string, query_timestamp_s double, candidate_timestamp_s double, match_count int, inlier_count int, mean_reprojection_error double, rotation_error_deg double, translation_error double, expected_match boolean")
    got = {r["sample_id"]: r for r in loops.score_loops(s, max_reprojection=2.0).collect()}
    assert got["good"]["geometric"] == pytest.approx(0.72) and got["good"]["combined"] == pytest.approx(0.804) and got["good"]["accepted"]
    assert "temporal_separation" in got["false"]["reasons"] and not got["false"]["accepted"]
    assert loops.confusion(loops.score_loops(s, max_reprojection=2.0), []).first()["accuracy"] == 1


def test_event_order_golden(spark):
    kind = "stage string, event_type string, message string, metadata string, timestamp_s double"
    a = spark.createDataFrame([("alpha", "a_mid", "", "", 2.0), ("alpha", "a_start", "", "", 1.0)], kind)
    b = spark.createDataFrame([("beta", "b_start", "", "", 1.5), ("beta", "b_mid", "", "", 2.0)], kind)
    out = ordered.merge_events(a, b).orderBy("timestamp_s", "stage", "seq_id").collect()
    assert [r["event_type"] for r in out] == ["a_start", "b_start", "a_mid", "b_mid"]


def test_histogram_closes_last_bin(spark):
    x = [0.0, 0.5, 1.0, 9.99, 10.0, 10.1, -1.0]
    got = {r["bin"]: r["n"] for r in ordered.histogram(spark.createDataFrame([(v,) for v in x], "v double"), [], "v", 0, 10, 20).collect()}
    want = np.histogram(x, bins=20, range=(0, 10))[0]
    assert got == {i: n for i, n in enumerate(want) if n}


def test_alignment_2d_equals_svd(spark):
    rng = np.random.default_rng(0)
    rows = []
    for seq in range(6):
        g = rng.normal(size=(30, 2))
        e = g @ rng.normal(size=(2, 2)) + rng.normal(size=2)
        rows += [(seq, i, *map(float, g[i]), *map(float, e[i])) for i in range(30)]
    df = spark.createDataFrame(rows, "seq long, idx long, gx double, gy double, ex double, ey double")
    fit = {r["seq"]: r for r in trajectory.align_2d(df, ["seq"]).collect()}
    for seq in range(6):
        m = np.array([r[2:] for r in rows if r[0] == seq])
        r, t, s = trajectory.align_matrix(m[:, 2:], m[:, :2])
        assert fit[seq]["scale"] == pytest.approx(s) and np.cos(fit[seq]["theta"]) == pytest.approx(r[0, 0]) and fit[seq]["tx"] == pytest.approx(t[0])
    e = trajectory.errors_3d(df.withColumns({"gz": F.lit(0.0), "ez": F.lit(0.0)}), ["seq"]).count()
    assert e == 6 and trajectory.error_stats(df, ["seq"], "idx", 99).first()["rpe_rmse"] is None


def test_pose_products_agree(spark):
    rng = np.random.default_rng(1)
    rows, mats = [], []
    for i in range(20):
        dx, dy, a = rng.normal(size=3)
        m = np.eye(4)
        m[:2, :2], m[:2, 3] = [[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]], (dx, dy)
        rows.append((1, i, float(dx), float(dy), float(a)))
        mats.append((1, i, m.ravel().tolist()))
    flat = trajectory.compose_2d(spark.createDataFrame(rows, "s long, i long, dx double, dy double, dyaw double"), ["s"], "i").orderBy("i").collect()
    full = trajectory.positions(trajectory.compose_matrices(spark.createDataFrame(mats, "s long, i long, pose array<double>"), "s", "i")).orderBy("i").collect()
    assert all(a["x"] == pytest.approx(b["x"]) and a["y"] == pytest.approx(b["y"]) for a, b in zip(flat, full, strict=True))


def test_breaker_and_supervisor():
    b = machines.Breaker(failures=2, cooldown=1.0)
    assert [b.step(t, ok) for t, ok in ((0, False), (0.1, True), (0.2, False), (0.5, True), (1.3, True), (1.4, True))] == ["closed", "closed", "open", "open", "half_open", "closed"]
    s = machines.Supervisor({"feature": ("ingestion",)}, cooldown=1.0, streak=2, settle=1)
    s.update(0, {"ingestion": "tripped", "feature": "healthy"})
    assert s.state == {"ingestion": "tripped", "feature": "degraded"}
    for t in (1.5, 2.0, 2.5):
        s.update(t, {"ingestion": "healthy", "feature": "healthy"})
    assert s.state["ingestion"] == "healthy"


def test_supervisor_holds_escalates_and_queues():
    s = machines.Supervisor({}, cooldown=1.0)
    told = [s.update(t, {"a": x}) for t, x in ((0, "tripped"), (1.5, "healthy"), (1.6, "degraded"), (1.7, "healthy"), (1.8, "healthy"), (1.9, "degraded"), (2.0, "healthy"), (2.1, "healthy"))]
    assert [m[0][2:] if m else None for m in told] == [("healthy", "tripped", "snapshot"), ("tripped", "recovering", "cooldown_elapsed"), None, None, ("recovering", "healthy", "recovered"), ("healthy", "degraded", "snapshot"), None, None]
    s = machines.Supervisor({"tracking": ("feature",)}, growth=(1, 2))
    s.update(1.0, {"ingestion": machines.Reading("healthy", ratio=0.9, pressure=1), "feature": machines.Reading("idle", opens=1), "tracking": "healthy", "other": machines.Reading("healthy", errors=2)})
    assert s.state == {"feature": "tripped", "ingestion": "degraded", "other": "degraded", "tracking": "degraded"}
    assert s.recovery == [("feature", "circuit_breaker", "tripped"), ("ingestion", "backpressure", "degraded")]
    s = machines.Supervisor({}, capacity=1)
    s.update(1.0, {n: machines.Reading("healthy", ratio=0.96) for n in ("feature", "ingestion")})
    assert [x[0] for x in s.recovery] == ["ingestion"]


def test_supervise_reads_counters(spark):
    rows = [("r", 1.0, "a", "healthy", 0.5, 1), ("r", 2.0, "a", "healthy", None, 1), ("r", 3.0, "a", "healthy", 0.99, 9)]
    got = machines.supervise(spark.createDataFrame(rows, "run string, tick double, stage string, asked string, ratio double, pressure int"), "run", {}, settle=1).collect()
    assert [tuple(r)[1:] for r in got] == [(1.0, "a", "healthy", "degraded", "snapshot"), (2.0, "a", "degraded", "healthy", "stabilized"), (3.0, "a", "healthy", "tripped", "snapshot")]


def test_thresholds_are_parsed():
    assert scalars.parse_threshold(2) == {"max_delta": 2.0} and scalars.parse_threshold(None) is None and scalars.parse_threshold({}) is None
    assert scalars.parse_threshold({"direction": "higher", "tolerance": 0.5, "max_ratio": 1}) == {"min_delta": -0.5, "max_ratio": 1.0}
    with pytest.raises(ValueError):
        scalars.parse_threshold({"direction": "up", "tolerance": 1})
    with pytest.raises(TypeError):
        scalars.parse_threshold("0.1")


def test_keyframes_by_trace(spark):
    turn = lambda a: np.array([[1, 0, 0, 0], [0, np.cos(a), -np.sin(a), 0], [0, np.sin(a), np.cos(a), 0], [0, 0, 0, 1]])
    poses = [turn(0), turn(np.radians(4)), turn(np.radians(6)), turn(np.radians(6)), turn(np.radians(6))]
    poses[3] = poses[3] + np.array([[0, 0, 0, 0.2]] + [[0] * 4] * 3)
    df = spark.createDataFrame([(1, i, p.ravel().tolist(), 0.2 if i == 4 else 0.9) for i, p in enumerate(poses)], "s long, i long, pose array<double>, match_ratio double")
    assert [r["keyframe"] for r in trajectory.keyframes(df, "s", "i").orderBy("i").collect()] == [True, False, True, True, True]


def test_merge_numbers_across_spans(spark):
    rows = [("a" if i % 3 else "b", "t", str(i % 5), "{}", float((i * 37) % 101) * 100 if i % 10 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "stage string, event_type string, message string, metadata string, timestamp_s double")
    got = sorted((r["stage"], r["seq_id"], r["timestamp_s"] if r["timestamp_s"] is not None else -1.0) for r in ordered.merge_events(df.where("message < 3"), df.where("message >= 3")).collect())
    assert [g[:2] for g in got] == [(s, i) for s in "ab" for i in range(sum(r[0] == s for r in rows))]
    assert all(a[2] <= b[2] for a, b in zip(got, got[1:]) if a[0] == b[0])


def test_propagation_and_readiness(spark):
    st = spark.createDataFrame([("a", "tripped"), ("b", "recovering"), ("c", "healthy"), ("d", "healthy")], "stage string, state string")
    up = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c")], "stage string, needs string")
    assert {r[0]: r[1] for r in joins.propagate(st, up, 3).collect()} == {"a": "tripped", "b": "degraded", "c": "degraded", "d": "degraded"}
    parts = spark.createDataFrame([(1, "pass"), (1, "regressed"), (2, "warn"), (2, "fail")], "k int, status string")
    assert {r["k"]: r["status"] for r in baselines.readiness(parts, ["k"]).collect()} == {1: "unknown", 2: "fail"}
    assert baselines.readiness(parts, ["k"], strict=True).where("k = 1").first()["status"] == "fail"


def test_canonical_digest(spark):
    a = {"b": 1e-05, "a": ["é", None, True], "t": 3}
    assert canonical.canonical(a, ["t"]) == '{"a":["é",null,true],"b":1e-05}'
    got = spark.createDataFrame([(json.dumps(a),)], "j string").select(F.sha2(canonical.canonical_json(F.col("j"), ("t",)), 256)).first()[0]
    assert got == canonical.stable_hash(a, ["t"])


def test_scalar_functions(spark):
    row = spark.range(1).select(scalars.artifact_name(F.lit("__a b-c/")).alias("a"), scalars.metric_name(F.lit(" Frame-Rate ")).alias("m"), scalars.derived_seed(F.lit(7), F.lit("ransac")).alias("s"), scalars.parsed_time(F.lit("2011-09-26 13:02:35.123456")).cast("double").alias("t"), scalars.hamming(F.array(F.lit(7), F.lit(0)), F.array(F.lit(1), F.lit(8))).alias("h"), scalars.is_error_event(F.lit("x"), F.lit("Circuit open")).alias("e")).first()
    import hashlib

    assert (row["a"], row["m"], row["h"], row["e"]) == ("a b-c", "frame_rate", 3, True) or row["a"] == "a_b-c"
    assert row["s"] == int.from_bytes(hashlib.sha256(b"7:ransac").digest()[:8], "big") % (2**31 - 1)
    assert row["t"] == pytest.approx(1317042155.123456)


def test_geometry_recovers_motion(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (60, 3)) + [0, 0, 5]
    r, t = graphs.exp_so3(np.array([0.02, 0.1, -0.03])), np.array([1.0, 0.2, 0.1])
    a, y = x[:, :2] / x[:, 2:], x @ r.T + t
    b = y[:, :2] / y[:, 2:]
    b[:6] += rng.uniform(-1, 1, (6, 2))
    model, ok = geometry.robust_essential(a, b, 1)
    rot, direction, share = geometry.pose_from_essential(model, a[ok], b[ok])
    assert ok.sum() >= 50 and share == 1 and np.allclose(rot, r, atol=1e-3) and np.allclose(direction, t / np.linalg.norm(t), atol=1e-2)
    rows = [(1, *map(float, p), *map(float, q)) for p, q in zip(a, b, strict=True)]
    assert geometry.estimate_pairs(spark.createDataFrame(rows, "pair long, ua double, va double, ub double, vb double")).first()["inliers"] >= 50
    h = np.array([[1.1, 0.1, 3], [0.0, 0.9, -2], [0.001, 0, 1]])
    p = rng.uniform(0, 100, (30, 2))
    assert np.allclose(geometry.homography(p, geometry.transfer(h, p)), h, atol=1e-6)
    k, offset = geometry.intrinsics(np.array([[7.0, 0, 3, 0], [0, 7, 2, 0], [0, 0, 1, 0]]))
    assert k[0, 0] == 7 and k[1, 2] == 2 and np.allclose(offset, 0)


@pytest.mark.parametrize("kind", ["se2", "se3", "sim3"])
def test_pose_graphs_close_loops(kind):
    f, size = graphs.FACTORS[kind]
    rng = np.random.default_rng(0)
    true = rng.normal(size=(6, size)) * (0.3 if size > 3 else 1)
    measure = lambda i, j: f(true[i], true[j], np.zeros(size))
    edges = [(i, (i + 1) % 6, measure(i, (i + 1) % 6), 1.0) for i in range(6)] + [(0, 3, measure(0, 3), 1.0)]
    start = true + rng.normal(size=true.shape) * 0.05
    start[0] = true[0]
    x, status, tries, costs = graphs.supervised(start, edges, kind)
    assert status == "converged" and costs[-1] < 1e-6 < costs[0] and np.allclose(x, true, atol=1e-2)


def test_cosine_top_k_and_vocabulary(spark):
    items = spark.createDataFrame([(i, [float(i % 3), 1.0, 0.0]) for i in range(12)] + [(50, [0.0, 0.0, 0.0])], "id long, v array<double>")
    got = similarity.cosine_top_k(items, items.where("id = 0 or id = 50"), 3, block=1).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in got] == [3, 6, 9, 0, 1, 2] and got[3]["score"] == 0
    assert len(similarity.vocabulary(items, 3, 1)) == 3


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# c\n\n1 2 3\n4 5\n6 7 8\n")
    got = readers.text_trajectory(spark, str(tmp_path / "t.txt"), [0, 2]).orderBy("idx").collect()
    assert [r["coords"] for r in got] == [[1, 3], [6, 8]] and readers.columns_of("kitti_odom", None) == [3, 7, 11]
    (tmp_path / "calib.txt").write_text("P2: 7 0 3 0 0 7 2 0 0 0 1 0\nR0_rect: 1 0 0 0 1 0 0 0 1\nbad line\n# x: 1\n")
    c = {r["key"]: r for r in readers.calibration(spark, str(tmp_path / "calib.txt")).collect()}
    assert (c["P2"]["rows"], c["P2"]["cols"], c["R0_rect"]["cols"]) == (3, 4, 3)
    (tmp_path / "e.json").write_text(json.dumps({"events": [{"name": "a", "duration_s": 1.0}, {"name": "b", "duration_s": 2.0, "metadata": {"k": "v"}}]}))
    assert readers.telemetry_events(spark, str(tmp_path / "e.json")).agg(F.sum("duration_s")).first()[0] == 3
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="no array"):
        readers.telemetry_events(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "times.txt").write_text("35.123456\nbad\n35.223456\n")
    assert [round(r["ts"], 6) for r in readers.stamps(spark, str(tmp_path / "times.txt"), True).orderBy("idx").collect()] == [0, 0.1]
    np.savez(tmp_path / "run.npz", poses=np.stack([np.eye(4)] * 3), timestamps=np.arange(3.0), frame_ids=np.zeros(0))
    assert readers.npz_trajectories(spark, str(tmp_path)).where("frame_id is null").count() == 3
    assert readers.baselines(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "base.json").write_text(json.dumps({"version": 1, "baselines": {"k": {"metrics": {"ate": 0.5}, "config_hash": "h", "updated_at": "t"}}}))
    assert readers.baselines(spark, str(tmp_path / "base.json")).first()["value"] == 0.5
    spark.dataSource.register(readers.SyntheticFrames)
    assert spark.read.format("frames").option("n", 25).option("chunk", 10).load().count() == 25
    runs = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "sequence string, ate double, rpe double")
    sinks.write_report_csv(runs, "sequence", str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).where("sequence = 'aggregate' and metric = 'ate'").first()["value"] == "2.0"
    sinks.write_run(runs, str(tmp_path / "runs"), 7, "h", ("sequence",))
    assert spark.read.parquet(str(tmp_path / "runs")).where("sequence = 'a'").first()["seed"] == 7
    with pytest.raises(ValueError):
        sinks.write_run(runs.limit(0), str(tmp_path / "none"), 7, "h", ("sequence",))


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ops.run_available(ops.stream_digest(stream, "ts", "event_type", "value", "1 day", "40 days"), "digest", str(tmp_path / "c1"), "complete")
    assert got.agg(F.sum("event_count"), F.round(F.sum("total"), 4)).first() == e.agg(F.count("value"), F.round(F.sum("value"), 4)).first()
    items = spark.createDataFrame([("r", s) for s in (3, 0, 2, 1, 1, 4)], "run string, seq long").coalesce(1)
    items.write.parquet(str(tmp_path / "seq"))
    seq = ops.run_available(ops.reorder(spark.readStream.schema(items.schema).parquet(str(tmp_path / "seq")), "run", "seq"), "seq", str(tmp_path / "c2"))
    assert [r["seq"] for r in seq.collect()] == [0, 1, 2, 3, 4]
    tries = spark.createDataFrame([("k", float(i), False) for i in range(6)], "key string, ts double, ok boolean")
    tries.write.parquet(str(tmp_path / "tries"))
    state = ops.run_available(ops.breaker_stream(spark.readStream.schema(tries.schema).parquet(str(tmp_path / "tries")), "key", cooldown=100.0), "breaker", str(tmp_path / "c3"))
    assert state.first()["state"] == "open"
    asked = spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02d}") for i in range(5)], "id long, t string").select("id", F.to_timestamp("t").alias("ts"))
    asked.write.parquet(str(tmp_path / "asked"))
    asked.where("id < 3").select("id", (F.col("ts") + F.expr("interval 1 second")).alias("ts"), F.lit("x").alias("payload")).write.parquet(str(tmp_path / "answers"))
    a, b = (spark.readStream.schema(spark.read.parquet(str(tmp_path / p)).schema).parquet(str(tmp_path / p)) for p in ("asked", "answers"))
    joined = ops.run_available(ops.ttl_join(a, b, "id", "5 seconds"), "ttl", str(tmp_path / "c4"))
    assert {r["id"] for r in joined.where("payload is not null").collect()} == {0, 1, 2}


def test_bundle_adjustment_lowers_reprojection():
    rng = np.random.default_rng(5)
    k = np.array([[300.0, 0, 160], [0, 300, 120], [0, 0, 1]])
    poses = np.array([[0.0, 0.05 * i, 0.01 * i, -0.3 * i, 0.05 * i, 0.02 * i] for i in range(4)])
    points = rng.uniform(-1, 1, (25, 3)) + [0, 0, 5]
    seen = np.array([(i, j) for i in range(4) for j in range(25)])
    pixels = np.vstack([graphs.project(p, points, k) for p in poses])
    start = poses + rng.normal(size=poses.shape) * 0.01
    start[0] = poses[0]
    p, x, costs = graphs.bundle_adjust(start, points + rng.normal(size=points.shape) * 0.05, seen, pixels, k)
    assert costs[0] > 10 and costs[-1] < 1e-6 and (p[0] == poses[0]).all()
    assert np.abs(np.vstack([graphs.project(q, x, k) for q in p]) - pixels).max() < 1e-2
