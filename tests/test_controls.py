"""Golden cases and brute force for calibration, maps, control-plane operators and reports of a run."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import calibration, control, geometry, machines, maps
from strandline.sources import readers, sinks

EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def cameras(spark, *rows):
    return spark.createDataFrame(rows, "rig int, camera string, k array<double>, t array<double>, r array<double>")


def test_camera_rules(spark):
    k = [700.0, 0.0, 300.0, 0.0, 700.0, 200.0, 0.0, 0.0, 1.0]
    odd = [-1.0, 0.01, -3.0, 0.0, 700.0, 200.0, 0.0, 0.0, 1.5]
    thin = [1e7, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    bent = [1.0, 0.2, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    df = cameras(spark, (1, "a", k, [0.0, 0.0, 0.0], EYE), (1, "b", k, [0.5, 0.0, 0.0], EYE), (2, "a", odd, [0.0, 0.0, 0.0], EYE), (2, "b", k, [0.0, 0.0, 0.0], bent), (2, "c", k, [5e-4, 0.0, 0.0], EYE), (2, "d", thin, [0.0, 11.0, 0.0], EYE), (3, "a", [0.0] * 9, None, EYE))
    got = {}
    for r in calibration.check_cameras(df, ["rig"]).collect():
        got.setdefault((r["rig"], r["camera"]), []).append(r["rule"])
    assert got == {(2, "a"): ["focal_length", "skew", "last_element", "principal_point"], (2, "b"): ["rotation", "baseline_zero"], (2, "c"): ["baseline_small"], (2, "d"): ["condition", "translation"], (3, "a"): got[3, "a"]}
    assert {"focal_length", "last_element", "singular"} <= set(got[3, "a"])
    named = calibration.check_cameras(df.where("rig = 2"), ["rig"], reference="b").where("rule = 'baseline_zero'").collect()
    assert [r["camera"] for r in named] == ["a"]
    assert calibration.check_cameras(df.where("rig = 9"), ["rig"]).count() == 0


def test_projections_of_a_file(spark, tmp_path):
    (tmp_path / "calib.txt").write_text("P0: 700 0 300 0 0 700 200 0 0 0 1 0\nP_rect_01: 1 0 0 9 0 1 0 9 0 0 1 9\nP1: 700 0 300 -350 0 700 200 0 0 0 1 0\nR: 1 2 3\n")
    lines = readers.calibration(spark, str(tmp_path / "calib.txt"))
    got = {r["camera"]: r for r in calibration.projections(lines).collect()}
    assert set(got) == {"image_0", "image_1"} and got["image_1"]["t"] == pytest.approx([0.5, 0, 0])
    assert calibration.rig_projection(lines, 1).first()["data"][3] == -350
    rng = np.random.default_rng(5)
    p = rng.normal(size=(3, 4))
    p[2, 2] = 2.0
    k, t = geometry.intrinsics(p)
    row = spark.createDataFrame([(p.reshape(-1).tolist(),)], "p array<double>").withColumn("k", scalars.projection_intrinsics(F.col("p"))).withColumn("t", scalars.projection_offset(F.col("k"), F.col("p"))).first()
    assert row["k"] == pytest.approx(k.reshape(-1)) and row["t"] == pytest.approx(t)


def test_dataset_rules(spark):
    facts = spark.createDataFrame([("gone", False, None, None, None, None), ("good", True, 5, 5, 1, None), ("bare", True, 0, None, None, 0), ("off", True, 5, 4, 1, 1)], "seq string, present boolean, n_images long, n_stamps long, n_calibrations long, n_truth long")
    issues = calibration.check_datasets(facts, ["seq"])
    got = sorted((r["seq"], r["rule"]) for r in issues.collect())
    assert got == [("bare", "no_calibration"), ("bare", "no_ground_truth"), ("bare", "no_images"), ("bare", "no_stamps"), ("gone", "absent"), ("off", "stamp_count")]
    ok = {r["seq"]: (r["ok"], r["warnings"]) for r in calibration.dataset_verdict(facts, issues, ["seq"]).collect()}
    assert ok == {"gone": (False, 0), "good": (True, 0), "bare": (False, 2), "off": (True, 1)}


def test_scalar_forms(spark):
    row = spark.range(1).select(
        scalars.camera_id(F.lit("image_03")).alias("a"), scalars.camera_id(F.lit("image_9")).alias("b"), scalars.drive_id(F.lit("27")).alias("c"), scalars.drive_id(F.lit("00027")).alias("d"), scalars.drive_id(F.lit("x1")).alias("e"),
        scalars.adaptive_threshold(F.lit(None).cast("double"), 1.0, 0.5, 3.0).alias("f"), scalars.adaptive_threshold(F.lit(500.0), 1.0, 0.5, 1.5).alias("g"), scalars.loop_scale(F.lit(0.0), F.lit(2.0), 1e-3).alias("h"),
        scalars.keypoint_fields(scalars.keypoint_numbers(F.struct(*[F.lit(float(i)).alias(n) for i, n in enumerate(scalars.KEYPOINT)]))).alias("k"),
    ).first()
    assert tuple(row)[:8] == (3, None, "0027", "00027", "x1", 1.0, 1.5, 1.0) and tuple(row["k"]) == (0, 1, 2, 3, 4, 5, 6)


def test_map_of_frames(spark):
    frames, d = spark.createDataFrame([(1,), (2,)], "frame_id int"), spark.createDataFrame([(1, [0.0, 0.1]), (1, [1.0, 1.0]), (1, [0.0, 0.0])], "frame_id int, v array<double>")
    got = {r["frame_id"]: r["hist"] for r in maps.build_map(frames, d, [[0.0, 0.0], [1.0, 1.0], [5.0, 5.0]]).collect()}
    assert got == {1: pytest.approx([2 / 3, 1 / 3, 0]), 2: [0, 0, 0]}


def test_relocalize_rules(spark):
    c = spark.createDataFrame([(1, 7, 0.99, 59, 90), (1, 8, 0.9, 80, 40), (1, 9, 0.8, 80, 40), (1, 10, 0.75, 60, 40), (1, 11, 0.74, 99, 99), (1, 12, 0.5, 99, 999), (2, 1, 0.2, 99, 99)], "q int, frame_id long, score double, match_count int, inliers int")
    assert [(r["q"], r["frame_id"]) for r in maps.relocalize(c, "q").collect()] == [(1, 8)]


def test_mask_reach(spark):
    points = spark.createDataFrame([(1, 3.9, 3.0), (1, 6.0, 3.0), (2, 3.0, 3.0)], "f int, x double, y double")
    changes = spark.createDataFrame([(1, 3, 3, -25), (1, 3, 4, 30), (1, 9, 9, 24)], "f int, px int, py int, diff int")
    assert sorted((r["f"], r["x"]) for r in maps.unmasked(points, changes, ["f"]).collect()) == [(1, 6.0), (2, 3.0)]


def test_patch_without_mass(spark):
    r = maps.patch_moments(spark.createDataFrame([(1, 3, 4, 0.0), (2, 20, 15, 2.0)], "p int, px int, py int, value double"), ["p"]).orderBy("p").collect()
    assert (r[0]["mass"], r[0]["cx"], r[0]["cy"]) == (0, 0, 0) and (r[1]["cx"], r[1]["cy"], r[1]["angle_deg"]) == (20, 15, 0)


def test_tuner_moves(spark):
    rows = [("s", i, x) for i, x in enumerate([1.0] * 3 + [0.0] * 12)]
    got = control.tune(spark.createDataFrame(rows, "stage string, i int, ratio double"), "stage", "i", "ratio", capacity=112, most_workers=3).orderBy("i").collect()
    assert [r["capacity"] for r in got[:3]] == [120, 128, 128] and [r["workers"] for r in got[:3]] == [3, 3, 3]
    assert got[3]["smooth"] == 0.75 and got[-1]["workers"] == 2 and got[-1]["capacity"] < 128 and got[0]["moves"] == ["queue_scale_up", "worker_scale_up"]


def test_pending_buffer(spark):
    e = [("r", 0, 0.0, 1, "frame"), ("r", 1, 0.1, 2, "frame"), ("r", 2, 0.2, 3, "frame"), ("r", 3, 0.3, 1, "result"), ("r", 4, 0.4, 2, "result"), ("r", 5, 9.0, 9, "frame"), ("r", 6, 9.1, 9, "frame")]
    df = spark.createDataFrame(e, "run string, i int, ts double, seq long, kind string")
    fates = lambda **s: [(r["i"], r["seq"], r["fate"]) for r in control.pending_fates(df, "run", "i", "ts", "seq", "kind", **s).orderBy("i").collect()]
    assert fates(capacity=2) == [(2, 1, "dropped"), (3, 1, "orphan"), (4, 2, "matched"), (5, 3, "expired"), (6, 9, "duplicate")]
    assert fates(capacity=2, drop_oldest=False) == [(2, 3, "rejected"), (3, 1, "matched"), (4, 2, "matched"), (6, 9, "duplicate")]


def test_memo(spark):
    calls = [("w", 0, 0.0, "a"), ("w", 1, 0.5, "a"), ("w", 2, 1.6, "a"), ("w", 3, 1.7, "b"), ("w", 4, 1.8, "c"), ("w", 5, 1.9, "a")]
    df = spark.createDataFrame(calls, "w string, i int, ts double, k string")
    hits = lambda **s: [r["hit"] for r in control.memo_hits(df, "w", "i", "ts", "k", **s).orderBy("i").collect()]
    assert hits() == [False, True, False, False, False, True]
    assert hits(capacity=2) == [False, True, False, False, False, False]


def test_contiguous_and_status(spark):
    s = control.contiguous(spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 3), (2, 1)], "r int, seq long"), ["r"], "seq")
    assert sorted((r["r"], r["seq"], r["ready"]) for r in s.collect()) == [(1, 0, True), (1, 1, True), (1, 3, False), (2, 1, False)]
    f = spark.createDataFrame([(0, 0, None, None, None, None), (1, 90, None, None, None, None), (2, 90, "late", None, None, None), (3, 90, None, None, None, True), (4, 5, None, None, None, None), (5, 90, None, None, "parallax", None), (6, 90, None, "bad", None, None), (7, 90, None, None, None, None)], "i int, match_count int, drop_reason string, feature_error string, pose_error string, relocalized boolean")
    got = [r["status"] for r in control.frame_status(f.withColumn("run", F.lit(1)), ["run"], "i").orderBy("i").collect()]
    assert got == ["bootstrap", "ok", "dropped", "relocalized", "skipped", "failure", "skipped", "skipped"]


def test_streamed_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i, float(x)) for k, n in ((1, 3), (None, 7), (2, 400)) for i, x in enumerate(rng.normal(size=n))]
    got = {r["k"]: r for r in machines.marker_quantiles(spark.createDataFrame(rows, "k int, i int, x double"), "k", "i", "x", (0.5,)).collect()}
    assert {k: r["n"] for k, r in got.items()} == {1: 3, None: 7, 2: 400}
    m = machines.QuantileMarkers(0.5)
    for k, _, x in rows:
        if k == 2:
            m.add(x)
    assert got[2]["p50"] == m.value()
    asked = pd.DataFrame([(r, float(t), s, a) for r in (1, 2) for t, s, a in ((0, "a", "tripped"), (0, "b", "healthy"), (9, "a", "healthy"), (9, "b", "healthy"), (10, "a", "healthy"), (11, "a", "healthy"))], columns=["run", "tick", "stage", "asked"])
    moves = [tuple(r)[1:] for r in machines.supervise(spark.createDataFrame(asked), "run", {"b": ("a",)}).where("run = 2").orderBy("tick", "stage").collect()]
    want = machines.Supervisor({"b": ("a",)})
    assert moves == [m for t, rows in asked[asked.run == 2].groupby("tick") for m in want.update(t, dict(zip(rows.stage, rows.asked, strict=True)))]


def test_reports_of_runs(spark):
    a, b = (spark.createDataFrame(r, "type string, name string, digest string") for r in ([("m", "x", "1"), ("m", "x", "0"), ("t", "y", "2")], [("m", "x", "1"), ("t", "y", "3"), ("t", "z", "4")]))
    report = control.determinism_report(a, b, ["type", "name"])
    assert sorted((r["name"], r["status"]) for r in report.collect()) == [("x", "match"), ("y", "mismatch"), ("z", "missing")]
    assert {r["type"]: r["status"] for r in control.determinism_status(report, ["type"]).collect()} == {"m": "pass", "t": "fail"}


def test_map_snapshot_and_artifacts(spark, tmp_path):
    frames = spark.createDataFrame([(1, [1.0] * 16, [[1.0, 2.0]], [[0.5, 0.5]], [0.5, 0.5]), (0, [0.0] * 16, [], [], [0.0, 0.0])], "frame_id long, pose array<double>, keypoints array<array<double>>, descriptors array<array<double>>, hist array<double>")
    place = str(tmp_path / "map")
    sinks.write_map(frames, [[0.0, 1.0], [1.0, 0.0]], place)
    back, vocab = readers.map_snapshot(spark, place)
    assert [r["frame_id"] for r in back.orderBy("frame_id").collect()] == [0, 1] and vocab == [[0.0, 1.0], [1.0, 0.0]]
    with pytest.raises(Exception, match="align"):
        sinks.write_map(frames.withColumn("descriptors", F.array()), [[0.0, 1.0]], str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="nothing to write"):
        sinks.write_map(frames.where("frame_id > 9"), [[0.0, 1.0]], str(tmp_path / "none"))
    for run, extra in (("a", "1"), ("b", "2")):
        for kind in ("metrics", "telemetry"):
            (tmp_path / run / kind).mkdir(parents=True)
        (tmp_path / run / "metrics" / "m.json").write_text('{"recorded_at": "%s", "ate": 1.0}' % extra)
        (tmp_path / run / "telemetry" / "t.json").write_text('{"events": [{"name": "x", "timestamp": "%s", "duration_s": %s}]}' % (extra, extra))
    digests = [readers.run_artifacts(spark, str(tmp_path / r)) for r in ("a", "b")]
    status = {r["name"]: r["status"] for r in control.determinism_report(*digests, ["artifact_type", "name"]).collect()}
    assert status == {"m": "match", "t": "mismatch"}
