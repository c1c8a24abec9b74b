"""Trajectories: steps, similarity alignment, absolute and relative errors, pose prefix products, keyframes."""

from __future__ import annotations

from collections.abc import Callable
from math import acos, degrees, dist, isfinite
from operator import mul

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.lineage import cut
from strandline.operators import scans
from strandline.operators.machines import fold_rows


def positions(df: DataFrame, pose: str = "pose", axes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    if any(a not in (0, 1, 2) for a in axes):
        raise ValueError("axes are 0, 1 and 2")
    return df.select("*", *[F.col(pose)[4 * a + 3].alias("xyz"[a]) for a in axes])


def _norm(columns: list[Column]) -> Column:
    return F.sqrt(sum((c * c for c in columns[1:]), columns[0] * columns[0]))


def steps(df: DataFrame, keys: list[str], order: str, axes: list[str], lag: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("step", _norm([F.col(a) - F.lag(a, lag).over(w) for a in axes]))


def summary(df: DataFrame, keys: list[str], order: str, axes: list[str]) -> DataFrame:
    """Poses, path length, mean and largest step; keys with one pose are left out."""
    return steps(df, keys, order, axes).groupBy(*keys).agg(F.count("*").alias("num_poses"), F.sum("step").alias("path_length"), F.avg("step").alias("mean_step"), F.max("step").alias("max_step")).where("num_poses > 1")


def align_2d(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """theta, scale and offset that map (ex, ey) onto (gx, gy), from one aggregate of first and second moments.

    Null scale where the estimate does not move."""
    c = F.col
    m = pairs.groupBy(*keys).agg(*[F.avg(c(x)).alias(f"m_{x}") for x in ("gx", "gy", "ex", "ey")], *[F.avg(c(g) * c(e)).alias(f"{g}{e}") for g in ("gx", "gy") for e in ("ex", "ey")], F.avg(c("ex") * c("ex") + c("ey") * c("ey")).alias("ee"))
    a, b, d, e = (c(f"{g}{x}") - c(f"m_{g}") * c(f"m_{x}") for g in ("gx", "gy") for x in ("ex", "ey"))
    m = m.withColumns({"a": a, "b": b, "c": d, "d": e, "var": c("ee") - c("m_ex") * c("m_ex") - c("m_ey") * c("m_ey")})
    spread = F.greatest(_norm([c("a") + c("d"), c("c") - c("b")]), _norm([c("a") - c("d"), c("b") + c("c")]))
    m = m.withColumn("theta", F.atan2(c("c") - c("b"), c("a") + c("d"))).withColumn("scale", F.when(c("var") > 1e-12, spread / c("var")))
    cos, sin = F.cos("theta"), F.sin("theta")
    return m.withColumn("tx", c("m_gx") - c("scale") * (cos * c("m_ex") - sin * c("m_ey"))).withColumn("ty", c("m_gy") - c("scale") * (sin * c("m_ex") + cos * c("m_ey"))).select(*keys, "theta", "scale", "tx", "ty")


def aligned_2d(pairs: DataFrame, keys: list[str]) -> DataFrame:
    fit = align_2d(pairs, keys)
    c, cos, sin = F.col, F.cos("theta"), F.sin("theta")
    out = pairs.join(fit, keys)
    return out.withColumn("ax", c("scale") * (cos * c("ex") - sin * c("ey")) + c("tx")).withColumn("ay", c("scale") * (sin * c("ex") + cos * c("ey")) + c("ty"))


def error_stats(pairs: DataFrame, keys: list[str], order: str = "idx", delta: int = 1) -> DataFrame:
    """Absolute and delta-lag relative error (RMSE, mean, median) after alignment; null where there is no pair at that lag."""
    c, w = F.col, Window.partitionBy(*keys).orderBy(order)
    rows = aligned_2d(pairs, keys)
    rows = rows.withColumn("ate", _norm([c("gx") - c("ax"), c("gy") - c("ay")]))
    lead = lambda x: F.lead(x, delta).over(w) - c(x)
    rows = rows.withColumn("rpe", _norm([lead("gx") - lead("ax"), lead("gy") - lead("ay")]))
    stats = [f(x).alias(f"{x}_{n}") for x in ("ate", "rpe") for n, f in (("rmse", lambda x: F.sqrt(F.avg(c(x) * c(x)))), ("mean", F.avg), ("median", F.median))]
    return rows.groupBy(*keys).agg(F.count("*").alias("num_pairs"), *stats)


def macro_average(long: DataFrame) -> DataFrame:
    """Mean of each metric over the sequences that have it."""
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("metric").agg(F.avg("value").alias("value"), F.count("*").alias("sequences"))


def align_matrix(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, float | None]:
    """Rotation, offset and scale of any dimension by SVD; on reflection the last axis turns and the scale keeps its sign."""
    ms, md = src.mean(0), dst.mean(0)
    u, s, vt = np.linalg.svd((dst - md).T @ (src - ms) / len(src))
    if np.linalg.det(u @ vt) < 0:
        vt[-1] *= -1
    r, var = u @ vt, ((src - ms) ** 2).sum() / len(src)
    scale = s.sum() / var if var > 1e-12 else None
    return r, md - (scale or 0) * r @ ms, scale


def alignments(pairs: DataFrame, keys: list[str], truth: list[str], estimate: list[str]) -> DataFrame:
    """keys, turn (row-major), shift and scale that map each key's estimate onto its truth, in any dimension.

    Cross-covariances are merged from tasks, whose number no sequence limits; only the small matrix of each key is decomposed.  On
    reflection the last axis turns and the scale keeps its sign; the scale is null where the estimate doesn't move."""
    d, c = len(truth), F.col
    cov = [F.coalesce(F.covar_pop(c(g), c(e)), F.lit(0.0)).alias(f"_c{i}_{j}") for i, g in enumerate(truth) for j, e in enumerate(estimate)]
    var = sum((F.var_pop(e) for e in estimate[1:]), F.var_pop(estimate[0])).alias("_var")
    means = [F.avg(x).alias(f"_{k}{i}") for k, names in (("g", truth), ("e", estimate)) for i, x in enumerate(names)]
    moments = pairs.groupBy(*keys).agg(*cov, var, *means)
    kept = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def solve(batches):
        for pdf in batches:
            m = pdf[[f"_c{i}_{j}" for i in range(d) for j in range(d)]].to_numpy(float).reshape(-1, d, d)
            u, s, vt = np.linalg.svd(m)
            vt[np.linalg.det(u @ vt) < 0, -1] *= -1
            r, spread = u @ vt, pdf["_var"].to_numpy(float)
            moves = spread > 1e-12
            scale = np.where(moves, s.sum(1), 0) / np.where(moves, spread, 1)
            shift = pdf[[f"_g{i}" for i in range(d)]].to_numpy(float) - scale[:, None] * np.einsum("nij,nj->ni", r, pdf[[f"_e{i}" for i in range(d)]].to_numpy(float))
            yield pdf[keys].assign(turn=list(r.reshape(-1, d * d)), shift=list(shift), scale=[float(x) if ok else None for x, ok in zip(scale, moves, strict=True)])

    return moments.mapInPandas(solve, f"{kept}, turn array<double>, shift array<double>, scale double")


def aligned_errors(pairs: DataFrame, keys: list[str], order: str, truth: list[str], estimate: list[str], lag: Column | int = 1) -> DataFrame:
    """keys, scale, ate, rpe of each row, rpe null for the last ``lag``: rows meet the one ``lag`` places on by their number, so
    that no task holds or sorts a sequence."""
    d, c = len(truth), F.col
    fit = alignments(pairs, keys, truth, estimate)
    rows = scans.numbered(pairs.withColumn("_lag", F.lit(lag) if isinstance(lag, int) else lag), keys, [order], "_place")
    rows = scans.same_keys(rows, fit, keys)
    turned = lambda i: sum((c("turn")[d * i + j] * c(e) for j, e in enumerate(estimate[1:], 1)), c("turn")[d * i] * c(estimate[0]))
    off = [c(g) - (c("scale") * turned(i) + c("shift")[i]) for i, g in enumerate(truth)]
    rows = rows.select(*keys, "_place", "_lag", "scale", *[o.alias(f"_d{i}") for i, o in enumerate(off)])
    later = rows.select(*keys, (c("_place") - c("_lag")).alias("_place"), *[c(f"_d{i}").alias(f"_l{i}") for i in range(d)])
    rows = scans.same_keys(rows, later, [*keys, "_place"], "left")
    return rows.select(*keys, "scale", _norm([c(f"_d{i}") for i in range(d)]).alias("ate"), _norm([c(f"_l{i}") - c(f"_d{i}") for i in range(d)]).alias("rpe"))


def errors_3d(pairs: DataFrame, keys: list[str], delta: int = 1) -> DataFrame:
    """Errors of (idx, gx, gy, gz, ex, ey, ez) rows; null where the estimate doesn't move or no pair is at that lag."""
    rows = aligned_errors(pairs, keys, "idx", ["gx", "gy", "gz"], ["ex", "ey", "ez"], delta)
    rms = lambda x: F.sqrt(F.avg(F.col(x) * F.col(x)))
    return rows.groupBy(*keys).agg(F.first("scale").alias("scale"), rms("ate").alias("ate_rmse"), rms("rpe").alias("rpe_rmse"))


#: Names of a trajectory's error metrics.
ERROR_NAMES = ("ATE_RMSE", "ATE_MEAN", "ATE_MEDIAN", "RPE_RMSE", "RPE_MEAN", "RPE_MEDIAN")


def error_report(pairs: DataFrame) -> DataFrame:
    """sequence and its six error metrics, of rows (sequence, idx, g, e, delta) with positions of any one dimension.

    Without a pair at that lag the relative errors are null, and all are where the estimate doesn't move."""
    d = pairs.agg(F.max(F.size("g"))).first()[0] or 1
    names = {k: [f"{k}{i}" for i in range(d)] for k in "ge"}
    rows = pairs.select("sequence", "idx", "delta", *[F.col(k)[i].cast("double").alias(n) for k, ns in names.items() for i, n in enumerate(ns)])
    rows = aligned_errors(rows, ["sequence"], "idx", names["g"], names["e"], F.col("delta"))
    found = cut(rows.select("sequence", "ate", "rpe"))
    out = found.groupBy("sequence").agg(*[f(x).alias(f"{x}_{n}".upper()) for x in ("ate", "rpe") for n, f in (("rmse", lambda x: F.sqrt(F.avg(F.col(x) * F.col(x)))), ("mean", F.avg))])
    for x in ("ate", "rpe"):
        out = scans.same_keys(out, scans.exact_quantiles(found, ["sequence"], x, {f"{x}_median".upper(): 0.5}), ["sequence"], "left")
    return out.select("sequence", *ERROR_NAMES)


def compose_2d(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Prefix product of planar motions (dx, dy, dyaw): headings are running sums, so positions are too."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    h = df.withColumn("h", F.coalesce(F.sum("dyaw").over(before), F.lit(0.0)))
    x, y = F.cos("h") * F.col("dx") - F.sin("h") * F.col("dy"), F.sin("h") * F.col("dx") + F.cos("h") * F.col("dy")
    return h.withColumns({"x": F.sum(x).over(upto), "y": F.sum(y).over(upto), "yaw": F.col("h") + F.col("dyaw")}).drop("h")


def compose_matrices(df: DataFrame, key: str, order: str, motion: str = "pose") -> DataFrame:
    """Prefix products of 4x4 row-major motions, of sequences of any length."""
    return scans.prefix_products(df, key, order, motion)


def keyframe_test(far: float = 0.1, turn_deg: float = 5.0, least_match: float = 0.25) -> tuple[Callable, Callable]:
    """Start and step of the greedy choice against the last keyframe: moved, turned, or matched too little.  Between rigid poses the
    distance is that of their places, and the turn follows from the sum of the products of their rotations' cells."""

    def step(last: list, *row: float) -> bool:
        *now, match = row
        take = not last
        if last:
            trace = sum(map(mul, last[:9], now))
            turn = degrees(acos(max(-1.0, min(1.0, (trace - 1) / 2))))
            take = dist(last[9:], now[9:]) >= far or turn >= turn_deg or match <= least_match
        if take:
            last[:] = now
        return take

    return list, step


#: The cells of a row-major pose that make its rotation, then those of its place.
POSE_CELLS = (0, 1, 2, 4, 5, 6, 8, 9, 10, 3, 7, 11)


def keyframes(df: DataFrame, key: str, order: str, far: float = 0.1, turn_deg: float = 5.0, least_match: float = 0.25) -> DataFrame:
    """keyframe of rows (pose, the 16 row-major numbers of a rigid motion; match_ratio), see ``keyframe_test``."""
    rows = df.select(key, order, *[F.col("pose")[i].cast("double").alias(f"_c{i}") for i in POSE_CELLS], F.col("match_ratio").cast("double").alias("match_ratio"))
    return fold_rows(rows, key, order, [*[f"_c{i}" for i in POSE_CELLS], "match_ratio"], *keyframe_test(far, turn_deg, least_match), "keyframe", "boolean")


def planar_pose(x: Column, y: Column, yaw: Column) -> Column:
    """A pose of 16 numbers that turns about the third axis."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(F.cos(yaw), -F.sin(yaw), zero, x, F.sin(yaw), F.cos(yaw), zero, y, zero, zero, one, zero, zero, zero, zero, one)


def clamping(most_deg: float = 5.0) -> tuple[Callable, Callable]:
    """Start and step of a yaw held within a step of the one before; yaws that are null or not finite are skipped."""

    def step(last: list, yaw: float | None) -> float | None:
        if yaw is None or not isfinite(yaw):
            return None
        last[:] = [yaw if not last else last[0] + max(-most_deg, min(most_deg, (yaw - last[0] + 180) % 360 - 180))]
        return last[0]

    return list, step


def clamp_yaw(df: DataFrame, key: str, order: str, most_deg: float = 5.0) -> DataFrame:
    """yaw, held as ``clamping`` says."""
    return fold_rows(df, key, order, ["yaw"], *clamping(most_deg), "yaw", "double")
