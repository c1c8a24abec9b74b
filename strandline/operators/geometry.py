"""Two-view geometry in numpy: homographies, essential matrices, triangulation, intrinsics.  Random draws are seeded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def normaliser(p: np.ndarray) -> np.ndarray:
    """Moves the centroid to 0 and the mean distance to sqrt(2)."""
    c = p.mean(0)
    s = np.sqrt(2) / max(1e-12, np.linalg.norm(p - c, axis=1).mean())
    return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def _lift(p: np.ndarray) -> np.ndarray:
    return np.hstack([p, np.ones((len(p), 1))])


def homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least-squares map of a (n, 2) to b, lower right element 1."""
    ta, tb = normaliser(a), normaliser(b)
    x, y = _lift(a) @ ta.T, _lift(b) @ tb.T
    zero = np.zeros_like(x)
    rows = np.vstack([np.hstack([-x, zero, x * y[:, :1]]), np.hstack([zero, -x, x * y[:, 1:2]])])
    h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2]


def transfer(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = _lift(p) @ h.T
    return q[:, :2] / np.where(np.abs(q[:, 2:]) < 1e-12, 1e-12, q[:, 2:])


def essential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Eight-point estimate from normalised image points, with singular values (1, 1, 0)."""
    ta, tb = normaliser(a), normaliser(b)
    x, y = _lift(a) @ ta.T, _lift(b) @ tb.T
    m = (y[:, :, None] * x[:, None, :]).reshape(len(a), 9)
    e = tb.T @ np.linalg.svd(m)[2][-1].reshape(3, 3) @ ta
    u, _, vt = np.linalg.svd(e)
    return u @ np.diag([1.0, 1.0, 0.0]) @ vt


def sampson(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = _lift(a), _lift(b)
    ex, ey = x @ e.T, y @ e
    return (y * ex).sum(1) ** 2 / np.maximum(1e-12, ex[:, 0] ** 2 + ex[:, 1] ** 2 + ey[:, 0] ** 2 + ey[:, 1] ** 2)


def consensus(a: np.ndarray, b: np.ndarray, size: int, fit: Callable, error: Callable, limit: float, seed: int, rounds: int = 2_000, enough: float = 0.8):
    """Random sample consensus: the model refitted on the largest set of inliers, and that set; None below ``size`` pairs."""
    if len(a) < size:
        return None
    rng, best = np.random.default_rng(seed), np.zeros(len(a), bool)
    for _ in range(rounds):
        pick = rng.choice(len(a), size, replace=False)
        try:
            ok = error(fit(a[pick], b[pick]), a, b) < limit
        except np.linalg.LinAlgError:
            continue
        if ok.sum() > best.sum():
            best = ok
            if best.mean() > enough:
                break
    return (fit(a[best], b[best]), best) if best.sum() >= size else None


def robust_homography(a: np.ndarray, b: np.ndarray, seed: int, pixels: float = 3.0):
    def both_ways(h: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.linalg.norm(transfer(h, p) - q, axis=1) + np.linalg.norm(transfer(np.linalg.inv(h), q) - p, axis=1)

    return consensus(a, b, 4, homography, both_ways, pixels, seed)


def robust_essential(a: np.ndarray, b: np.ndarray, seed: int, limit: float = 1e-5):
    return consensus(a, b, 8, essential, sampson, limit, seed)


def triangulate(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Points from two 3x4 projections."""
    out = []
    for (u, v), (s, t) in zip(a, b, strict=True):
        x = np.linalg.svd(np.stack([u * p[2] - p[0], v * p[2] - p[1], s * q[2] - q[0], t * q[2] - q[1]]))[2][-1]
        out.append(x[:3] / (x[3] if abs(x[3]) > 1e-12 else 1e-12))
    return np.array(out)


def pose_from_essential(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The one of four rotations and directions that puts most points before both cameras, and that share."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    w, best = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]]), None
    first = np.hstack([np.eye(3), np.zeros((3, 1))])
    for r in (u @ w @ vt, u @ w.T @ vt):
        for t in (u[:, 2], -u[:, 2]):
            x = triangulate(first, np.hstack([r, t[:, None]]), a, b)
            share = float(((x[:, 2] > 0) & ((x @ r.T + t)[:, 2] > 0)).mean())
            if best is None or share > best[2]:
                best = (r, t, share)
    return best


def adaptive_limit(a: np.ndarray, b: np.ndarray, base: float = 0.01, least: float = 0.005, most: float = 0.02) -> float:
    """base, scaled by the median displacement over 25 (half to double), within limits; no pairs: base."""
    if not len(a):
        return base
    scale = np.clip(np.median(np.linalg.norm(b - a, axis=1)) / 25.0, 0.5, 2.0)
    return float(np.clip(base * scale, least, most))


def pose_from_matches(a: np.ndarray, b: np.ndarray, seed: int, limit: float = 0.01, min_matches: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Rotation, direction, inliers and share before both cameras of normalised points; too few matches, or none that agree,
    are an error."""
    if len(a) < min_matches:
        raise ValueError("too few matches")
    got = robust_essential(a, b, seed, limit * limit)
    if got is None:
        raise ValueError("no essential matrix")
    model, ok = got
    r, t, share = pose_from_essential(model, a[ok], b[ok])
    return r, t, ok, share


@dataclass(frozen=True)
class Selection:
    """How one of two models is chosen, and from how many matches on; the biases weigh the models' scores."""

    min_matches: int = 20
    essential_bias: float = 1.0
    homography_bias: float = 0.9
    min_parallax: float = 1.0
    base_limit: float = 0.01
    least_limit: float = 0.005
    most_limit: float = 0.02


def estimate_pairs(matches: DataFrame, seed: int = 7, camera: list[float] | None = None, how: Selection = Selection()) -> DataFrame:
    """matches(pair, ua, va, ub, vb), one image pair a group: an essential matrix or a homography, whichever has the larger
    bias times inlier share times parallax (at least min_parallax; essential first of equal ones).

    With a row-major camera matrix the points are pixels, else normalised.  Too few matches, or a model of the two that
    can't be fitted, leave the pair without a pose: method none, and the reason."""
    k = None if camera is None else np.array(camera, float).reshape(3, 3)

    def normal(p: np.ndarray) -> np.ndarray:
        return p if k is None else transfer(np.linalg.inv(k), p)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ua", "va", "ub", "vb"])
        a, b = pdf[["ua", "va"]].to_numpy(float), pdf[["ub", "vb"]].to_numpy(float)
        pair = int(pdf["pair"].iloc[0])
        row = {"pair": pair, "method": "none", "match_count": len(a), "inliers": 0, "inlier_ratio": 0.0, "parallax": 0.0, "cheirality_inliers": 0, "cheirality_ratio": 0.0, "score": 0.0, "failure_reason": None}
        if len(a) < how.min_matches:
            return pd.DataFrame([row | {"failure_reason": "too_few_matches"}])
        draw, apart = (seed * 1_000_003 + pair) % 2**32, np.linalg.norm(b - a, axis=1)
        limit = adaptive_limit(a, b, how.base_limit, how.least_limit, how.most_limit)
        plane = robust_homography(a, b, draw, 0.01 if k is None else 3.0)
        try:
            _, _, ok, share = pose_from_matches(normal(a), normal(b), draw, limit, how.min_matches)
        except ValueError:
            return pd.DataFrame([row | {"failure_reason": "essential_failed"}])
        if plane is None:
            return pd.DataFrame([row | {"failure_reason": "homography_failed"}])
        # A plane's parallax is that of all matches.
        fits = [("essential", ok, float(np.median(apart[ok])), share, how.essential_bias), ("homography", plane[1], float(np.median(apart)), 1.0, how.homography_bias)]
        scored = [(bias * float(m.mean()) * max(p, how.min_parallax), name, m, p, s) for name, m, p, s, bias in fits]
        score, name, m, p, s = max(scored, key=lambda f: f[0])
        n = int(m.sum())
        return pd.DataFrame([row | {"method": name, "inliers": n, "inlier_ratio": float(m.mean()), "parallax": p, "cheirality_inliers": round(s * n), "cheirality_ratio": s, "score": score}])

    return matches.groupBy("pair").applyInPandas(one, "pair long, method string, match_count long, inliers long, inlier_ratio double, parallax double, cheirality_inliers long, cheirality_ratio double, score double, failure_reason string")


def vanishing_focal(lines_a: np.ndarray, lines_b: np.ndarray, centre: tuple[float, float]) -> float | None:
    """Focal length from two orthogonal vanishing points, each the common point of (x1, y1, x2, y2) lines."""
    points = []
    for lines in (lines_a, lines_b):
        rows = [np.cross([x1 - centre[0], y1 - centre[1], 1], [x2 - centre[0], y2 - centre[1], 1]) for x1, y1, x2, y2 in lines]
        v = np.linalg.svd(np.array([r / np.linalg.norm(r) for r in rows]))[2][-1]
        if abs(v[2]) < 1e-12:
            return None
        points.append(v[:2] / v[2])
    square = -float(points[0] @ points[1])
    return float(np.sqrt(square)) if square > 0 else None


def intrinsics(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Camera matrix (last element 1) and offset of a 3x4 projection whose rotation is the identity; as in ``scalars``, the last
    column is taken as it stands."""
    k = p[:, :3] / p[2, 2]
    return k, -np.linalg.solve(k, p[:, 3])
