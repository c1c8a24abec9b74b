"""Pose graphs by damped Gauss-Newton with robust weights and block-Jacobi conjugate gradients; one graph a group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exp_so3(w: np.ndarray) -> np.ndarray:
    t = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    a, b = (np.sin(t) / t, (1 - np.cos(t)) / t**2) if t > 1e-8 else (1.0, 0.5)
    return np.eye(3) + a * k + b * k @ k


def log_so3(r: np.ndarray) -> np.ndarray:
    t = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    if t > np.pi - 1e-4:
        axis = np.sqrt(np.maximum(0, (np.diag(r) + 1) / 2))
        k = int(np.argmax(axis))
        return t * (r[k] + np.eye(3)[k]) / max(1e-12, 2 * axis[k]) / max(1e-12, np.linalg.norm((r[k] + np.eye(3)[k]) / max(1e-12, 2 * axis[k])))
    v = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    return v / 2 if t < 1e-8 else v * t / (2 * np.sin(t))


def wrap(a: float) -> float:
    return (a + np.pi) % (2 * np.pi) - np.pi


def residual_se2(a: np.ndarray, b: np.ndarray, z: np.ndarray) -> np.ndarray:
    c, s, d = np.cos(a[2]), np.sin(a[2]), b[:2] - a[:2]
    return np.array([c * d[0] + s * d[1] - z[0], -s * d[0] + c * d[1] - z[1], wrap(b[2] - a[2] - z[2])])


def residual_se3(a: np.ndarray, b: np.ndarray, z: np.ndarray) -> np.ndarray:
    """States: rotation vector, then position."""
    ra, rb, rz = exp_so3(a[:3]), exp_so3(b[:3]), exp_so3(z[:3])
    return np.concatenate([log_so3(rz.T @ ra.T @ rb), ra.T @ (b[3:6] - a[3:6]) - z[3:6]])


def residual_sim3(a: np.ndarray, b: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A seventh component is the log of scale."""
    ra, rb, rz = exp_so3(a[:3]), exp_so3(b[:3]), exp_so3(z[:3])
    return np.concatenate([log_so3(rz.T @ ra.T @ rb), ra.T @ (b[3:6] - a[3:6]) / np.exp(a[6]) - z[3:6], [b[6] - a[6] - z[6]]])


#: name: residual, size of a state.
FACTORS: dict[str, tuple[Callable, int]] = {"se2": (residual_se2, 3), "se3": (residual_se3, 6), "sim3": (residual_sim3, 7)}


def jacobians(f: Callable, a: np.ndarray, b: np.ndarray, z: np.ndarray, eps: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for side in (0, 1):
        cols = []
        for k in range(len(a)):
            d = np.zeros(len(a))
            d[k] = eps
            hi, lo = (f(a + s * d, b, z) if side == 0 else f(a, b + s * d, z) for s in (1, -1))
            cols.append((hi - lo) / (2 * eps))
        out.append(np.stack(cols, 1))
    return out[0], out[1]


def weight(loss: str, square: float, scale: float) -> float:
    z = square / scale**2
    if loss == "huber":
        return 1.0 if z <= 1 else float(1 / np.sqrt(z))
    if loss == "cauchy":
        return 1 / (1 + z)
    if loss == "tukey":
        return max(1e-12, (1 - z) ** 2) if z <= 1 else 1e-12
    return 1.0


class BlockSystem:
    """Sparse symmetric blocks; solves by conjugate gradients with the inverted diagonal blocks as preconditioner."""

    def __init__(self, n: int, size: int):
        self.blocks: dict[tuple[int, int], np.ndarray] = {}
        self.right, self.n, self.size = np.zeros((n, size)), n, size

    def add(self, i: int, j: int, block: np.ndarray) -> None:
        self.blocks[i, j] = self.blocks.get((i, j), 0) + block

    def times(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for (i, j), block in self.blocks.items():
            out[i] += block @ x[j]
        return out

    def solve(self, tolerance: float = 1e-10, most: int = 500) -> np.ndarray:
        inverse = {i: np.linalg.inv(self.blocks[i, i]) for i in range(self.n) if (i, i) in self.blocks}
        apply = lambda r: np.stack([inverse[i] @ r[i] if i in inverse else r[i] for i in range(self.n)])
        x, r = np.zeros_like(self.right), self.right.copy()
        z = apply(r)
        p, rz = z.copy(), float((r * z).sum())
        for _ in range(most):
            if np.linalg.norm(r) <= tolerance * max(1.0, np.linalg.norm(self.right)):
                break
            q = self.times(p)
            step = rz / max(1e-300, float((p * q).sum()))
            x, r = x + step * p, r - step * q
            z = apply(r)
            new = float((r * z).sum())
            p, rz = z + new / rz * p, new
        return x


def solve(states: np.ndarray, edges: list[tuple[int, int, np.ndarray, float]], kind: str = "se2", loss: str = "huber", scale: float = 1.0, damping: float = 1e-6, most: int = 20) -> tuple[np.ndarray, list[float]]:
    """Optimised states, the first one held, and the cost before each step and at the end.  Steps that do not lower the cost
    are taken back with ten times the damping."""
    f, size = FACTORS[kind]
    edges = sorted(edges, key=lambda e: (e[0], e[1], e[3], tuple(e[2])))
    cost = lambda x: float(sum(w * (lambda r: weight(loss, r @ r, scale) * (r @ r))(f(x[i], x[j], z)) for i, j, z, w in edges))
    x, costs = states.astype(float).copy(), []
    for _ in range(most):
        system = BlockSystem(len(x), size)
        for i, j, z, w in edges:
            r = f(x[i], x[j], z)
            w = w * max(1e-12, weight(loss, float(r @ r), scale))
            ja, jb = jacobians(f, x[i], x[j], z)
            for p, jp in ((i, ja), (j, jb)):
                if p == 0:
                    continue
                system.right[p] -= w * jp.T @ r
                for q, jq in ((i, ja), (j, jb)):
                    if q != 0:
                        system.add(p, q, w * jp.T @ jq)
        for i in range(1, len(x)):
            system.add(i, i, damping * np.eye(size))
        costs.append(cost(x))
        step = system.solve()
        step[0] = 0
        if cost(x + step) > costs[-1] + 1e-15:
            damping *= 10
            if damping > 1e6:
                break
            continue
        x = x + step
        if np.linalg.norm(step) < 1e-9:
            break
    return x, [*costs, cost(x)]


def well_conditioned(states: np.ndarray, edges: list, kind: str, most: float = 1e8) -> bool:
    f, size = FACTORS[kind]
    h = np.zeros((len(states) * size,) * 2)
    for i, j, z, w in edges:
        ja, jb = jacobians(f, states[i], states[j], z)
        full = np.zeros((size, len(h)))
        full[:, i * size : (i + 1) * size], full[:, j * size : (j + 1) * size] = ja, jb
        h += w * full.T @ full
    h = h[size:, size:] + 1e-9 * np.eye(len(h) - size)
    return bool(np.isfinite(h).all() and (np.diag(h) > 1e-12).all() and np.linalg.cond(h) <= most)


def supervised(states: np.ndarray, edges: list, kind: str, attempts: int = 3) -> tuple[np.ndarray, str, int, list[float]]:
    """Up to three attempts from the same start, with wider loss and more damping each time; ill-conditioned graphs stay."""
    if not well_conditioned(states, edges, kind):
        return states, "ill_conditioned", 0, []
    for k, wider in enumerate((1.0, 1.5, 2.0)[:attempts]):
        x, costs = solve(states, edges, kind, scale=wider, damping=1e-6 * 2**k)
        if np.isfinite(x).all() and costs[-1] <= costs[0] + 1e-12:
            return x, "converged", k + 1, costs
    return states, "failed", attempts, costs


#: Solvers by name: (states, edges, kind) to states, status, attempts and costs.  Others can be registered.
SOLVERS: dict[str, Callable] = {"gauss_newton": supervised}


def register_solver(name: str, solver: Callable) -> None:
    """Makes a solver known to ``optimise_graphs``; names are taken once."""
    if name in SOLVERS:
        raise ValueError(f"a solver has that name: {name}")
    SOLVERS[name] = solver


def optimise_graphs(vertices: DataFrame, edges: DataFrame, kind: str = "se2", solver: str = "gauss_newton") -> DataFrame:
    """vertices(graph_id, id, state array), edges(graph_id, i, j, meas array, weight): optimised states, costs and status."""
    if solver not in SOLVERS:
        raise ValueError(f"no solver of that name: {solver}")
    run = SOLVERS[solver]

    def one(key: tuple, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("id")
        place = {i: k for k, i in enumerate(v["id"])}
        rows = [(place[i], place[j], np.asarray(z, float), float(w)) for i, j, z, w in zip(e["i"], e["j"], e["meas"], e["weight"], strict=True) if i in place and j in place]
        if not len(v):
            return pd.DataFrame(columns=["graph_id", "id", "state", "status", "first_cost", "last_cost"])
        x, status, _, costs = run(np.array(v["state"].tolist(), float), rows, kind)
        return pd.DataFrame({"graph_id": key[0], "id": v["id"], "state": x.tolist(), "status": status, "first_cost": costs[0] if costs else None, "last_cost": costs[-1] if costs else None})

    return vertices.groupBy("graph_id").cogroup(edges.groupBy("graph_id")).applyInPandas(one, "graph_id long, id long, state array<double>, status string, first_cost double, last_cost double")


def se2_residuals(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Residuals of planar edges as expressions over two joins, for graphs of any size: vertices(graph_id, id, x, y, yaw)."""
    side = lambda s: vertices.select("graph_id", F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("x", "y", "yaw")])
    e = edges.join(side("i"), ["graph_id", "i"]).join(side("j"), ["graph_id", "j"])
    cos, sin, dx, dy = F.cos("yaw_i"), F.sin("yaw_i"), F.col("x_j") - F.col("x_i"), F.col("y_j") - F.col("y_i")
    turn = F.pmod(F.col("yaw_j") - F.col("yaw_i") - F.col("dyaw") + np.pi, F.lit(2 * np.pi)) - np.pi
    return e.select("graph_id", "i", "j", (cos * dx + sin * dy - F.col("dx")).alias("rx"), (-sin * dx + cos * dy - F.col("dy")).alias("ry"), turn.alias("ryaw"))


def normal_blocks(linearised: DataFrame) -> DataFrame:
    """Sums per block (i, j, row, col) of weighted products of Jacobian entries (factor, block, row, col, value, weight)."""
    a = linearised.select("factor", F.col("block").alias("i"), "row", F.col("col").alias("r"), F.col("value").alias("u"), "weight")
    b = linearised.select("factor", F.col("block").alias("j"), "row", F.col("col").alias("c"), F.col("value").alias("v"))
    return a.join(b, ["factor", "row"]).groupBy("i", "j", "r", "c").agg(F.sum(F.col("u") * F.col("v") * F.col("weight")).alias("value"))


def project(pose: np.ndarray, points: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Pixels of points seen from a pose (rotation vector, offset)."""
    x = points @ exp_so3(pose[:3]).T + pose[3:6]
    return x[:, :2] / np.where(np.abs(x[:, 2:]) < 1e-9, 1e-9, x[:, 2:]) * np.array([k[0, 0], k[1, 1]]) + k[:2, 2]


def bundle_adjust(poses: np.ndarray, points: np.ndarray, seen: np.ndarray, pixels: np.ndarray, k: np.ndarray, scale: float = 1.0, most: int = 30) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Poses (n, 6) and points (m, 3) that lower the Huber cost of observations seen (pose, point) at pixels; the first pose is
    held.  Points are eliminated from each step, so its system is as large as the window of poses."""
    poses, points, damping, eps = poses.astype(float).copy(), points.astype(float).copy(), 1e-3, 1e-6

    def residuals(p: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(pixels, float)
        for i in range(len(p)):
            mine = seen[:, 0] == i
            out[mine] = project(p[i], x[seen[mine, 1]], k) - pixels[mine]
        return out

    def cost(r: np.ndarray) -> float:
        z = (r**2).sum(1) / scale**2
        return float(np.where(z <= 1, z, 2 * np.sqrt(np.maximum(z, 1)) - 1).sum())

    costs = [cost(residuals(poses, points))]
    for _ in range(most):
        r = residuals(poses, points)
        w = 1 / np.maximum(1.0, np.sqrt((r**2).sum(1)) / scale)
        jp, jx = np.empty((len(seen), 2, 6)), np.empty((len(seen), 2, 3))
        for c in range(6):
            d = np.zeros(6)
            d[c] = eps
            jp[:, :, c] = (residuals(poses + d, points) - residuals(poses - d, points)) / (2 * eps)
        for c in range(3):
            d = np.zeros(3)
            d[c] = eps
            jx[:, :, c] = (residuals(poses, points + d) - residuals(poses, points - d)) / (2 * eps)
        n = len(poses) * 6
        a, b = np.zeros((n, n)), np.zeros(n)
        v, g = np.tile(damping * np.eye(3), (len(points), 1, 1)), np.zeros((len(points), 3))
        mixed = np.zeros((len(points), n, 3))
        for o, (i, j) in enumerate(seen):
            s = slice(6 * i, 6 * i + 6)
            a[s, s] += w[o] * jp[o].T @ jp[o]
            b[s] -= w[o] * jp[o].T @ r[o]
            v[j] += w[o] * jx[o].T @ jx[o]
            g[j] -= w[o] * jx[o].T @ r[o]
            mixed[j, s] += w[o] * jp[o].T @ jx[o]
        inverse = np.linalg.inv(v)
        a += damping * np.eye(n) - np.einsum("jac,jcd,jbd->ab", mixed, inverse, mixed)
        b -= np.einsum("jac,jcd,jd->a", mixed, inverse, g)
        step = np.zeros(n)
        step[6:] = np.linalg.solve(a[6:, 6:], b[6:]) if n > 6 else 0
        move = np.einsum("jcd,jd->jc", inverse, g - np.einsum("jac,a->jc", mixed, step))
        new = cost(residuals(poses + step.reshape(-1, 6), points + move))
        if new < costs[-1]:
            poses, points, damping = poses + step.reshape(-1, 6), points + move, damping / 3
            costs.append(new)
            if costs[-2] - new < 1e-12 * max(1.0, new):
                break
        else:
            damping *= 10
            if damping > 1e8:
                break
    return poses, points, costs
