"""Small linear models, fitted on bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n, F.lit(0))


def labelled_ids(labels: DataFrame, label: str, folds: int, held: int, limit: int) -> DataFrame:
    """doc_id, y of at most ``limit`` labelled ids outside the held-out fold, chosen by hash of id."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != held))
    ids = ids.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def one_row_each(docs: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of one document for each id (rows ``ids``, few enough for a broadcast): of rows that repeat an id, the one
    of least hash.  So the result has no more rows than ``ids``."""
    some = docs.select("doc_id", F.struct(*columns).alias("x")).join(F.broadcast(ids), "doc_id")
    keys = [c for c in ids.columns]
    return some.groupBy(*keys).agg(F.min_by("x", F.xxhash64("x")).alias("x")).select(*keys, "x.*")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, limit: int) -> DataFrame:
    """doc_id, text, y of at most ``limit`` labelled documents outside the held-out fold, one row for each id."""
    return one_row_each(docs, labelled_ids(labels, label, folds, held, limit), ["text"])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, weight: np.ndarray | None = None, steps: int = 200) -> np.ndarray:
    """Weights with the intercept last; Newton steps for few features, accelerated gradient steps for many."""
    x = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    s = np.ones(len(x)) if weight is None else weight
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    if not len(x):
        return w
    if x.shape[1] <= 64:
        for _ in range(30):
            p = sigmoid(x @ w)
            step = np.linalg.solve((x * (s * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (s * (p - y)) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        return w
    bound = 0.25 * np.linalg.norm(x * np.sqrt(s)[:, None], 2) ** 2 + l2
    v, t = w.copy(), 1.0
    for _ in range(steps):
        new = v - (x.T @ (s * (sigmoid(x @ v) - y)) + ridge * v) / bound
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w
