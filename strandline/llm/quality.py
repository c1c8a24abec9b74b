"""Quality scores by co-training of a text view and a page-metadata view.

The text view is hashed byte n-grams.  The metadata view is what is known about a page without its words: source, language
tag, length, line count, mean and longest line, share of characters that are neither letters nor spaces, repeated lines.
Each round both classifiers are fitted; each then labels, for the other, the unlabelled sample documents it is surest of,
a share of the pool at most and none below odds of 9 to 1.
The two are calibrated on labelled documents set aside, and their calibrated log odds are added by the weights of a last
small model.  All documents are scored; only the fit uses samples, whose bounds are parameters.

Defined results: null text counts as empty; null source, language or length are values of their own.  Very long texts are
counted whole, slice by slice.  Without labels of both kinds every score is the share of label 1, or 0.5.  Rows with null or
repeated ids are scored like all others; of rows that repeat an id, one is learned from; of repeated labels, the largest
counts.  Ties need no order, as each row is scored by itself.  Columns other than the five are not read, so clashing names do
no harm.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import hashing
from strandline.llm.langid import gram_features
from strandline.llm.learning import crc_mod, fit_logistic, labelled_ids, one_row_each, sigmoid
from strandline.llm.storage import small_batches

#: Log odds from which on a pseudo-label counts as confident (odds of 9 to 1).
SURE = 2.2
#: Labelled and unlabelled documents of the fit, at most; dimensions of the views; rounds, and pseudo-labels of a round.
LABELLED, UNLABELLED, TEXT_DIMS, META_DIMS, ROUNDS, SHARE = 3_000, 3_000, 512, 56, 4, 0.05
_WORDY = np.zeros(256, bool)
_WORDY[[0x20, *range(0x09, 0x0E), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def metadata_features(part: pa.RecordBatch) -> np.ndarray:
    names = part.schema.names
    data, offsets = hashing.raw(part.column(names.index("text")))
    out = np.zeros((part.num_rows, META_DIMS), np.float32)
    other = np.concatenate([[0], np.cumsum(~_WORDY[data])])
    size = np.diff(offsets)
    column = {c: part.column(names.index(c)).to_pylist() for c in ("source", "lang", "n_chars")}
    for k in range(part.num_rows):
        lines = data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n")
        lengths = [len(x) for x in lines]
        n = column["n_chars"][k]
        out[k, :8] = [np.log1p(n) / 10 if n is not None and n >= 0 else 0, np.log1p(len(lines)) / 5, np.log1p(np.mean(lengths)) / 8, np.log1p(max(lengths)) / 10, (other[offsets[k + 1]] - other[offsets[k]]) / max(1, size[k]), 1 - len(set(lines)) / len(lines), n is None, size[k] == 0]
        for c, base, width in (("source", 8, 32), ("lang", 40, 16)):
            raw = np.frombuffer(str(column[c][k]).encode() or b"-", np.uint8).astype(np.uint64)
            out[k, base + int(hashing.mix(np.array([(raw * hashing._POW[: len(raw)]).sum(dtype=np.uint64)]))[0] % np.uint64(width))] = 0.5
    return out


def _views(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch):
                x = np.hstack([gram_features(part, TEXT_DIMS), metadata_features(part)]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("y")), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    found = rows.mapInArrow(task, "y int, x binary").toPandas()
    x = np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, TEXT_DIMS + META_DIMS)
    return x[:, :TEXT_DIMS], x[:, TEXT_DIMS:], found["y"].to_numpy(int)


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, text_u: np.ndarray, meta_u: np.ndarray, rounds: int = ROUNDS, share: float = SHARE) -> dict:
    """Weights of both views after the exchange, the calibration of each (slope, offset), and the last model's weights."""
    aside = np.arange(len(y)) % 5 == 0
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    views, pool = [text[~aside], meta[~aside]], [text_u, meta_u]
    given = [(np.zeros(0, int), np.zeros(0, int))] * 2  # what the other view has labelled: numbers in the pool, labels
    w: list[np.ndarray] = []
    for _ in range(rounds + 1):
        w = []
        for v in (0, 1):
            rows, labels = given[v]
            x, goal = np.vstack([views[v], pool[v][rows]]), np.concatenate([y[~aside], labels])
            weight = np.concatenate([np.ones((~aside).sum()), np.full(len(rows), 0.3)])
            w.append(fit_logistic(x, goal, 0.05, weight, steps=120))
        for v in (0, 1):
            z, told = _logit(pool[v], w[v]), given[1 - v]
            order = np.setdiff1d(np.argsort(z), told[0], assume_unique=True)
            order = order[np.argsort(z[order])]
            rate, n = y.mean(), max(1, int(len(z) * share))
            low, high = order[: max(1, int(n * (1 - rate)))], order[len(order) - max(1, int(n * rate)) :]
            low, high = low[z[low] <= -SURE], high[z[high] >= SURE]
            if len(order) > 2 * n:
                given[1 - v] = (np.concatenate([told[0], low, high]), np.concatenate([told[1], np.zeros(len(low), int), np.ones(len(high), int)]))
    on = aside if aside.any() else np.ones(len(y), bool)
    z = [_logit(text[on], w[0]), _logit(meta[on], w[1])]
    calibrated = [fit_logistic(x[:, None], y[on], 0.1) for x in z]
    both = np.stack([c[0] * x + c[1] for c, x in zip(calibrated, z, strict=True)], 1)
    return {"w": w, "calibration": calibrated, "last": fit_logistic(both, y[on], 0.5)}


def combine(model: dict, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = (c[0] * _logit(x, w) + c[1] for c, x, w in zip(model["calibration"], (text, meta), model["w"], strict=True))
    return sigmoid(model["last"][0] * a + model["last"][1] * b + model["last"][2]), sigmoid(a), sigmoid(b)


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> dict:
    """Both views' models from at most LABELLED + UNLABELLED documents, one row for each id."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id")
    free = docs.select("doc_id").where("doc_id is not null").join(known, "doc_id", "left_anti").where(crc_mod("doc_id", folds) != held)
    free = free.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(UNLABELLED)
    both = labelled_ids(labels, "quality", folds, held, LABELLED).union(free.withColumn("y", F.lit(-1)))
    text, meta, y = _views(one_row_each(docs, both, ["text", "source", "lang", "n_chars"]))
    on = y >= 0
    if len(set(y[on])) < 2:
        return {"constant": float(y[on].mean()) if on.any() else 0.5}
    return co_train(text[on], meta[on], y[on], text[~on], meta[~on])


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, text_score, meta_score of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", "n_chars")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch):
                if "constant" in model:
                    found = [np.full(part.num_rows, model["constant"])] * 3
                else:
                    found = combine(model, gram_features(part, TEXT_DIMS), metadata_features(part))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(float)) for x in found)], ["doc_id", "score", "text_score", "meta_score"])

    return docs.mapInArrow(task, "doc_id long, score double, text_score double, meta_score double")
