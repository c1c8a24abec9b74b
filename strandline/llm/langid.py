"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier per bit, linear in hashed byte n-grams, predicts that bit.  The
language whose codeword has the least weighted logistic loss against the predicted margins wins (bits weigh by how well
they do on the sample), and a text is ambiguous where the runner-up comes close.

Defined results: null and empty texts, and texts without a letter, are ``und`` with score 0 and ambiguous.  Without labelled
rows everything is ``und``.  With one known language every text with a letter is that one.  Rows with null or repeated ids
are predicted like all others, and learned from by row: rows with a null id or lang teach nothing, equal rows count once.
Ties go to the language that sorts first and are ambiguous.  Very long texts are counted whole, slice by slice.  All columns
pass through; those named lang_pred, score or ambiguous are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import hashing
from strandline.llm.learning import crc_mod, sigmoid
from strandline.llm.storage import small_batches

#: Labelled documents that the classifiers are fitted on, at most; dimensions of the hashed n-grams.
TRAIN_LIMIT, DIMS = 4_000, 2_048
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def gram_features(part: pa.RecordBatch, dims: int = DIMS, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Square roots of hashed byte n-gram counts, scaled to length 1, for each row; digits count as one symbol."""
    data, offsets = hashing.raw(part.column(part.schema.get_field_index("text")))
    low = _LOWER[data].astype(np.uint32)
    out = np.zeros((part.num_rows, dims), np.float32)
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    code = np.zeros(len(low), np.uint32)
    for n in range(1, max(orders) + 1):
        code = (code[:-1] if n > 1 else code) * np.uint32(0x01000193) + (low[n - 1 :] + np.uint32(1))
        if n not in orders:
            continue
        slot = ((code ^ np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> shift
        for k in range(part.num_rows):
            a, b = int(offsets[k]), int(offsets[k + 1]) - n + 1
            if b > a:
                out[k] += np.bincount(slot[a:b], minlength=dims)
    np.sqrt(out, out)
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def has_letter(part: pa.RecordBatch) -> np.ndarray:
    column = part.column(part.schema.get_field_index("text"))
    data, offsets = hashing.raw(column)
    seen = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for k in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[k] = any(c.isalpha() for c in column[int(k)].as_py() or "")
    return out


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k rows of +-1: all distinct splits for few classes, else the best of random codes by least distance."""
    if k <= 5:
        n = 2 ** (k - 1) - 1
        return np.array([[1] * n if i == 0 else [1 if (j >> (k - 1 - i)) & 1 == 0 else -1 for j in range(1, n + 1)] for i in range(k)], float)
    rng, best, far = np.random.default_rng(seed), None, -1
    n = int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, n))
        gap = ((n - code @ code.T) / 2 + np.eye(k) * n).min()
        if gap > far and (np.abs(code.sum(0)) < k).all():
            best, far = code, gap
    return best


def fit_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, l2: float = 0.02, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all bit classifiers (the intercept last) and the weight of each bit in decoding."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    goal = ((code[y] + 1) / 2).astype(np.float32)
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    v, t, rate = w.copy(), 1.0, 2.0
    for _ in range(steps):
        new = v - rate * (x.T @ (sigmoid(x @ v) - goal) / len(x) + l2 / len(x) * v)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2  # a plain float, so that all stays in single precision
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    right = (np.sign(x @ w) == code[y]).mean(0)
    return w.astype(float), np.maximum(0.05, right - 0.5) / 0.5


def fit_languages(docs: DataFrame, folds: int = 4, held: int = 2, limit: int = TRAIN_LIMIT) -> dict:
    """Classifiers from at most ``limit`` rows, chosen by hash; a text is learned under the language of its own row only."""
    key = ["doc_id", "lang", "h"]
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != held))
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("h"))
    chosen = rows.select(key).distinct().orderBy(F.xxhash64(*key), *key).limit(limit)
    sample = rows.join(F.broadcast(chosen), key).groupBy(key).agg(F.first("text").alias("text"))  # at most ``limit`` rows of three numbers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch):
                x = gram_features(part)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("lang")), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["lang", "x"])

    found = sample.mapInArrow(task, "lang string, x binary").toPandas()
    langs = sorted(found["lang"].unique())
    model = {"langs": langs}
    if len(langs) > 1:
        x = np.frombuffer(b"".join(found["x"]), np.float16).reshape(len(found), DIMS).astype(np.float32)
        code = codewords(len(langs))
        w, bits = fit_bits(x, np.array([langs.index(v) for v in found["lang"]]), code)
        model |= {"code": code, "w": w, "bits": bits}
    return model


def decode(margins: np.ndarray, code: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Probabilities of the classes from weighted losses."""
    loss = (np.logaddexp(0, -margins[:, None, :] * code[None]) * bits).sum(2)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    return p / p.sum(1, keepdims=True)


def predict_languages(docs: DataFrame, model: dict, close: float = 0.2) -> DataFrame:
    """The rows with lang_pred, score and ambiguous; all columns are kept (those of these names replaced)."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    langs = model["langs"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch):
                ok = has_letter(part) & bool(langs)
                if len(langs) > 1:
                    x = gram_features(part)
                    p = decode(x @ model["w"][:-1] + model["w"][-1], model["code"], model["bits"])
                else:
                    p = np.ones((part.num_rows, max(1, len(langs))))
                first = p.argmax(1)
                top = np.sort(p, axis=1)
                gap = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)
                pred = [langs[i] if o else "und" for i, o in zip(first.tolist(), ok.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(np.where(ok, top[:, -1], 0.0)), pa.array(~ok | (gap < close))], [*part.schema.names, "lang_pred", "score", "ambiguous"])

    kept = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(task, f"{kept}, lang_pred string, score double, ambiguous boolean")
