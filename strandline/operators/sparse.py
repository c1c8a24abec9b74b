"""Large sparse least squares: normal equations and their solution, with matrices and vectors as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandline.lineage import cut


def normal_equations(linearised: DataFrame, residuals: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (i, j, block: size x size row-major) and right sides (i, right) of rows (factor, state, row, col, value, weight) and
    (factor, row, value): the sums of J'WJ and of -J'Wr.

    Where linearised rows name their state's part, blocks have part and part_j, see ``conjugate_gradients``."""
    c = F.col
    part = (c("part") if (near := "part" in linearised.columns) else F.lit(None)).cast("long")
    kind, none = linearised.schema["state"].dataType, F.lit(None)
    rows = linearised.where("state is not null")
    a = rows.select("factor", "row", c("state").alias("i"), part.alias("part"), c("col").alias("r"), (c("value") * c("weight")).alias("u"))
    b = rows.select("factor", "row", c("state").alias("j"), part.alias("part_j"), c("col").alias("c"), c("value").alias("v"))
    # The right side is a column of its own, without a state.
    b = b.union(residuals.select("factor", "row", none.cast(kind).alias("j"), none.cast("long").alias("part_j"), F.lit(0).alias("c"), (-c("value")).alias("v")))
    at, cell = c("r") * size + c("c"), c("u") * c("v")
    cells = [F.coalesce(F.sum(F.when(at == k, cell)), F.lit(0.0)) for k in range(size * size)]
    found = cut(a.join(b, ["factor", "row"]).groupBy("i", "j").agg(F.array(*cells).alias("block"), F.max("part").alias("part"), F.max("part_j").alias("part_j")))
    blocks = found.where("j is not null")
    return blocks if near else blocks.drop("part", "part_j"), found.where("j is null").select("i", F.array(*[c("block")[size * r] for r in range(size)]).alias("right"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _times(block: Column, v: Column, size: int) -> list[Column]:
    return [sum((block[size * r + k] * v[k] for k in range(1, size)), block[size * r] * v[0]) for r in range(size)]


def _plus(a: Column, f: float, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + F.lit(f) * y)


def conjugate_gradients(blocks: DataFrame, right: DataFrame, size: int, tolerance: float = 1e-10, most: int = 500) -> tuple[DataFrame, list[float]]:
    """(i, x) that solves the symmetric positive definite system, and the relative residual after each step.

    The inverted diagonal blocks are the preconditioner.  Each step is one join of the blocks with the direction and one sum by
    row; vectors and blocks stay tables however large the system is, the driver sees three sums, and every step's vectors are
    written to the checkpoint folder, from where a lost executor's part is read again.  Rows without a diagonal block are left as 0.

    Where blocks name the parts of i and j (part, part_j), each part, which one task holds, is solved by itself at first, and
    what couples parts is left to the steps, with these solutions as the preconditioner: parts that nothing couples need none."""
    if "part" in blocks.columns:
        return _by_parts(blocks, right, size, tolerance, most)
    c = F.col
    blocks = cut(blocks.repartition("j"))

    def invert(batches):
        for pdf in batches:
            yield pdf[["i"]].assign(inverse=list(np.linalg.inv(np.stack(pdf["block"]).reshape(-1, size, size)).reshape(-1, size * size)))

    kind = blocks.schema["i"].dataType.simpleString()
    inverse = blocks.where("i = j").select("i", "block").mapInPandas(invert, f"i {kind}, inverse array<double>")
    zero = F.array(*[F.lit(0.0)] * size)
    state = inverse.join(right, "i", "left").select("i", "inverse", F.coalesce("right", zero).alias("r"), zero.alias("x"))
    state = state.withColumn("z", F.array(*_times(c("inverse"), c("r"), size))).withColumn("p", c("z"))
    seen = Observation()
    state = cut(state.observe(seen, F.coalesce(F.sum(_dot(c("r"), c("z"))), F.lit(0.0)).alias("rz"), F.coalesce(F.sum(_dot(c("r"), c("r"))), F.lit(0.0)).alias("rr")))
    rz, whole = seen.get["rz"], seen.get["rr"] ** 0.5
    found: list[float] = []
    while whole and len(found) < most and (not found or found[-1] > tolerance):
        sums = [F.sum(t).alias(f"q{k}") for k, t in enumerate(_times(c("block"), c("p"), size))]
        q = blocks.join(state.select(c("i").alias("j"), "p"), "j").groupBy("i").agg(*sums)
        seen = Observation()
        moved = state.join(q, "i").withColumn("q", F.array(*[c(f"q{k}") for k in range(size)])).drop(*[f"q{k}" for k in range(size)])
        moved = cut(moved.observe(seen, F.sum(_dot(c("p"), c("q"))).alias("pq")))
        step = rz / seen.get["pq"]
        seen = Observation()
        moved = moved.withColumn("x", _plus(c("x"), step, c("p"))).withColumn("r", _plus(c("r"), -step, c("q"))).withColumn("z", F.array(*_times(c("inverse"), c("r"), size))).drop("q")
        moved = cut(moved.observe(seen, F.sum(_dot(c("r"), c("z"))).alias("rz"), F.sum(_dot(c("r"), c("r"))).alias("rr")))
        state = moved.withColumn("p", _plus(c("z"), seen.get["rz"] / rz, c("p")))
        rz = seen.get["rz"]
        found.append(seen.get["rr"] ** 0.5 / whole)
        if not rz:
            break
    return state.select("i", "x"), found


#: A part is solved up to this share of its right side, in at most so many steps; the steps over all parts do the rest.
SHARP, STEPS = 1e-15, 2_000


def solved(rows: np.ndarray, cols: np.ndarray, blocks: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (n, size) of one part's blocks (at rows and cols, with all on the diagonal), and what it leaves of the right side."""
    n, size = right.shape
    times = lambda v: np.stack([np.bincount(rows, (blocks[:, r] * v[cols]).sum(1), n) for r in range(size)], 1)
    inverse, on = np.empty((n, size, size)), rows == cols
    inverse[rows[on]] = np.linalg.inv(blocks[on])
    x, r, p, last, goal = np.zeros_like(right), right.copy(), np.zeros_like(right), 0.0, SHARP * np.linalg.norm(right)
    for _ in range(STEPS):
        if np.linalg.norm(r) <= goal:
            break
        z = np.einsum("nij,nj->ni", inverse, r)
        rz = float((r * z).sum())
        p = z + (rz / last if last else 0.0) * p
        q = times(p)
        step = rz / float((p * q).sum())
        x, r, last = x + step * p, r - step * q, rz
    return x, right - times(x)


def _within(blocks: DataFrame, rights: DataFrame, size: int) -> DataFrame:
    """(i, part, b, x, r) of rights (part, i, v): each part's solution, and what it leaves within the part."""
    kind = blocks.schema["i"].dataType.simpleString()
    rows = blocks.where("part = part_j").select("part", "i", "j", "block").union(rights.select("part", "i", F.lit(None).cast(kind), "v"))

    def one(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own = pc.is_null(table["j"])
        mats, vectors = table.filter(pc.invert(own)), table.filter(own)
        flat = lambda t, name, *shape: np.asarray(pc.list_flatten(t[name])).reshape(len(t), *shape)
        i, j, cells = np.asarray(mats["i"]), np.asarray(mats["j"]), flat(mats, "block", size, size)
        ids = np.unique(i[i == j])
        find = lambda x: np.minimum(np.searchsorted(ids, x), max(len(ids) - 1, 0))
        known = lambda x: ids[find(x)] == x if len(ids) else np.zeros(len(x), bool)
        keep, given = known(i) & known(j), np.asarray(vectors["i"])
        b, on = np.zeros((len(ids), size)), known(given)
        b[find(given)[on]] = flat(vectors, "block", size)[on]
        x, r = solved(find(i)[keep], find(j)[keep], cells[keep], b)
        lists = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, size, dtype=np.int32), m.ravel())
        return pa.table({"i": pa.array(ids, table["i"].type), "part": np.full(len(ids), table["part"][0].as_py(), np.int64), "b": lists(b), "x": lists(x), "r": lists(r)})

    return rows.groupBy("part").applyInArrow(one, f"i {kind}, part long, b array<double>, x array<double>, r array<double>")


def _by_parts(blocks: DataFrame, right: DataFrame, size: int, tolerance: float, most: int) -> tuple[DataFrame, list[float]]:
    c = F.col
    places = blocks.where("i = j").select("i", "part")
    whole = Observation()
    dots = lambda seen, df, **pairs: df.observe(seen, *[F.coalesce(F.sum(_dot(c(a), c(b))), F.lit(0.0)).alias(k) for k, (a, b) in pairs.items()])
    state = cut(dots(whole, _within(blocks, places.join(right, "i").select("part", "i", c("right").alias("v")), size), bb=("b", "b"), rr=("r", "r")))
    size_b, rr = whole.get["bb"] ** 0.5, whole.get["rr"]

    def product(entries: DataFrame, name: str, to: str) -> DataFrame:
        """The state with the product of entries and a vector of it."""
        sums = [F.sum(t).alias(f"q{k}") for k, t in enumerate(_times(c("block"), c(name), size))]
        q = entries.join(state.select(c("i").alias("j"), name), "j").groupBy("i").agg(*sums)
        q = q.select("i", F.array(*[c(f"q{k}") for k in range(size)]).alias(to))
        return state.join(q, "i", "left").withColumn(to, F.coalesce(to, F.array(*[F.lit(0.0)] * size)))

    across = blocks.where("part <> part_j")
    if size_b and not across.isEmpty():
        seen = Observation()
        state = cut(dots(seen, product(across, "x", "q").withColumn("r", _plus(c("r"), -1.0, c("q"))).drop("q"), rr=("r", "r")))
        rr = seen.get["rr"]
    found = [rr**0.5 / size_b] if size_b else []
    if not found or found[-1] <= tolerance:
        return state.select("i", "x"), found
    blocks = cut(blocks.repartition("j"))
    again = lambda df: df.join(_within(blocks, df.select("part", "i", c("r").alias("v")), size).select("i", c("x").alias("z")), "i")
    seen = Observation()
    state = cut(dots(seen, again(state.drop("b")), rz=("r", "z"))).withColumn("p", c("z"))
    rz = seen.get["rz"]
    while rz and len(found) <= most and found[-1] > tolerance:
        seen = Observation()
        state = cut(dots(seen, product(blocks, "p", "q"), pq=("p", "q")))
        step = rz / seen.get["pq"]
        state = cut(state.withColumn("x", _plus(c("x"), step, c("p"))).withColumn("r", _plus(c("r"), -step, c("q"))).drop("z"))
        seen = Observation()
        state = cut(dots(seen, again(state), rz=("r", "z"), qz=("q", "z"), rr=("r", "r")))
        # Parts are solved nearly, so the next direction is made conjugate by the products as they are.
        state = state.withColumn("p", _plus(c("z"), -step * seen.get["qz"] / rz, c("p"))).drop("q")
        rz = seen.get["rz"]
        found.append(seen.get["rr"] ** 0.5 / size_b)
    return state.select("i", "x"), found
