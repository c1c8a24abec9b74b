"""Embedding near-duplicates by an exact metric range join.

On unit vectors a cosine of at least c is a Euclidean distance of at most r = sqrt(2 - 2c).  Exact copies (equality of two
64-bit hashes of the components) become one class with a count.  Then pivots split the vectors of a label: a vector's home is the
cell of its nearest pivot, and it's a guest in each cell of a pivot listed earlier that a vector within r of it may call home.
By the triangle inequality that asks for d(v, p) <= d(v, home) + 2r, and between two pivots of a Euclidean space even for a
distance of at most r to their bisector; both bounds are tried.  So each pair within r meets in exactly one cell, in which at
least one of both is at home.  Cells above ``CELL`` homes are split again by pivots of their own, as long as a sample of
the cell promises fewer comparisons and at most ``COPIES`` copies of a row.  Pivots are fitted on at most ``SAMPLE`` rows of a
cell; they decide speed alone, never results.

A cell then joins by itself.  Homes within r/2 of the pivot are its core: all of them are linked, which a count states without
a comparison.  All else is compared block by block, each pair of blocks in its own group, in double precision; what falls within
1e-12 of c is decided by sums without rounding error.  A group returns each row's links and the root of its local component, never
pairs, so a family of n near copies makes rows in proportion to n.

Defined results: one row for each input row, in any number of tables.  Vectors that are null, empty, zero or hold a null or
non-finite component, and rows with a null label, link with nothing (n_links 0, their own component, kept).  Vectors of
different lengths aren't linked.  Rows that repeat a vec_id are vectors of their own; the smallest vec_id of a component
names it.  A null vec_id takes part, is never smallest and never kept; a component of such rows alone has a null component_id.
Empty tables give empty results; columns but the three named are not read.  A vector is one row of one block, so its length is
bounded by a task's memory over 2 * ``BLOCK``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.llm.storage import Workspace

#: Homes of a cell that isn't split further, and rows of a block.
CELL, BLOCK = 1_024, 1_024
#: Rows of a cell that its pivots are fitted on, pivots of a cell, splits one over the other.
SAMPLE, PIVOTS, LEVELS = 256, 32, 6
#: Numbers that all samples of a level may hold on the driver; further cells wait for the next level.
ON_DRIVER = 1 << 22
#: A split has to promise at most this share of the comparisons, and this many copies of a row over all levels.
GAIN, COPIES = 0.8, 16
SLACK = 1e-6

ROW = "cell string, copies double, node long, mult long, home boolean, core boolean, vec binary"


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by their largest component first, so that no square overflows."""
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = (a / np.abs(a).max()).tolist(), (b / np.abs(b).max()).tolist()
    dot = lambda x, y: math.fsum(p * q for p, q in zip(x, y, strict=True))
    return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))


def spread_pivots(sample: np.ndarray, radius: float, limit: int = PIVOTS) -> np.ndarray:
    """Sample rows in order, leaving out those within 2r of one already taken, each moved to the mean of the rows within r of it."""
    taken: list[np.ndarray] = []
    for v in sample:
        if len(taken) < limit and all(np.dot(v - p, v - p) > 4 * radius * radius for p in taken):
            near = sample[((sample - v) ** 2).sum(axis=1) <= radius * radius]
            taken.append(unit(near.mean(axis=0)[None])[0])
    return np.array(taken)


def assign(units: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home pivot of each row, its distance, and the table of cells that a vector within the radius may call home."""
    d2 = np.maximum(2 - 2 * units @ pivots.T, 0)
    home = d2.argmin(axis=1)
    mine = d2[np.arange(len(units)), home][:, None]
    d = np.sqrt(d2)
    reach = d <= np.sqrt(mine) + 2 * radius + SLACK
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    reach &= d2 - mine <= 2 * (radius + SLACK) * between + SLACK
    return home, np.sqrt(mine[:, 0]), reach


def promise(sample: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[float, float]:
    """Share of the comparisons left after the split, and copies of a row, as the sample shows them."""
    home, _, reach = assign(sample, pivots, radius)
    guest = reach & (np.arange(len(pivots)) < home[:, None])
    homes = np.bincount(home, minlength=len(pivots))
    work = (homes * (homes / 2 + guest.sum(axis=0))).sum()
    return float(work / (len(sample) ** 2 / 2)), float(1 + guest.sum() / len(sample))


def _matrix(column) -> np.ndarray:
    return np.array([np.frombuffer(v.as_buffer(), np.float64) for v in column])


def _classes(vectors: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The rows with the two hashes of their class (null where they link with nothing), and the classes with a number each."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.expr("label is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)")
    keyed = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    keyed = keyed.select("vec_id", "label", "e", *[F.when(F.col("sound"), F.xxhash64(F.lit(k), "label", "e")).alias(f"k{k}") for k in (1, 2)])
    found = keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("e").alias("e"), F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    return keyed.select("vec_id", "k1", "k2"), work.keep(found.withColumn("node", F.monotonically_increasing_id()), "classes")


def _first_cells(classes: DataFrame) -> DataFrame:
    def pack(batches):
        for b in batches:
            vec = [np.array(v, np.float64).tobytes() for v in b.column("e").to_pylist()]
            n = b.num_rows
            cols = {"cell": b.column("cell"), "copies": pa.array([1.0] * n), "node": b.column("node"), "mult": b.column("mult"), "home": pa.array([True] * n), "core": pa.array([False] * n), "vec": pa.array(vec, pa.binary())}
            yield pa.RecordBatch.from_pydict(cols)

    return classes.select(F.concat_ws("|", F.size("e").cast("string"), "label").alias("cell"), "node", "mult", "e").mapInArrow(pack, ROW)


def _samples(rows: DataFrame, cells: list, limit: int) -> dict[str, np.ndarray]:
    """About ``limit`` homes of each of the cells, by hash."""
    spark = rows.sparkSession
    rate = F.broadcast(spark.createDataFrame([(c["cell"], min(1.0, limit / c["homes"])) for c in cells], "cell string, rate double"))
    some = rows.where("home").join(rate, "cell").where((F.xxhash64(F.lit("pivot"), "cell", "node") / F.lit(2.0**64) + 0.5) < F.col("rate"))
    out: dict[str, list] = {}
    for r in some.select("cell", "vec").orderBy(F.xxhash64("node"), "node").limit(2 * limit * len(cells)).toLocalIterator():
        if len(out.setdefault(r["cell"], [])) < limit:
            out[r["cell"]].append(np.frombuffer(r["vec"], np.float64))
    return {k: unit(np.array(v)) for k, v in out.items()}


def _split(rows: DataFrame, pivots: dict[str, np.ndarray], radius: float) -> DataFrame:
    """Rows of the cells with pivots, dealt to the cells below; a guest stays a guest."""

    def deal(batches):
        for b in batches:
            cells, homes = np.array(b.column("cell").to_pylist(), object), b.column("home").to_numpy(zero_copy_only=False)
            copies = b.column("copies").to_numpy(zero_copy_only=False)
            take, cell, home_, core, many = [], [], [], [], []
            for name in dict.fromkeys(cells):
                at = np.flatnonzero(cells == name)
                home, distance, reach = assign(unit(_matrix(b.column("vec").take(pa.array(at)))), pivots[name], radius)
                own = homes[at][:, None] & (np.arange(reach.shape[1]) == home[:, None])
                guest = reach & (~homes[at][:, None] | (np.arange(reach.shape[1]) < home[:, None]))
                x, p = np.nonzero(own | guest)
                take.append(at[x])
                cell += [f"{name}/{k}" for k in p]
                home_.append(own[x, p])
                core.append(own[x, p] & (distance[x] <= radius / 2 - SLACK))
                many.append(copies[at[x]] * (own | guest).sum(axis=1)[x])
            if take:
                at = pa.array(np.concatenate(take))
                cols = {"cell": pa.array(cell, pa.string()), "copies": pa.array(np.concatenate(many)), "node": b.column("node").take(at), "mult": b.column("mult").take(at), "home": pa.array(np.concatenate(home_)), "core": pa.array(np.concatenate(core)), "vec": b.column("vec").take(at)}
                out = pa.RecordBatch.from_pydict(cols)
                for k in range(0, out.num_rows, 1_000):
                    yield out.slice(k, 1_000)

    return rows.mapInArrow(deal, ROW)


def _cells(rows: DataFrame, radius: float, work: Workspace) -> DataFrame:
    """Splits large cells level by level; what can't be split further joins as it is."""
    dim = F.length("vec") / 8
    stuck: list[str] = []
    for level in range(LEVELS):
        found = rows.where("home").groupBy("cell").agg(F.count("*").alias("homes"), F.max(dim).cast("long").alias("dim"), F.avg("copies").alias("copies"))
        found = found.where((F.col("homes") > CELL) & ~F.col("cell").isin(stuck)).orderBy(F.desc("homes"), "cell").limit(256).collect()
        held, large = 0, []
        for c in found:
            held += SAMPLE * c["dim"]
            if large and held > ON_DRIVER:
                break
            large.append(c)
        if not large:
            break
        pivots = {}
        for name, sample in _samples(rows, large, SAMPLE).items():
            near = spread_pivots(sample, radius)
            left, copies = promise(sample, near, radius) if len(near) > 1 else (1.0, 1.0)
            before = next(c["copies"] for c in large if c["cell"] == name)
            if left <= GAIN and before * copies <= COPIES or len(near) == 1:
                pivots[name] = near  # one pivot splits nothing, but finds a core
            if len(near) == 1:
                stuck.append(f"{name}/0")
        stuck += [c["cell"] for c in large if c["cell"] not in pivots]
        if pivots:
            names = F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in pivots], "cell string"))
            rest, deep = rows.join(names, "cell", "left_anti"), rows.join(names, "cell", "left_semi")
            rows = work.keep(rest.select(*rows.columns).union(_split(deep.select(*rows.columns), pivots, radius)), f"cells-{level}")
            if level:
                work.drop(f"cells-{level - 1}")
    return rows


def _compare(least: float):
    """Links between the two blocks of a group, or within its one block."""

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first = table.column("side").to_numpy() == 0
        raw = _matrix(table.column("vec").combine_chunks())
        units, node, mult = unit(raw), table.column("node").to_numpy(), table.column("mult").to_numpy()
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        alone = not len(b)
        if alone:
            b = a
        cos = units[a] @ units[b].T
        link = cos >= least
        for x, y in zip(*np.nonzero(np.abs(cos - least) < 1e-12), strict=True):
            link[x, y] = exact_cosine(raw[a[x]], raw[b[y]]) >= least
        if alone:
            np.fill_diagonal(link, False)
        n = np.zeros(len(node), np.int64)
        n[a] = link @ mult[b]
        if not alone:
            n[b] = link.T @ mult[a]
        root = _roots(link, a, b, node)
        hit = n > 0
        return pa.table({"node": node[hit], "n": n[hit], "root": root[hit]})

    return compare


def _roots(link: np.ndarray, a: np.ndarray, b: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The smallest node that each row reaches by the links: least values spread over links and along themselves."""
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), np.int64)
    rank[order] = np.arange(len(node))
    far, now = len(node), rank.copy()
    while True:
        new = now.copy()
        new[a] = np.minimum(new[a], np.where(link, now[b][None, :], far).min(axis=1, initial=far))
        new[b] = np.minimum(new[b], np.where(link, now[a][:, None], far).min(axis=0, initial=far))
        new = np.minimum(new, new[order[new]])
        if (new == now).all():
            return node[order[now]]
        now = new


def _join(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(node, n, root) rows of all cells: what core counts state, and what comparisons find."""
    sides = rows.groupBy("cell").agg(*[F.count(F.when(F.expr(e), 1)).alias(k) for k, e in (("c", "core"), ("r", "home and not core"), ("g", "not home"))], F.sum(F.when(F.col("core"), F.col("mult"))).alias("all"), F.min(F.when(F.col("core"), F.col("node"))).alias("top"))
    sides = sides.where("c + r > 0").select("cell", *[F.ceil(F.col(k) / BLOCK).cast("int").alias(f"n{k}") for k in "crg"], "all", "top")
    dealt = rows.join(sides, "cell")
    stated = dealt.where("core").select("node", (F.col("all") - F.col("mult")).alias("n"), F.col("top").alias("root")).where("n > 0")
    kind = F.when(F.col("core"), "c").when(F.col("home"), "r").otherwise("g")
    own = F.when(F.col("core"), F.col("nc")).when(F.col("home"), F.col("nr")).otherwise(F.col("ng"))
    dealt = dealt.withColumn("kind", kind).withColumn("k", F.pmod(F.xxhash64("node", "cell"), own).cast("int"))
    #: Core meets the rest and the guests, the rest meets itself too; of two blocks, the first named is side 0.
    meets = F.expr("""
        case kind
          when 'c' then concat(transform(sequence(0, nr), j -> struct('cr' as p, k as i, j as j, 0 as side)), transform(sequence(0, ng), j -> struct('cg' as p, k as i, j as j, 0 as side)))
          when 'r' then concat(transform(sequence(0, nc), i -> struct('cr' as p, i as i, k as j, 1 as side)), transform(sequence(0, ng), j -> struct('rg' as p, k as i, j as j, 0 as side)),
            transform(sequence(0, nr), j -> struct('rr' as p, least(k, j) as i, greatest(k, j) as j, if(k <= j, 0, 1) as side)))
          else concat(transform(sequence(0, nc), i -> struct('cg' as p, i as i, k as j, 1 as side)), transform(sequence(0, nr), i -> struct('rg' as p, i as i, k as j, 1 as side))) end""")
    # sequence() has no empty form, so each runs one too far; blocks beyond the last are left out here
    meets = F.filter(meets, lambda m: (m["i"] < F.when(F.substring(m["p"], 1, 1) == "c", F.col("nc")).otherwise(F.col("nr"))) & (m["j"] < F.when(F.substring(m["p"], 2, 1) == "r", F.col("nr")).otherwise(F.col("ng"))))
    met = dealt.select("cell", "node", "mult", "vec", F.explode(meets).alias("m")).select("cell", "m.p", "m.i", "m.j", "m.side", "node", "mult", "vec")
    return stated, met.groupBy("cell", "p", "i", "j").applyInArrow(_compare(least), "node long, n long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding, label)."""
    if not 0 < least <= 1:
        raise ValueError("least: above 0, at most 1")
    work, radius = Workspace(vectors.sparkSession, "range"), math.sqrt(2 - 2 * least)
    keyed, classes = _classes(vectors, work)
    stated, compared = _join(_cells(_first_cells(classes), radius, work), least)
    found = work.keep(stated.union(compared), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    whole = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), work)
    named = classes.select("node", "k1", "k2", "least", "mult").join(counts, "node", "left").join(whole, "node", "left")
    named = work.keep(named.withColumn("component", F.coalesce("component", "node")), "named")
    least_id = named.groupBy("component").agg(F.min("least").alias("component_id"))
    info = work.keep(named.join(least_id, "component").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id"), "info")
    single, rest = keyed.where("k1 is null"), keyed.where("k1 is not null").join(info, ["k1", "k2"])
    out = rest.select("vec_id", "n_links", "component_id").union(single.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
