"""Nearest neighbours by largest inner product, with a vantage-point tree per shard.

Equal vectors are one point with its smallest ids (as many as a result can show, which loses nothing).  Points are dealt to
shards of bounded size; each shard becomes a vantage-point tree, and all queries stream through every shard in blocks.
An inner product becomes a distance by one more coordinate, sqrt(M**2 - |x|**2), M the shard's largest norm.  A branch is
left out where the triangle inequality puts it beyond the query's k-th best distance times ``factor``: at 1 the search is
exact, ties at the end of the list included, lower values prune more.  Products of matrices only screen; what may enter a
list is scored by sums over the original vectors in double precision and ordered by score, then by id.

All queries visit all shards: that work grows with queries times points, and is spread over shards times query parts.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, as query or as
candidate.  Only vectors of one length meet; very long ones are a row each and need
the memory of a shard.  Products beyond the range of doubles count as infinite.  An empty table gives an empty result.  Rows with a null id take no part; repeated rows count once.  Ties go to the
smaller id.  Columns other than the id, the vector and those of ``is_query`` are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.storage import Workspace

#: Points of a shard, points of a leaf, queries that go through a tree at once, queries of a task.
SHARD, LEAF, BLOCK, PART = 8_192, 256, 1_024, 16_384


class VantageTree:
    """Points in double precision; ``first`` is each point's smallest id, which breaks ties."""

    def __init__(self, points: np.ndarray, first: np.ndarray, leaf: int = LEAF):
        self.points, self.first = points, first
        self.scale = 2.0 ** -np.ceil(np.log2(max(np.abs(points).max(), 1e-300)))  # keeps squares finite; exact
        self.scaled = points * self.scale
        norms = (self.scaled**2).sum(1)
        self.m2 = float(norms.max())
        self.high = np.hstack([self.scaled, np.sqrt(np.maximum(0, self.m2 - norms))[:, None]])
        self.leaf = leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, ids: np.ndarray):
        if len(ids) <= self.leaf:
            return ids
        centre = self.high[ids].mean(0)
        vantage = int(ids[np.argmax(((self.high[ids] - centre) ** 2).sum(1))])
        d = np.sqrt(np.maximum(0, ((self.high[ids] - self.high[vantage]) ** 2).sum(1)))
        middle = float(np.median(d))
        inside = d <= middle
        if inside.all():
            inside = d < middle
            if not inside.any():
                return ids
        return vantage, middle, self._build(ids[inside]), self._build(ids[~inside])

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and point numbers of the k best found of each query, ties by smaller id (number -1: none)."""
        size = 2.0 ** -np.ceil(np.log2(np.maximum(np.abs(queries).max(1, keepdims=True), 1e-300)))
        size *= np.sqrt(self.m2) / np.maximum(np.linalg.norm(queries * size, axis=1, keepdims=True), 1e-300)  # as long as the longest point
        self.original, self.unit = queries, size[:, 0] * self.scale
        self.q = queries * size
        self.q_high = np.hstack([self.q, np.zeros((len(queries), 1))])
        self.base = self.m2 + (self.q**2).sum(1)
        # What a product of matrices may differ by from the sums that decide.
        self.slack = 1e-15 * (queries.shape[1] + 4) * np.sqrt(self.m2 * (self.q**2).sum(1))
        self.best = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), -1, np.int64)
        self.k, self.factor, self.visited = k, factor, 0
        self._visit(self.root, np.arange(len(queries)))
        return self.best, self.found

    def _least(self, on: np.ndarray) -> np.ndarray:
        """A lower bound, in scaled units, of the k-th best scores."""
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num(self.best[on, -1] * self.unit[on], nan=-np.inf, posinf=np.inf, neginf=-np.inf)

    def _visit(self, node, on: np.ndarray) -> None:
        if not len(on):
            return
        if isinstance(node, np.ndarray):
            self.visited += len(on) * len(node)
            rough = self.q[on] @ self.scaled[node].T
            least = self._least(on)
            if len(node) > self.k:
                least = np.maximum(least, np.partition(rough, len(node) - self.k, axis=1)[:, len(node) - self.k] - self.slack[on])
            maybe = rough >= (least - self.slack[on])[:, None]
            n = maybe.sum(1)
            for top in (8, 32, len(node)):  # rows by how many may enter, so that tables are narrow
                rows = np.flatnonzero((n > 0) & (n <= top))
                n[rows] = 0
                for at in range(0, len(rows), 256):
                    self._enter(on[rows[at : at + 256]], node, maybe[rows[at : at + 256]])
            return
        vantage, middle, inside, outside = node
        d = np.sqrt(np.maximum(0, ((self.q_high[on] - self.high[vantage]) ** 2).sum(1)))
        near = d <= middle
        self._visit(inside, on[near])
        self._visit(outside, on[~near])
        far2 = self.base[on] - 2 * self._least(on)
        reach = np.sqrt(np.maximum(0, far2 + 4 * self.slack[on] + 1e-12 * self.base[on])) * self.factor
        self._visit(outside, on[near & (middle - d <= reach)])
        self._visit(inside, on[~near & (d - middle <= reach)])

    def _enter(self, on: np.ndarray, node: np.ndarray, maybe: np.ndarray) -> None:
        """Scores what may enter, in double precision, and keeps the k first by score and id."""
        width = int(maybe.sum(1).max())
        place = np.argsort(~maybe, axis=1, kind="stable")[:, :width]
        number = np.where(np.take_along_axis(maybe, place, 1), node[place], -1)
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.where(number >= 0, (self.points[number] * self.original[on][:, None, :]).sum(2), -np.inf)
        score, number = np.hstack([self.best[on], score]), np.hstack([self.found[on], number])
        last = np.iinfo(np.int64).max
        top = np.lexsort((np.where(number >= 0, self.first[number], last), -score), axis=1)[:, : self.k]
        self.best[on], self.found[on] = np.take_along_axis(score, top, 1), np.take_along_axis(number, top, 1)


def _search(k: int, factor: float):
    """Rows by shard and part, points first: builds the tree, then streams the queries through it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, ids, tree, waiting = None, [], [], None, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal tree
            if not waiting or not vectors:
                waiting.clear()
                return
            if tree is None:
                tree = VantageTree(np.array(vectors, float), np.array([x[0] for x in ids], np.int64))
            queries = np.array([v for _, v in waiting], float)
            scores_of, found = tree.search(queries, min(k + 1, len(vectors)), factor)
            out = [[], [], []]
            for (query, _), scores, numbers in zip(waiting, scores_of, found, strict=True):
                pairs = sorted((-s, i) for s, n in zip(scores.tolist(), numbers.tolist(), strict=True) if n >= 0 for i in ids[n] if i != query)[:k]
                for x, v in zip(out, (query, [i for _, i in pairs], [-s for s, _ in pairs]), strict=True):
                    x.append(v)
            waiting.clear()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])

        for batch in batches:
            names = {f.name: i for i, f in enumerate(batch.schema)}
            dims, shards, parts, kinds, who = (batch.column(names[x]).to_pylist() for x in ("dim", "shard", "part", "kind", "ids"))
            embedding = batch.column(names["v"])
            for i in range(batch.num_rows):
                key = (dims[i], shards[i], parts[i])
                if key != now:
                    yield from flush()
                    now, vectors, ids, tree = key, [], [], None
                v = embedding[i].values.to_numpy(zero_copy_only=False)
                if kinds[i] == 0:
                    vectors.append(v)
                    ids.append(who[i])
                else:
                    waiting.append((who[i][0], v))
                    if len(waiting) >= BLOCK:
                        yield from flush()
        yield from flush()

    return task


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 0.16, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among all other rows, nearest first."""
    work = Workspace(vectors.sparkSession, "vptree")
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    clean = clean.where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists(v, x -> x <> 0)")
    same = Window.partitionBy("v").orderBy("id")
    points = clean.select("id", "v").withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    points = work.keep(points.withColumn("dim", F.size("v")), "points")
    asked = work.keep(clean.where("asks").groupBy("id", "v").agg(F.lit(1).alias("one")).select(F.array("id").alias("ids"), "v", F.size("v").alias("dim")), "queries")
    shards, parts = max(1, -(-points.count() // shard)), max(1, -(-asked.count() // PART))
    deal = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = ["dim", "shard", "part", "kind", "ids", "v"]
    left = points.withColumn("shard", deal(shards)).withColumn("part", each(parts)).withColumn("kind", F.lit(0)).select(names)
    right = asked.withColumn("part", deal(parts)).withColumn("shard", each(shards)).withColumn("kind", F.lit(1)).select(names)
    dealt = left.union(right).repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "kind")
    found = dealt.mapInArrow(_search(k, factor), "query_id long, ids array<long>, scores array<double>")
    found = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
