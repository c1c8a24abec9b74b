"""Matching of binary descriptors by Hamming distance: multi-index hashing within a radius; mutual best with a ratio test."""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.lineage import cut
from strandline.operators import blocks

#: Bits of a substring, and the flips of one that are looked up.
PIECE, FLIPS = 16, 2
#: Columns of a tile of distances; tasks that cells are dealt to at most.
WIDE, MOST = 512, 4_096


def packed(positions: Column, words: int) -> Column:
    """The set bits' positions (from 0) as an array of 64-bit numbers."""
    one = lambda k: F.aggregate(F.filter(positions, lambda p: F.floor(p / 64) == k), F.lit(0).cast("long"), lambda s, p: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))))
    return F.array(*[one(k) for k in range(words)])


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _pieces(bits: Column) -> Column:
    """All 16-bit pieces of an array of 64-bit numbers."""
    low = F.lit(0xFFFF).cast("long")
    return F.flatten(F.transform(bits, lambda x: F.array(*[F.shiftrightunsigned(x, PIECE * k).bitwiseAND(low).cast("int") for k in range(4)])))


def _masks(flips: int) -> list[int]:
    return [sum(1 << b for b in at) for n in range(flips + 1) for at in combinations(range(PIECE), n)]


def within(left: DataFrame, right: DataFrame, radius: int, words: int) -> DataFrame:
    """(pair, a, b, distance) of all rows (pair, a, bits) and (pair, b, bits) at most ``radius`` apart, bits being ``words`` numbers.

    Of 4 * words pieces, one differs in at most radius / (4 * words) bits, so rows meet on equal pieces after so many flips on
    the left.  A pair is taken at the first piece that brings it together, so it comes once without a shuffle to make it so."""
    pieces = 4 * words
    flips = radius // pieces
    if flips > FLIPS:
        raise ValueError(f"radius: below {(FLIPS + 1) * pieces} for {64 * words} bits")
    masks = F.array(*[F.lit(m) for m in _masks(flips)])
    a = left.select("pair", "a", F.col("bits").alias("x"), F.posexplode(_pieces(F.col("bits"))).alias("i", "piece")).withColumn("piece", F.explode(F.transform(masks, lambda m: F.col("piece").bitwiseXOR(m))))
    b = right.select("pair", "b", F.col("bits").alias("y"), F.posexplode(_pieces(F.col("bits"))).alias("i", "piece"))
    met = a.join(b, ["pair", "i", "piece"]).withColumn("distance", distance(F.col("x"), F.col("y"))).where(F.col("distance") <= radius)
    apart = F.transform(_pieces(F.zip_with("x", "y", lambda p, q: p.bitwiseXOR(q))), lambda p: F.bit_count(p) <= flips)
    return met.where(F.array_position(apart, True) == F.col("i") + 1).select("pair", "a", "b", "distance")


def _nearest(held: DataFrame, passing: DataFrame, words: int, bound: int, k: int, ties: bool) -> DataFrame:
    """(pair, id, other, distance): for rows (pair, id, bits) of ``held`` the nearest of ``passing``, (pair, id, bits, n), that each cell finds at
    most ``bound`` apart; the k least distances of all are among them, one that n > 1 rows have k times at most.  With ``ties`` so
    are the smallest ids of those distances, without it any of them.

    Numbers of set bits of such pairs differ by ``bound`` at most, so rows meet in strips of that number, in cells of bounded
    size.  A cell's rows are in its order; a tile meets the rows whose k-th distance so far allows it."""
    width = max(1, bound)
    strip = F.floor(F.aggregate("bits", F.lit(0), lambda s, x: s + F.bit_count(x)) / width).cast("int")
    held = held.withColumn("strip", strip)
    passing = passing.withColumn("strip", F.explode(F.array(strip - 1, strip, strip + 1)))
    count = lambda df, n: df.groupBy("pair", "strip").agg(F.count("*").alias(n))
    sizes = count(held, "m").join(count(passing, "n"), ["pair", "strip"])
    sizes = cut(sizes.select("pair", "strip", F.ceil(F.col("m") / blocks.HELD).cast("int").alias("rows"), F.ceil(F.col("n") / blocks.PASSING).cast("int").alias("columns")))
    keys, cells = sizes.agg(F.count("*"), F.sum(F.col("rows") * F.col("columns"))).first()
    sizes = F.broadcast(sizes) if keys <= blocks.FEW else sizes

    def placed(df: DataFrame, own: str, other: str, *more: str) -> DataFrame:
        at = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        df = df.join(sizes, ["pair", "strip"]).select("pair", "strip", at, copies, F.col("id").cast("long").alias("id"), "bits", *more)
        df = df.select(*[F.col(c).alias(c) for c in df.columns])  # both sides may come from one table
        return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, min(2 * (cells or 0), MOST)), *place).groupBy(*place)

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits as numbers, how many are set, and the order by that."""
        flat = table.column("bits").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        x = np.unpackbits(flat.view(np.uint8).reshape(len(table), 8 * words), axis=1)
        size = x.sum(1, dtype=np.int64)
        at = np.argsort(size, kind="stable")
        return x[at].astype(np.float32), size[at].astype(np.float32), at

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        pair = left.schema.field("pair").type
        if not len(left) or not len(right):
            return pa.table([pa.array([], t) for t in (pair, pa.int64(), pa.int64(), pa.int32())], ["pair", "id", "other", "distance"])
        (x, p, a), (y, q, b) = read(left), read(right)
        ids, others = left.column("id").to_numpy()[a], right.column("id").to_numpy()[b]
        copies = np.minimum(right.column("n").to_numpy()[b], k)
        x = np.hstack([x, -p[:, None] / 2, np.ones_like(p)[:, None]])  # products are then minus half the distance
        y = np.hstack([y, np.ones_like(q)[:, None], -q[:, None] / 2])
        edge = np.full(len(p), bound + 1, np.float32)  # distances below it count
        found, waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

        def settle() -> None:
            nonlocal waiting
            i, other, far = (np.concatenate(f) for f in zip(*found, strict=True))
            at = np.lexsort((other, far, i))
            i, other, far = i[at], other[at], far[at]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            edge[i[place == k - 1]] = far[place == k - 1] + ties
            found[:], waiting = [(i[place < k], other[place < k], far[place < k])], 0

        for at in range(0, len(q), WIDE):
            least, most = q[at], q[min(at + WIDE, len(q)) - 1]
            rows = np.flatnonzero((least - p < edge) & (p - most < edge))
            if not len(rows):
                continue
            near = x[rows] @ y[at : at + WIDE].T
            hits = near > -edge[rows, None] / 2
            if near.shape[1] > k and np.count_nonzero(hits) > 4 * k * len(rows):
                hits &= near >= np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k][:, None]
            i, j = np.divmod(np.flatnonzero(hits), near.shape[1])
            if len(i):
                far, n = np.rint(-2 * near[i, j]).astype(np.int64), copies[at + j]
                found.append((np.repeat(rows[i], n), np.repeat(others[at + j], n), np.repeat(far, n)))
                waiting += len(i)
                if waiting > len(p) // 4:
                    settle()
        settle()
        i, other, far = found[0]
        return pa.table([pa.array([left.column("pair")[0].as_py()] * len(i), pair), pa.array(ids[i]), pa.array(other), pa.array(far.astype(np.int32))], ["pair", "id", "other", "distance"])

    place = ["pair", "strip", "rows", "columns"]
    kind = held.schema["pair"].dataType.simpleString()
    return placed(held, "rows", "columns").cogroup(placed(passing, "columns", "rows", "n")).applyInArrow(cell, f"pair {kind}, id long, other long, distance int")


def match(left: DataFrame, right: DataFrame, radius: int, words: int, ratio: float = 0.8) -> DataFrame:
    """(pair, a, b, distance): mutual best matches of at most ``radius`` bits whose distance is below ``ratio`` times the second best.

    Ties of a best go to the smaller number, of either side; without a second the test is passed.  A second beyond
    radius / ratio passes the test whatever it is, so two bests of ``left`` are looked for up to there, and for those that
    pass the best of the other side.  Pairs whose numbers of set bits allow it are compared, as products of matrices of bits;
    where most descriptors are near each other, as full ones are, an index of pieces would bring together each pair many times.
    Equal descriptors of one side are one class with a count, so copies are never paired with each other.  Rows whose pair or
    bits are null match nothing."""
    fold = lambda df, n: cut(df.where("pair is not null and bits is not null").groupBy("pair", "bits").agg(F.min(n).alias("id"), F.count("*").alias("n")))
    a, b = fold(left, "a"), fold(right, "b")
    bound = min(64 * words, max(radius, ceil(radius / ratio))) if ratio > 0 else 64 * words
    order = Window.partitionBy("pair", "id").orderBy("distance", "other")
    first = lambda df: df.withColumn("second", F.lead("distance").over(order)).withColumn("i", F.row_number().over(order)).where("i = 1")
    best = first(_nearest(a, b, words, bound, 2, ratio > 1))
    best = best.where((F.col("distance") <= radius) & (F.col("second").isNull() | (F.col("distance") < ratio * F.col("second"))))
    best = cut(best.select("pair", F.col("id").alias("a"), F.col("other").alias("b"), "distance"))
    met = b.join(best.select("pair", F.col("b").alias("id")).distinct(), ["pair", "id"], "left_semi")
    back = first(_nearest(met, a, words, radius, 1, True)).select("pair", F.col("other").alias("a"), F.col("id").alias("b"))
    return best.join(back, ["pair", "a", "b"]).select("pair", "a", "b", "distance")
