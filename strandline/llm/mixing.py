"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents all have the fractional copy number target / size of the source.  Mass, measured in words, is exchanged at random
but fairly until copy numbers are integral, so that the expected copies of each document and the words of the whole source stay as they
were.  Large documents, of at least 1 / ``LARGE`` of their source's words, so at most ``LARGE`` of them, come first, by falling size: each
is paired with the pool of all that is smaller, to the last document of the source, and takes the copies below or above its fraction
while the pool's common copy number rises or falls in turn.  The rest is at that common number, of which the whole part is taken by
each; what is left is rounded in buckets, two by two, each bucket handing at most one fractional document to the next level of a
reduction tree, whose last one is drawn.  That one is small, so a source's total misses its target by less than 1 / ``LARGE`` of the source,
whatever the number of buckets.  A large document takes the other of its two numbers where only that leaves the pool between none and
``most`` copies; where neither does, the one that misses less, unless both are within ``CLOSE`` of the target.

Equal rows of one id are one unit, whose copies are dealt evenly, so however many there are they meet in no task.  Random numbers and
buckets come from a hash of id and text, so reruns and other layouts agree.

Defined results: null and empty texts have size 0; sources of size 0 have target 0; size 0 takes 0.  A null source is a
source, and comes last.  Very long texts are counted whole.  Rows that repeat an id with other texts are documents of their own.
Columns other than id, text and source are not read, so clashing names do no harm.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm import hashing
from strandline.llm.storage import Workspace

#: Documents of a first-level bucket, and buckets that meet in the next level.
BUCKET, FAN_IN = 10_000, 512
#: Large is a document of this part of its source; miss of a target that may be left to a fair draw; rows that one row is unfolded to at once.
LARGE, CLOSE, UNFOLD = 4_096, 0.01, 10_000


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """sizes(source, source_size, docs) to the same with target: share of all words by weight, none above most times its
    size.  The level at which capped and uncapped shares add up is found in one pass over the sources by cap per weight."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("per", F.col("cap") / F.col("w"))
    before = Window.orderBy("per", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("goal", F.least(share * F.sum("source_size").over(every), F.sum("cap").over(every)))
    level = (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    # of sources that share the least cap per weight, the first has the level; the next one's is already without its cap
    rows = rows.withColumn("level", -F.min(F.when(F.col("level") <= F.col("per") * (1 + 1e-12), F.struct("per", (-F.col("level")).alias("level")))).over(every)["level"])
    return rows.select("source", "source_size", "docs", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def draws(ids: np.ndarray, seed: int) -> np.ndarray:
    """A uniform number for each id."""
    return (hashing.mix(ids.view(np.uint64) ^ np.uint64(seed * 0x9E3779B9 + 1)) >> np.uint64(11)).astype(float) / 2**53


def _exchange(p: float, a: float, q: float, b: float, u: float) -> float:
    """The words that move from the second (size b, probability q) to the first, by a fair draw; one becomes integral."""
    up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
    return up if u * (up + down) < down else -down


def _settled(p: float, eps: float = 1e-9) -> float:
    return float(round(p)) if p <= eps or p >= 1 - eps else p


def pivot(ids: np.ndarray, sizes: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after pairing: all 0 or 1 but one at most; the sum of size times probability is kept.

    Documents come by falling size.  Where all have one probability, each is paired with the pool of all smaller ones,
    which share a probability until it is their turn, so that what stays open is small; otherwise two by two.
    """
    draw = draws(ids, seed)
    order = np.lexsort((draws(ids, seed + 500), -sizes))  # other numbers than the draws, which the order would bias
    size, q, u = sizes.astype(float)[order].tolist(), p.astype(float)[order].tolist(), draw[order].tolist()
    if len(q) and min(q) == max(q):
        rest, common = sum(size), _settled(q[0])
        for j, a in enumerate(size):
            rest -= a
            q[j] = common
            if rest > 0 and 0 < common < 1:
                move = _exchange(common, a, common, rest, u[j])
                q[j], common = _settled(common + move / a), _settled(common - move / rest)
    else:
        i = -1
        for j in range(len(q)):
            q[j] = _settled(q[j])
            if not 0 < q[j] < 1:
                continue
            if i >= 0:
                move = _exchange(q[i], size[i], q[j], size[j], u[j])
                q[i], q[j] = _settled(q[i] + move / size[i]), _settled(q[j] - move / size[j])
            i = i if i >= 0 and 0 < q[i] < 1 else j if 0 < q[j] < 1 else -1
    out = np.empty(len(q))
    out[order] = q
    return out


def take_large(sizes: np.ndarray, rows: np.ndarray, draw: np.ndarray, target: float, words: float, most: float) -> tuple[list[int], float]:
    """Copies of each large document (its size, equal rows and draw), largest first, and the copy number that is left for the rest."""
    out, near = [], CLOSE * target
    for s, m, u in zip(sizes.tolist(), rows.tolist(), draw.tolist(), strict=True):
        share = m * min(most, max(0.0, target / words))
        low = math.floor(share + 1e-9)
        rest = words - m * s
        miss = [max(0.0, n * s - target, target - n * s - most * rest) for n in (low, low + 1)]
        if share - low <= 1e-9:
            n = low
        elif max(miss) <= 1e-6 or min(miss) > 1e-6 and max(miss) <= near:
            n = low + (u < share - low)
        else:
            n = low + (miss[1] < miss[0])
        out.append(int(n))
        target, words = max(0.0, target - n * s), rest
    return out, min(most, target / words) if words > 0 else 0.0


def _large(seed: int, most: float):
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        draw = draws(pdf["key"].to_numpy(np.int64), seed + 2_000)
        order = np.lexsort((draws(pdf["key"].to_numpy(np.int64), seed + 2_500), -pdf["size"].to_numpy()))
        pdf, draw = pdf.iloc[order], draw[order]
        total, rest = take_large(pdf["size"].to_numpy(), pdf["n"].to_numpy(), draw, float(pdf["target"].iloc[0]), float(pdf["source_size"].iloc[0]), most)
        return pdf.assign(total=total, rest=rest)

    return group


def _level(seed: int):
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sizes = pdf["key"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)
        p = pivot(ids, sizes, pdf["p"].to_numpy(float), seed)
        if pdf["buckets"].iloc[0] <= 1:  # all of the source that is still open
            p = np.where((p > 0) & (p < 1), draws(ids, seed + 1000) < p, p).astype(float)
        return pdf.assign(p=p)

    return group


def _unfolded(units: DataFrame) -> DataFrame:
    """One row for each of a unit's n equal rows, with its copies: the total is dealt evenly."""
    few = units.where(F.col("n") <= UNFOLD).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    many = units.where(F.col("n") > UNFOLD).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / UNFOLD)))).repartition("key", "part")
    many = many.withColumn("i", F.explode(F.sequence(F.col("part") * UNFOLD, F.least(F.col("part") * UNFOLD + (UNFOLD - 1), F.col("n") - 1)))).drop("part")
    return few.union(many).withColumn("copies", F.floor(F.col("total") / F.col("n")) + (F.col("i") < F.col("total") % F.col("n")).cast("long"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of ``docs`` (doc_id, source, text)."""
    work, c = Workspace(docs.sparkSession, "mixing"), F.col
    key = F.xxhash64("doc_id", F.xxhash64("text"))
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), c("source").cast("string").alias("source"), n_words("text").alias("size"), key.alias("key"))
    base = work.keep(rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n")), "sizes")
    per = targets(base.groupBy("source").agg(F.sum(c("size") * c("n")).alias("source_size"), F.sum("n").alias("docs")), weights, share, most)
    per = work.keep(per.withColumn("buckets", F.ceil(c("docs") / BUCKET).cast("int")), "targets")
    small = per.count() <= 10_000
    beside = lambda left, right: left.join(F.broadcast(right) if small else right, left["source"].eqNullSafe(right["_source"]), "left").drop("_source")
    units = beside(base, per.withColumnRenamed("source", "_source"))
    none = units.where("size = 0").withColumn("total", F.lit(0).cast("long"))
    units = units.where("size > 0")
    large = units.where(c("size") * LARGE >= c("source_size"))
    large = work.keep(large.groupBy("source").applyInPandas(_large(seed, most), f"{_kinds(large)}, total long, rest double"), "large")
    rest = large.groupBy(c("source").alias("_source")).agg(F.first("rest").alias("rest"))
    now = beside(units.where(c("size") * LARGE < c("source_size")), rest).withColumn("rest", F.coalesce("rest", F.least(c("target") / c("source_size"), F.lit(float(most)))))
    # a copy number that is whole but for rounding is whole
    share_ = F.when(F.abs(c("rest") * c("n") - F.round(c("rest") * c("n"))) < 1e-9, F.round(c("rest") * c("n"))).otherwise(c("rest") * c("n"))
    now = now.withColumn("share", share_).withColumn("whole", F.floor("share")).withColumn("p", c("share") - c("whole")).drop("share", "rest")
    now = now.withColumn("bucket", F.pmod(F.xxhash64("key"), c("buckets")).cast("int"))
    most_buckets, level = per.agg(F.max("buckets")).first()[0] or 1, 0
    done = [now.where("p = 0")]
    now = now.where("p > 0")
    while True:
        now = work.keep(now.groupBy("source", "bucket").applyInPandas(_level(seed + level), now.schema), f"level-{level}")
        done.append(now.where("p = 0 or p = 1"))
        if most_buckets <= 1:
            break
        now = now.where("p > 0 and p < 1").withColumn("bucket", F.floor(c("bucket") / FAN_IN).cast("int")).withColumn("buckets", F.ceil(c("buckets") / FAN_IN).cast("int"))
        most_buckets, level = -(-most_buckets // FAN_IN), level + 1
    columns = ["doc_id", "key", "source", "size", "source_size", "target", "n", "total"]
    out = none.select(columns).union(large.select(columns))
    for part in done:
        out = out.union(part.withColumn("total", c("whole") + c("p").cast("long")).select(columns))
    return _unfolded(out).select("doc_id", "source", "size", "source_size", "target", "copies", (c("copies") * c("size")).alias("taken"))


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
