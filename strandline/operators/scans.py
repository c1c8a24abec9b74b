"""Scans and selections over groups that no task may hold: numbering, prefix products of motions, exact quantiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.lineage import cut

#: Width of a span of order values; rows of a group whose quantiles one task may take; groups that a broadcast may hold.
SPAN, GROUP, FEW = 1_024, 4_096, 10_000
#: Accuracy of the sketch that brackets a quantile: ranks are off by at most 1 / SHARP of a group.
SHARP = 10_000


def _few(df: DataFrame) -> DataFrame:
    """Broadcast, if a count shows that it's small."""
    return F.broadcast(df) if df.count() <= FEW else df


def _span(order: str, width: int) -> Column:
    return F.coalesce(F.floor(F.col(order) / width), F.lit(-(2**62))).cast("long")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "place", width: int = SPAN) -> DataFrame:
    """Each key's rows numbered from 0 by ``order``, the first of which is a number.

    Rows are numbered inside spans of that number, and each span starts where those before it end."""
    rows = df.withColumn("_span", _span(order[0], width))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(*order)) - 1)
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "_span").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return same_keys(rows, starts.drop("_n"), [*keys, "_span"]).withColumn(name, F.col("_start") + F.col("_i")).drop("_span", "_i", "_start")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null, with the left side's keys."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


# --- prefix products -------------------------------------------------------------------------------------------------

IDENTITY = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]


def times(a: Column, b: Column) -> Column:
    """Product of two row-major 4x4 matrices."""
    cell = lambda r, c: sum((a[4 * r + k] * b[4 * k + c] for k in range(1, 4)), a[4 * r] * b[c])
    return F.array(*[cell(r, c) for r in range(4) for c in range(4)])


def running(stack: np.ndarray) -> np.ndarray:
    """Products of all prefixes of n matrices in log2(n) batched steps."""
    out, step = stack.copy(), 1
    while step < len(out):
        out[step:] = out[:-step] @ out[step:]
        step *= 2
    return out


def prefix_products(df: DataFrame, key: str, order: str, motion: str, width: int = SPAN, fan: int = SPAN) -> DataFrame:
    """(key, order, pose): the product of each sequence's 4x4 row-major motions up to each row, in any number of tasks.

    Matrix products don't commute but associate: products are taken inside spans of the order column (a number), the spans' totals
    are scanned in the same way, ``fan`` to a span, and each row is multiplied by what comes before its span.  Rows without
    16 numbers are left out; rows of equal order come in any order; a null key is a sequence."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.where(F.size(motion) == 16).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(motion).cast("array<double>").alias("pose"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        return pdf.assign(pose=list(running(np.stack(pdf["pose"]).reshape(-1, 4, 4)).reshape(-1, 16)))

    local = cut(rows.withColumn("s", _span("o", width)).groupBy("k", "s").applyInPandas(one, f"k {kinds[key]}, o {kinds[order]}, pose array<double>, s long"))
    totals = local.groupBy("k", "s").agg(F.max_by("pose", "o").alias("pose"))
    widest = totals.groupBy("k").agg((F.max("s") - F.min("s")).alias("w")).agg(F.max("w")).first()[0] or 0
    if widest >= fan:  # too many spans for one task: scan them in spans as well
        upto = prefix_products(totals, "k", "s", "pose", fan, fan)
    else:
        fold = lambda pdf: one(pdf.rename(columns={"s": "o"}))[["k", "o", "pose"]].rename(columns={"o": "s"})
        upto = totals.groupBy("k").applyInPandas(fold, f"k {kinds[key]}, s long, pose array<double>")
    before = upto.select("k", F.lead("s").over(Window.partitionBy("k").orderBy("s")).alias("s"), F.col("pose").alias("before")).where("s is not null")
    out = same_keys(local, before, ["k", "s"], "left")
    pose = F.when(F.col("before").isNull(), F.col("pose")).otherwise(times(F.col("before"), F.col("pose")))
    return out.select(F.col("k").alias(key), F.col("o").alias(order), pose.alias("pose"))


# --- exact quantiles -------------------------------------------------------------------------------------------------


def _interpolated(low: Column, high: Column, share: Column) -> Column:
    return low + (high - low) * share


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """keys and the exact, linearly interpolated quantiles ``at`` (name to share) of a value over groups of any size.

    Groups of up to ``GROUP`` rows are sorted in a task.  Of larger ones only the rows between two values of a sketch that
    surround a wanted rank are looked at: the sketch's error is bounded, so at most 6 / SHARP of the rows are left, and exact counts of
    what lies below say which of them is wanted.  What is left goes round again until ``GROUP`` rows suffice.  All quantiles of all
    groups go together.  Null values take no part; groups without others have no row."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v")).where("v is not null")
    sizes = rows.groupBy(*names).agg(F.count("*").alias("n"), _cuts("v", list(at.values())))
    sizes = cut(sizes.withColumn("cuts", F.when(F.col("n") > GROUP, F.col("cuts"))))
    back = lambda d: d.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *at)
    large = sizes.agg(F.max("n")).first()[0] or 0
    if large <= GROUP:
        return back(rows.groupBy(*names).agg(*[F.percentile("v", F.lit(q)).alias(k) for k, q in at.items()]))
    small = same_keys(rows, _few(sizes.where("cuts is null").select(*names)), names, "left_semi")
    out = small.groupBy(*names).agg(*[F.percentile("v", F.lit(q)).alias(k) for k, q in at.items()])
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(i).alias("i"), F.lit(end).alias("high"), (F.ceil if end else F.floor)(place(q)).cast("long").alias("rank")) for i, (k, q) in enumerate(at.items()) for end in (0, 1)]))
    asked = sizes.where("cuts is not null").select(*names, "cuts", wanted.alias("w")).select(*names, "w.*", F.col("cuts")[F.col("w.i")]["lo"].alias("lo"), F.col("cuts")[F.col("w.i")]["hi"].alias("hi"))
    picked = _select(rows, names, asked)
    pairs = picked.groupBy(*names, "name").agg(F.max(F.when(F.col("high") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("high") == 1, F.col("v"))).alias("b"))
    pairs = same_keys(pairs, sizes.select(*names, "n"), names)
    shares = {k: place(q) - F.floor(place(q)) for k, q in at.items()}
    each = [F.max(F.when(F.col("name") == k, _interpolated(F.col("a"), F.col("b"), s))).alias(k) for k, s in shares.items()]
    return back(out.select(*names, *at).union(pairs.groupBy(*names).agg(*each).select(*names, *at)))


def _cuts(v: str, at: list[float]) -> Column:
    """For each share, values surely below and above the rows that its interpolation needs."""
    near = [min(1.0, max(0.0, q + d)) for q in at for d in (-2 / SHARP, 2 / SHARP)]
    found = F.percentile_approx(v, near, SHARP)
    return F.array(*[F.struct(found[2 * i].alias("lo"), found[2 * i + 1].alias("hi")) for i in range(len(at))]).alias("cuts")


def _select(rows: DataFrame, names: list[str], asked: DataFrame) -> DataFrame:
    """asked(keys, name, i, high, rank, lo, hi) with v, the value of that rank (from 0) among the key's rows.

    In later rounds the inside of each bracket is a group of its own, named by the bracket's ends.  A rank that a sketch's
    bracket misses, which its bound rules out, would be looked for again between the least and the largest value."""
    c, own, done, turn = F.col, list(names), [], 0
    open_ = [(rows, names, asked)]
    while open_:
        (rows, names, asked), turn = open_.pop(), turn + 1
        marked = lambda d: _few(d.groupBy(*names).agg(F.collect_set(F.struct("lo", "hi")).alias("marks")))  # noqa: B023, E731
        near = same_keys(rows, marked(asked), names).withColumn("m", F.explode("marks")).select(*names, "v", "m.*")
        sides = {"below": c("v") < c("lo"), "at_lo": c("v") == c("lo"), "inside": (c("v") > c("lo")) & (c("v") < c("hi")), "at_hi": c("v") == c("hi")}
        found = same_keys(asked, near.groupBy(*names, "lo", "hi").agg(*[F.count_if(e).alias(k) for k, e in sides.items()]), [*names, "lo", "hi"])
        place = c("rank") - c("below") - c("at_lo")
        missed = (c("rank") < c("below")) | (place >= c("inside") + F.when(c("lo") < c("hi"), c("at_hi")).otherwise(0))
        found = cut(found.withColumn("missed", missed).withColumn("v", F.when(~missed & (place < 0), c("lo")).when(~missed & (place >= c("inside")), c("hi"))))
        done.append(found.where("v is not null").select(*own, "name", "high", "v"))
        again = found.where("missed").drop("v", "missed", "lo", "hi", *sides)
        if not again.isEmpty():
            ends = rows.groupBy(*names).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
            open_.append((rows, names, cut(same_keys(again, ends, names))))
        left = found.where("v is null and not missed").withColumn("rank", place)
        most = left.agg(F.max("inside")).first()[0] or 0
        if not most:
            continue
        left = left.drop("v", "missed", *sides)
        inner = same_keys(rows, marked(left), names).withColumn("m", F.explode("marks")).where("v > m.lo and v < m.hi").select(*names, "v", "m.*")
        if most <= GROUP:
            sorted_ = inner.groupBy(*names, "lo", "hi").agg(F.array_sort(F.collect_list("v")).alias("vs"))
            done.append(same_keys(left, sorted_, [*names, "lo", "hi"]).select(*own, "name", "high", F.element_at("vs", (c("rank") + 1).cast("int")).alias("v")))
            continue
        ends = {"lo": f"_lo{turn}", "hi": f"_hi{turn}"}
        rows, names = cut(inner.withColumnsRenamed(ends)), [*names, *ends.values()]
        spread = rows.groupBy(*names).agg(F.count("*").alias("n"), F.percentile_approx("v", [k / 256 for k in range(257)], SHARP).alias("cuts"))
        pick = lambda k: F.element_at("cuts", (F.least(F.greatest(k, F.lit(0)), F.lit(256)) + 1).cast("int"))
        at, wide = c("rank") / c("n") * 256, 1 + 512 // SHARP
        asked = same_keys(left.withColumnsRenamed(ends), spread, names)
        asked = asked.withColumn("lo", pick(F.floor(at) - wide)).withColumn("hi", pick(F.ceil(at) + wide)).drop("n", "cuts")
        open_.append((rows, names, asked))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def sketches(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, sketch: a quantile sketch of bounded size for each group, to be stored and merged with those of other runs."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.expr(f"kll_sketch_agg_double(`{value}`)").alias("sketch"))


def merged_quantiles(stored: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """keys, n and approximate quantiles of what ``sketches`` kept, of any number of runs."""
    whole = stored.groupBy(*keys).agg(F.sum("n").alias("n"), F.expr("kll_merge_agg_double(sketch)").alias("sketch"))
    return whole.select(*keys, "n", *[F.expr(f"kll_sketch_get_quantile_double(sketch, {q}D)").alias(k) for k, q in at.items()])
