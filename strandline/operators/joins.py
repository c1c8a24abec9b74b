"""Nearest-timestamp, positional, full outer and recursive joins."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.lineage import cut


def nearest_in_time(ref: DataFrame, other: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """ref(keys, idx, ts) to the nearest of other(keys, idx, ts) within the tolerance, which is inclusive.

    Ties go to the later stamp; of equal later stamps to the lowest idx, of equal earlier ones to the highest.  An
    equi-join on time buckets as wide as the tolerance (each other row in three) keeps it a hash join at any size."""
    b = other.select(*keys, F.col("idx").alias("other_idx"), F.col("ts").alias("other_ts"), F.explode(F.expr(f"transform(array(-1, 0, 1), d -> cast(floor(ts / {tolerance!r}) as long) + d)")).alias("bucket"))
    a = ref.withColumn("bucket", F.floor(F.col("ts") / tolerance).cast("long"))
    near = a.join(b, [*keys, "bucket"]).withColumn("offset_s", F.col("other_ts") - F.col("ts")).where(F.abs("offset_s") <= tolerance)
    rank = F.struct(F.abs("offset_s"), -F.col("other_ts"), F.when(F.col("other_ts") >= F.col("ts"), F.col("other_idx")).otherwise(-F.col("other_idx")))
    best = near.groupBy(*keys, "idx", "ts").agg(F.min_by(F.struct("other_idx", "other_ts", "offset_s"), rank).alias("m"))
    return best.select(*keys, "idx", "ts", "m.other_idx", "m.other_ts", "m.offset_s")


def synchronise(ref: DataFrame, others: dict[str, DataFrame], keys: list[str], tolerance: float) -> DataFrame:
    """Reference rows that every other camera matches, with each one's idx and offset."""
    out = ref
    for name, other in others.items():
        m = nearest_in_time(ref, other, keys, tolerance).select(*keys, "idx", F.col("other_idx").alias(f"{name}_idx"), F.col("offset_s").alias(f"{name}_offset_s"))
        out = out.join(m, [*keys, "idx"])
    return out


def drop_report(n_ref: int, n_synced: int) -> tuple[float, str]:
    """Share of reference frames dropped, and its level: error above 0.1, warning above 0."""
    share = 1 - n_synced / n_ref if n_ref else 0.0
    return share, "error" if share > 0.1 else "warning" if share > 0 else "ok"


def by_position(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The fallback where stamps are missing: equal idx, offset 0 where a stamp is missing, no tolerance."""
    r = right.select(*keys, "idx", F.col("ts").alias("other_ts"))
    return left.join(r, [*keys, "idx"]).withColumn("offset_s", F.coalesce(F.col("other_ts") - F.col("ts"), F.lit(0.0)))


def offset_stats(df: DataFrame, keys: list[str], offset: str) -> DataFrame:
    """Mean, population deviation and largest absolute offset; zeros where there is none."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(offset), F.lit(0.0)).alias("offset_mean"), F.coalesce(F.stddev_pop(offset), F.lit(0.0)).alias("offset_std"), F.coalesce(F.max(F.abs(offset)), F.lit(0.0)).alias("offset_max"), F.count(offset).alias("n"))


def artifact_diff(left: DataFrame, right: DataFrame, keys: list[str], digest: str = "digest") -> DataFrame:
    """Full outer join of digests by key: match, mismatch, missing_left or missing_right."""
    a, b = left.select(*keys, F.col(digest).alias("left_digest")), right.select(*keys, F.col(digest).alias("right_digest"))
    status = F.when(F.col("left_digest").isNull(), "missing_left").when(F.col("right_digest").isNull(), "missing_right").when(F.col("left_digest") == F.col("right_digest"), "match").otherwise("mismatch")
    return a.join(b, keys, "full_outer").withColumn("status", status)


def propagate(states: DataFrame, upstream: DataFrame, depth: int | None = None) -> DataFrame:
    """states(stage, state), upstream(stage, needs): a tripped upstream degrades all but tripped stages, a degraded or
    recovering one only healthy stages; to the fixed point, or as far as ``depth`` steps.

    Semi-naive: in each round only what changed in the one before reaches further, and a stage changes once, so cycles end too.  Needs
    that no state is known of are healthy; repeated edges change nothing."""
    now = cut(states.select("stage", "state"))
    edges = cut(upstream.select("stage", "needs").where("stage is not null and needs is not null").distinct())
    changed = now.where("state in ('tripped', 'degraded', 'recovering')").select("stage", F.expr("state = 'tripped'").alias("tripped"))
    open_ = now.where("coalesce(state, '') not in ('tripped', 'degraded')")
    for _ in count() if depth is None else range(depth):
        reached = edges.join(changed.select(F.col("stage").alias("needs"), "tripped"), "needs").groupBy("stage").agg(F.max("tripped").alias("tripped"))
        hit = F.col("tripped").isNotNull() & (F.col("tripped") | (F.col("state") == "healthy"))
        told = cut(open_.join(reached, "stage", "left").select("stage", "state", F.coalesce(hit, F.lit(False)).alias("hit")))
        open_, changed = told.where("not hit").select("stage", "state"), told.where("hit").select("stage", F.lit(False).alias("tripped"))
        if changed.isEmpty():
            break
    rest = open_.select("stage", F.lit(True).alias("_open"))
    kept = F.coalesce("_open", F.col("state").isin("tripped", "degraded"), F.lit(False))
    return now.join(rest, "stage", "left").select("stage", F.when(kept, F.col("state")).otherwise("degraded").alias("state"))


def unknown_keys(given: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    return given.select(key).distinct().join(allowed.select(key), key, "left_anti")


def ratio_test(distances: DataFrame, ratio: float = 0.8) -> DataFrame:
    """(pair, a, b, distance) to mutual best matches whose best distance is below ratio times the second best."""
    forward = Window.partitionBy("pair", "a").orderBy("distance", "b")
    back = Window.partitionBy("pair", "b").orderBy("distance", "a")
    ranked_ = distances.withColumn("second", F.lead("distance").over(forward)).withColumn("r", F.row_number().over(forward)).withColumn("q", F.row_number().over(back))
    return ranked_.where((F.col("r") == 1) & (F.col("q") == 1) & (F.col("second").isNull() | (F.col("distance") < ratio * F.col("second")))).select("pair", "a", "b", "distance")


def positional_pairs(truth: DataFrame, estimate: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The i-th row of each sequence beside the i-th of its estimate; what the longer one has beyond the shorter is left out.

    Columns of the estimate other than the keys get the suffix _est."""
    w = Window.partitionBy(*keys).orderBy(*order)
    number = lambda df: df.withColumn("idx", F.row_number().over(w) - 1)
    est = number(estimate)
    est = est.select(*keys, "idx", *[F.col(c).alias(f"{c}_est") for c in estimate.columns if c not in keys])
    return number(truth).join(est, [*keys, "idx"])


def keyed_lookup(asked: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Every asked row with the columns of its key's row, and ``found``; rows that aren't found are kept, to be counted and skipped."""
    return asked.join(store.withColumn("_there", F.lit(True)), key, "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")
