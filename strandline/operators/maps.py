"""Maps of key frames: histograms, relocalization, windows, feature selection, pixel masks and patch moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators.similarity import assign_centroids


def build_map(frames: DataFrame, descriptors: DataFrame, vocab: list[list[float]]) -> DataFrame:
    """frames (frame_id, ...) with hist, the share of each word among their (frame_id, v) descriptors; zeros without any."""
    words = assign_centroids(descriptors, vocab).groupBy("frame_id", "word").agg(F.count("*").alias("n"))
    per = words.groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("m"), F.sum("n").alias("total"))
    share = F.transform(F.sequence(F.lit(0), F.lit(len(vocab) - 1)), lambda w: F.coalesce(F.col("m")[w] / F.col("total"), F.lit(0.0)))
    return frames.join(per, "frame_id", "left").withColumn("hist", share).drop("m", "total")


def relocalize(candidates: DataFrame, key: str, most: int = 5, least_score: float = 0.75, least_matches: int = 60, least_inliers: int = 30) -> DataFrame:
    """The best verified candidate of each query: among its first ``most`` by score, those at every limit; then most inliers,
    higher score, smaller frame_id."""
    near = Window.partitionBy(key).orderBy(F.desc("score"), "frame_id")
    kept = candidates.withColumn("r", F.row_number().over(near)).where(F.col("r") <= most).drop("r")
    kept = kept.where((F.col("score") >= least_score) & (F.col("match_count") >= least_matches) & (F.col("inliers") >= least_inliers))
    best = Window.partitionBy(key).orderBy(F.desc("inliers"), F.desc("score"), "frame_id")
    return kept.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def recent_keyframes(df: DataFrame, keys: list[str], order: str, value: Column, n: int = 5) -> DataFrame:
    """window: the values of the newest n rows up to each, oldest first; bounded by n."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)
    return df.withColumn("window", F.collect_list(value).over(w))


def strongest(df: DataFrame, keys: list[str], response: str, tie: list[str], n: int = 1000) -> DataFrame:
    """The n rows of largest response of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(response), *tie)
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def closest(df: DataFrame, keys: list[str], distance: str, tie: list[str], n: int = 500) -> DataFrame:
    """The n matches of smallest distance of each key."""
    w = Window.partitionBy(*keys).orderBy(distance, *tie)
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def match_statistics(df: DataFrame, keys: list[str], distance: str) -> DataFrame:
    c = F.col(distance)
    return df.groupBy(*keys).agg(F.count(c).alias("match_count"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean_distance"), F.coalesce(F.median(c), F.lit(0.0)).alias("median_distance"))


def unmasked(points: DataFrame, changes: DataFrame, keys: list[str], least: float = 25, reach: int = 2) -> DataFrame:
    """The points (x, y) whose whole pixel lies farther than ``reach`` from every pixel (px, py) that changed by ``least``.

    Changed pixels are spread over their neighbourhood and hash-joined; a pixel is one row whatever it is near to."""
    near = F.sequence(F.lit(-reach), F.lit(reach))
    hot = changes.where(F.abs("diff") >= least).select(*keys, "px", "py").distinct()
    hot = hot.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    hot = hot.select(*keys, (F.col("px") + F.col("dx")).cast("long").alias("qx"), (F.col("py") + F.col("dy")).cast("long").alias("qy")).distinct()
    at = points.withColumns({"qx": F.col("x").cast("long"), "qy": F.col("y").cast("long")})
    return at.join(hot, [*keys, "qx", "qy"], "left_anti").drop("qx", "qy")


def patch_moments(pixels: DataFrame, keys: list[str], size: int = 31) -> DataFrame:
    """mass, cx, cy, angle_deg of patches of pixels (px, py, value): all 0 without mass; the angle is taken from the middle."""
    v = F.col("value").cast("double")
    m = pixels.groupBy(*keys).agg(F.sum(v).alias("mass"), F.sum(F.col("px") * v).alias("m10"), F.sum(F.col("py") * v).alias("m01"))
    cx, cy = (F.coalesce(F.try_divide(F.col(n), F.col("mass")), F.lit(0.0)) for n in ("m10", "m01"))
    return m.select(*keys, "mass", cx.alias("cx"), cy.alias("cy")).withColumn("angle_deg", F.degrees(F.atan2(F.col("cy") - size // 2, F.col("cx") - size // 2)))


def ordered_edges(edges: DataFrame, keys: list[str], payload: Column) -> DataFrame:
    """place of each edge within its graph by i, j, s, weight and the hash of its payload; absent numbers count as 0."""
    at = [F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)) for c, t in (("i", "long"), ("j", "long"), ("s", "double"), ("weight", "double"))]
    w = Window.partitionBy(*keys).orderBy(*at, F.sha2(payload, 256))
    return edges.withColumn("place", F.row_number().over(w) - 1)
