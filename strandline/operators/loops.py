"""Loop-closure validation: component scores, rejection reasons, confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Reasons against a loop, in the order they are listed in, and gates in the order they are tried in.
LOOP_REASONS = ("match_count", "inlier_ratio", "reprojection_error", "temporal_separation", "temporal_out_of_range", "rotation_error", "translation_error", "geometric_score", "temporal_score", "combined_score")
GATES = ("low_inlier_count", "low_inlier_ratio", "low_parallax", "cheirality_inliers", "cheirality_ratio")


def score_loops(df: DataFrame, min_matches: int = 30, min_ratio: float = 0.55, max_reprojection: float = 2.5, min_gap_s: float = 1.0, max_gap_s: float | None = None, max_rotation: float | None = 10.0, max_translation: float | None = 0.5, min_geometric: float = 0.7, min_temporal: float = 0.6, min_combined: float = 0.75, weight: float = 0.7, temporal_weight: float = 0.3) -> DataFrame:
    """Geometric (mean of up to five components of 0 to 1), temporal and combined scores, the reasons against, and acceptance.

    Columns as in loop samples; rotation and translation errors that are null, or without a limit, leave their component out.
    A gap below min_gap_s scores 0 in time; one beyond max_gap_s fades to 0 at twice that."""
    c = F.col
    one = lambda x: F.least(F.lit(1.0), x)
    fades = lambda name, most: F.greatest(F.lit(0.0), 1 - c(name) / most)
    limited = [(n, m) for n, m in (("rotation_error_deg", max_rotation), ("translation_error", max_translation)) if m is not None]
    ratio = F.coalesce(F.try_divide(c("inlier_count"), c("match_count")), F.lit(0.0))
    parts = [one(c("inlier_ratio") / min_ratio), fades("mean_reprojection_error", max_reprojection), one(c("match_count") / min_matches)]
    parts += [F.when(c(n).isNotNull(), fades(n, m)) for n, m in limited]
    rows = df.withColumns({"inlier_ratio": ratio, "gap_s": F.abs(c("query_timestamp_s") - c("candidate_timestamp_s"))})
    rows = rows.withColumn("parts", F.filter(F.array(*parts), lambda x: x.isNotNull()))
    in_time = F.lit(1.0) if max_gap_s is None else F.when(c("gap_s") <= max_gap_s, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (c("gap_s") - max_gap_s) / max_gap_s))
    rows = rows.withColumns({"geometric": F.aggregate("parts", F.lit(0.0), lambda s, x: s + x) / F.size("parts"), "temporal": F.when(c("gap_s") < min_gap_s, 0.0).otherwise(in_time)}).drop("parts")
    rows = rows.withColumn("combined", (weight * c("geometric") + temporal_weight * c("temporal")) / (weight + temporal_weight))
    limits = dict(limited)
    above = lambda n: c(n) > limits[n] if n in limits else F.lit(False)
    tests = (c("match_count") < min_matches, c("inlier_ratio") < min_ratio, c("mean_reprojection_error") > max_reprojection, c("gap_s") < min_gap_s, F.lit(False) if max_gap_s is None else c("gap_s") > max_gap_s, above("rotation_error_deg"), above("translation_error"), c("geometric") < min_geometric, c("temporal") < min_temporal, c("combined") < min_combined)
    reasons = F.array(*[F.when(test, name) for name, test in zip(LOOP_REASONS, tests, strict=True)])
    return rows.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull())).withColumn("accepted", F.size("reasons") == 0)


def confusion(df: DataFrame, keys: list[str], expected: str = "expected_match", predicted: str = "accepted") -> DataFrame:
    e, p = F.col(expected), F.col(predicted)
    out = df.groupBy(*keys).agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(~e & ~p).alias("tn"), F.count_if(e & ~p).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    return out.withColumns({"accuracy": share(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")), "precision": share(c("tp"), c("tp") + c("fp")), "recall": share(c("tp"), c("tp") + c("fn"))})


def first_failing_gate(df: DataFrame, min_inliers: int = 30, min_ratio: float = 0.25, min_parallax: float = 1.0, min_cheirality_inliers: int = 12, min_cheirality: float = 0.6) -> DataFrame:
    """failure_reason of pose estimates by the first gate that fails; the last two hold for method essential only."""
    c, essential = F.col, F.col("method") == "essential"
    tests = (c("inliers") < min_inliers, c("inlier_ratio") < min_ratio, c("parallax") < min_parallax, essential & (c("cheirality_inliers") < min_cheirality_inliers), essential & (c("cheirality_ratio") < min_cheirality))
    reason = F.lit(None).cast("string")
    for name, test in reversed(list(zip(GATES, tests, strict=True))):
        reason = F.when(test, name).otherwise(reason)
    return df.withColumn("failure_reason", reason)


def tracking_status(matches: Column, ratio: Column) -> Column:
    return F.when(matches < 40, "warning").when(ratio < 0.2, "error").when(ratio < 0.35, "warning").otherwise("ok")
