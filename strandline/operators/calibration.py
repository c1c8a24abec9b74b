"""Camera calibration and dataset checks: rule tables over rows of facts, one issue a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import scalars


def projections(lines: DataFrame) -> DataFrame:
    """path, camera, k (9 numbers), t (3 numbers) of the 3x4 entries of calibration lines; of a camera's keys the last wins."""
    rows = lines.withColumn("camera", scalars.camera_name(F.col("key"))).where("camera is not null and size(data) = 12")
    last = rows.groupBy("path", "camera").agg(F.max_by("data", "line_no").alias("p"))
    return last.select("path", "camera", scalars.projection_intrinsics(F.col("p")).alias("k"), "p").select("path", "camera", "k", scalars.projection_offset(F.col("k"), F.col("p")).alias("t"))


def rig_projection(lines: DataFrame, number: int) -> DataFrame:
    """path, data of one camera's matrix: PN, else P_rect_0N, else P_rect_N."""
    keys = [f"P{number}", f"P_rect_0{number}", f"P_rect_{number}"]
    rank = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    return lines.where(F.col("key").isin(keys) & (F.size("data") == 12)).groupBy("path").agg(F.min_by("data", rank).alias("data"))


def condition_number(k: Column) -> Column:
    """Ratio of the singular values of a 3x3 matrix, in Arrow batches."""

    @F.pandas_udf("double")
    def cond(batch: pd.Series) -> pd.Series:
        return pd.Series([float(np.linalg.cond(np.asarray(m, dtype=float).reshape(3, 3))) for m in batch], dtype=float)

    return cond(k)


def _issues(rules: list[tuple[str, str, Column]]) -> Column:
    """The (level, rule) structs of the conditions that hold, in order."""
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for level, rule, bad in rules])
    return F.filter(found, lambda i: i.isNotNull())


def check_cameras(cameras: DataFrame, keys: list[str], reference: str | None = None) -> DataFrame:
    """keys, camera, level, rule: what is wrong with each camera of a rig.

    ``cameras`` has keys, camera, k (9), t (3) and optionally r (9, identity if absent).  The reference is the named camera,
    else the first by name; its own baseline isn't judged.  A singular camera matrix is an error."""
    c = F.col
    df = cameras if "r" in cameras.columns else cameras.withColumn("r", F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]))
    whole = Window.partitionBy(*keys)
    ref = F.min_by(c("t"), F.when(c("camera") == reference, F.lit("")).otherwise(c("camera")) if reference else c("camera")).over(whole)
    name = F.lit(reference) if reference else F.min("camera").over(whole)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    df = df.withColumns({"ref_t": ref, "ref_name": name})
    df = df.withColumns({"baseline": length(F.zip_with("t", "ref_t", lambda a, b: a - b)), "t_norm": length(c("t")), "cond": condition_number(c("k")), "det_r": scalars.determinant(c("r"))})
    product = [sum(c("r")[3 * m + i] * c("r")[3 * m + j] for m in range(3)) - (1.0 if i == j else 0.0) for i in range(3) for j in range(3)]
    skewed = F.sqrt(sum((F.pow(p, F.lit(2.0)) for p in product), F.lit(0.0)))
    k = c("k")
    rules = [
        ("error", "focal_length", (k[0] <= 0) | (k[4] <= 0)),
        ("warning", "skew", F.abs(k[1]) > 1e-3),
        ("warning", "last_element", F.abs(k[8] - 1.0) > 1e-3 + 1e-5),
        ("warning", "principal_point", (k[2] < 0) | (k[5] < 0)),
        ("warning", "condition", c("cond") > 1e6),
        ("error", "singular", c("t").isNull()),
        ("error", "rotation", (skewed > 1e-2) | (F.abs(c("det_r") - 1.0) > 1e-2 + 1e-5)),
        ("warning", "translation", c("t_norm") > 10.0),
        ("error", "baseline_zero", (c("camera") != c("ref_name")) & (c("baseline") <= 0)),
        ("warning", "baseline_small", (c("camera") != c("ref_name")) & (c("baseline") > 0) & (c("baseline") < 1e-3)),
    ]
    return df.select(*keys, "camera", F.inline(_issues(rules)))


def check_datasets(facts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, level, rule of facts rows: present, n_images, n_stamps, n_calibrations, n_truth (null: not asked for).

    A sequence that is absent has that one issue, as nothing below it can be judged."""
    c, here = F.col, F.coalesce(F.col("present"), F.lit(False))
    rules = [
        ("error", "absent", ~here),
        ("error", "no_images", here & (F.coalesce(c("n_images"), F.lit(0)) == 0)),
        ("error", "no_ground_truth", here & (c("n_truth") == 0)),
        ("warning", "no_stamps", here & (F.coalesce(c("n_stamps"), F.lit(0)) == 0)),
        ("warning", "stamp_count", here & (c("n_images") > 0) & (c("n_stamps") > 0) & (c("n_images") != c("n_stamps"))),
        ("warning", "no_calibration", here & (F.coalesce(c("n_calibrations"), F.lit(0)) == 0)),
    ]
    return facts.select(*keys, F.inline(_issues(rules)))


def dataset_verdict(facts: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ok (no error), errors, warnings for every facts row, those without issue included."""
    counted = issues.groupBy(*keys).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    out = facts.select(*keys).distinct().join(counted, keys, "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("ok", F.col("errors") == 0)
