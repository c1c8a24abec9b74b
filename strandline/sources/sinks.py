"""Sinks: partitioned Parquet, reports as JSON and long CSV, upserts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.ordered import replace_key


def _not_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("nothing to write")
    return df


def write_run(df: DataFrame, path: str, seed: int, config_hash: str, by: tuple[str, ...] = ("run_id",)) -> None:
    """Parquet partitioned by run, with seed and config hash as columns; empty bundles are an error."""
    _not_empty(df).withColumns({"seed": F.lit(seed), "config_hash": F.lit(config_hash)}).write.mode("append").partitionBy(*by).parquet(path)


def write_report_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, columns in name order."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def long_report(df: DataFrame, sequence: str) -> DataFrame:
    """sequence, metric, value rows, with the means over all sequences as sequence ``aggregate``."""
    names = [c for c in df.columns if c != sequence]
    long = df.select(F.col(sequence).cast("string").alias("sequence"), *[F.col(c).cast("double").alias(c) for c in names]).unpivot("sequence", names, "metric", "value")
    return long.unionByName(long.groupBy("metric").agg(F.avg("value").alias("value")).withColumn("sequence", F.lit("aggregate")))


def write_report_csv(df: DataFrame, sequence: str, path: str) -> None:
    long_report(df, sequence).select("sequence", "metric", "value").write.mode("overwrite").option("header", "true").csv(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small control file, replaced as a whole, on whatever file system the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def put_baseline(spark: SparkSession, path: str, key: str, metrics: dict[str, float], config_hash: str, updated_at: str, metadata: dict | None = None) -> None:
    """Sets a key of a baseline store, one JSON object; an absent store is made."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    store = json.loads(spark.read.text(path, wholetext=True).first()["value"]) if there else {"version": 1, "baselines": {}}
    store.setdefault("baselines", {})[key] = {"metrics": metrics, "config_hash": config_hash, "updated_at": updated_at, "metadata": metadata or {}}
    write_text(spark, path, json.dumps(store, indent=2))


def upsert(store: DataFrame, new: DataFrame, path: str, key: str = "key") -> None:
    """Writes the store with the new rows' keys replaced to another folder, so that the store is never read while written."""
    replace_key(store, new, key).write.mode("overwrite").parquet(path)


#: Fixed value: the version of stored maps.
MAP_VERSION = 1


def write_map(frames: DataFrame, vocab: list[list[float]], path: str) -> None:
    """A map of key frames (frame_id, pose of 16, keypoints of 2 each, descriptors, hist) with its vocabulary and metadata.

    Malformed frames fail the write.  The digest sums two hashes over frames, so no task gathers them and order is no matter."""
    _not_empty(frames)
    sound = (F.size("pose") == 16) & F.forall("keypoints", lambda k: F.size(k) == 2) & (F.size("keypoints") == F.size("descriptors")) & (F.size("hist") == len(vocab))
    whole = F.when(F.coalesce(sound, F.lit(False)), F.col("frame_id")).otherwise(F.raise_error(F.lit("pose, keypoints, descriptors and hist must align")))
    frames.withColumn("frame_id", whole).write.mode("overwrite").parquet(f"{path}/keyframes")
    spark = frames.sparkSession
    spark.createDataFrame(list(enumerate(vocab)), "word int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")
    sums = [F.sum(F.xxhash64(F.lit(seed), *sorted(frames.columns)).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    n, a, b = spark.read.parquet(f"{path}/keyframes").agg(F.count("*"), *sums).first()
    meta = {"schema_version": MAP_VERSION, "num_keyframes": n, "snapshot_digest": f"{a}:{b}"}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
