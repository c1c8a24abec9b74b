"""Readers: trajectories as text or NPZ, JSON reports, calibration, frame catalogues, GPS tracks."""

from __future__ import annotations

import hashlib
import io
import json
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from strandline.functions.canonical import canonical, stable_hash
from strandline.functions.scalars import parsed_time
from strandline.sources.arrays import array_items
from strandline.sources.sinks import MAP_VERSION

#: The columns of positions in twelve-number poses, and the radius of GPS projection in metres.
POSE_COLUMNS, EARTH_RADIUS = (3, 7, 11), 6_378_137.0


def columns_of(format_name: str, cols: str | None) -> list[int]:
    """kitti_odom has fixed columns; other formats need them as "0,1"."""
    if format_name == "kitti_odom":
        return list(POSE_COLUMNS)
    if not cols:
        raise ValueError("columns are needed for this format")
    return [int(x) for x in cols.split(",")]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, idx, line of text files, idx by place in the file.  Whole files are split row by row, so each is read by one
    task; a listing of many files is as parallel as the files are many."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def text_trajectory(spark: SparkSession, path: str, cols: list[int]) -> DataFrame:
    """path, idx, coords; blank lines, lines that begin with # and lines with too few fields are left out."""
    rows = numbered_lines(spark, path).where((F.trim("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.withColumn("f", F.split(F.trim("line"), r"\s+")).where(F.size("f") > max(cols))
    w = Window.partitionBy("path").orderBy("line_no")
    return rows.select("path", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.array(*[F.element_at("f", c + 1).cast("double") for c in cols]).alias("coords"))


def json_items(spark: SparkSession, path: str, key: str, item_schema: str, least: int = 0) -> DataFrame:
    """The rows of the array under ``key`` of whole-file JSON objects; files without such an array, or with fewer items than
    ``least`` in it, are an error."""
    whole = spark.read.schema(f"`{key}` array<struct<{item_schema}>>").json(path, multiLine=True, mode="FAILFAST")
    checked = whole.select(F.when(F.col(key).isNull(), F.raise_error(F.lit(f"no array of that name: {key}"))).when(F.size(key) < least, F.raise_error(F.lit(f"too few items in {key}"))).otherwise(F.col(key)).alias(key))
    return checked.select(F.inline(key))


def telemetry_events(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """``split``: files larger than a task holds, read in parts; then files without events give no rows."""
    schema = "name string, duration_s double, timestamp string, metadata map<string,string>"
    return array_items(spark, path, "events", schema) if split else json_items(spark, path, "events", schema)


def frame_diagnostics(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Missing numbers are 0, method empty, status unknown; files without frames are an error, unless read in parts (``split``)."""
    read = array_items if split else partial(json_items, least=1)
    rows = read(spark, path, "entries", "frame_id long, timestamp double, match_count int, inliers int, method string, inlier_ratio double, median_parallax double, score double, status string, failure_reason string")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("frame_id", "timestamp", "match_count", "inliers", "inlier_ratio", "median_parallax", "score")}
    return rows.withColumns(filled | {"method": F.coalesce("method", F.lit("")), "status": F.coalesce("status", F.lit("unknown"))})


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def whole_text(spark: SparkSession, path: str) -> str:
    """A small control file, such as a config."""
    return spark.read.text(path, wholetext=True).first()["value"]


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """name, recorded_at, metric, value of metric files or folders; files without metrics are an error."""
    rows = spark.read.schema("name string, recorded_at string, metrics map<string,double>").json(path, multiLine=True)
    held = F.when(F.coalesce(F.size("metrics"), F.lit(0)) < 1, F.raise_error(F.lit("no metrics"))).otherwise(F.col("metrics"))
    return rows.select("name", "recorded_at", F.explode(held).alias("metric", "value"))


def json_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file of JSON objects with the fields asked for; what is no such JSON, or holds no object, is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("report"))
    return whole.select("path", F.when(F.col("report").isNull(), F.raise_error(F.lit("no JSON object"))).otherwise(F.col("report")).alias("report")).select("path", "report.*")


def baselines(spark: SparkSession, path: str) -> DataFrame:
    """key, metric, value, config_hash, updated_at; an absent store is empty."""
    schema = "key string, metric string, value double, config_hash string, updated_at string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema("version int, baselines map<string,struct<metrics:map<string,double>,config_hash:string,updated_at:string>>").json(path, multiLine=True)
    rows = rows.select(F.explode("baselines").alias("key", "b"))
    return rows.select("key", F.explode("b.metrics").alias("metric", "value"), "b.config_hash", "b.updated_at").select("key", "metric", "value", "config_hash", "updated_at")


def documents_as_variant(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("report"))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, key, rows, cols, data of "key: v v v" lines; 9 numbers are 3x3, 12 are 3x4, others flat."""
    lines = numbered_lines(spark, path).where(~F.col("line").startswith("#") & F.col("line").contains(":"))
    pair = F.split("line", ":", 2)
    data = F.transform(F.split(F.trim(pair[1]), r"\s+"), lambda v: v.try_cast("double"))
    out = lines.select("path", "line_no", F.trim(pair[0]).alias("key"), data.alias("data")).where(F.forall("data", lambda v: v.isNotNull()))
    n = F.size("data")
    return out.select("path", "line_no", "key", F.when(n.isin(9, 12), 3).otherwise(1).alias("rows"), F.when(n == 9, 3).when(n == 12, 4).otherwise(n).alias("cols"), "data")


def stamps(spark: SparkSession, path: str, relative: bool) -> DataFrame:
    """path, idx, ts seconds of one stamp a line; relative: to each file's first parsed stamp.  Bad lines are left out."""
    rows = numbered_lines(spark, path).where(F.trim("line") != "").withColumn("t", parsed_time(F.trim("line")).cast("double")).where("t is not null")
    w = Window.partitionBy("path").orderBy("line_no")
    t = F.col("t") - F.first("t").over(w) if relative else F.col("t")
    return rows.select("path", (F.row_number().over(w) - 1).cast("long").alias("idx"), t.alias("ts"))


def frame_catalogue(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """idx, path by name order within each folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    w = Window.partitionBy(F.regexp_extract("path", "^(.*)/", 1)).orderBy("path")
    return files.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


def gps_positions(spark: SparkSession, path: str) -> DataFrame:
    """idx, x, y, z metres from the first fix: one file a frame, latitude, longitude and altitude first on its first line."""
    f = F.split(F.trim(F.split("value", "\n")[0]), r"\s+")
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", "^(.*)/", 1).alias("folder"), F.col("_metadata.file_path").alias("p"), *[f[i].cast("double").alias(n) for i, n in enumerate(("lat", "lon", "alt"))])
    w = Window.partitionBy("folder").orderBy("p")
    first = lambda c: F.first(c).over(w)
    return rows.select("folder", (F.row_number().over(w) - 1).cast("long").alias("idx"), (F.radians(F.col("lon") - first("lon")) * EARTH_RADIUS * F.cos(F.radians(first("lat")))).alias("x"), (F.radians(F.col("lat") - first("lat")) * EARTH_RADIUS).alias("y"), (F.col("alt") - first("alt")).alias("z"))


def npz_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """name, idx, frame_id, timestamp, pose (16 numbers) of NPZ files with poses and timestamps; read through Spark's own
    file source, so any store serves."""

    def task(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    poses, times = z["poses"], z["timestamps"]
                    ids = z["frame_ids"] if "frame_ids" in z.files and len(z["frame_ids"]) else None
                if poses.ndim != 3 or poses.shape[1:] != (4, 4) or len(times) != len(poses) or ids is not None and len(ids) != len(poses):
                    raise ValueError(f"arrays of unequal length or shape in {file}")
                name = file.rpartition("/")[2].removesuffix(".npz")
                yield pd.DataFrame({"name": name, "idx": range(len(poses)), "frame_id": ids if ids is not None else [None] * len(poses), "timestamp": times.astype(float), "pose": poses.reshape(-1, 16).astype(float).tolist()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(task, "name string, idx long, frame_id long, timestamp double, pose array<double>")


def map_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[float]]]:
    """Key frames and vocabulary of a stored map; another version or another number of frames is an error."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    if meta.get("schema_version") != MAP_VERSION:
        raise ValueError("unknown version of stored map")
    frames = spark.read.parquet(f"{path}/keyframes")
    if meta.get("num_keyframes", 0) < 1 or frames.count() != meta["num_keyframes"]:
        raise ValueError("a stored map needs as many key frames as its metadata says")
    return frames, [list(r["centre"]) for r in spark.read.parquet(f"{path}/vocabulary").orderBy("word").collect()]


#: The folders of a run's artifacts with their kinds, and the keys that differ between equal runs.
ARTIFACTS = {"trajectories": ("trajectory", "npz"), "metrics": ("metrics", "json"), "diagnostics": ("diagnostics", "json"), "telemetry": ("telemetry", "json")}
VOLATILE, VOLATILE_EVENT = ("recorded_at", "created_at"), ("timestamp", "memory_delta_bytes", "memory_current_bytes", "memory_peak_bytes")


def _artifact_digest(kind: str, content: bytes) -> str:
    if kind == "trajectory":
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            ids = z["frame_ids"] if "frame_ids" in z.files and len(z["frame_ids"]) else None
            return stable_hash({"poses": z["poses"], "timestamps": z["timestamps"], "frame_ids": ids})
    report = json.loads(content)
    if kind == "telemetry" and "events" in report:
        report["events"] = [{k: v for k, v in e.items() if k not in VOLATILE_EVENT} for e in report["events"] if isinstance(e, dict)]
    return stable_hash(report, VOLATILE)


def run_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """artifact_type, name, digest of a run's files and of its maps (folders below ``maps``); absent folders hold nothing."""
    out = spark.createDataFrame([], "artifact_type string, name string, digest string")
    for below, (kind, ending) in ARTIFACTS.items():
        if not exists(spark, f"{folder}/{below}"):
            continue

        def task(batches, kind=kind, ending=ending):
            for pdf in batches:
                names = [p.rpartition("/")[2].removesuffix(f".{ending}") for p in pdf["path"]]
                yield pd.DataFrame({"artifact_type": kind, "name": names, "digest": [_artifact_digest(kind, bytes(b)) for b in pdf["content"]]})

        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").load(f"{folder}/{below}").select("path", "content")
        out = out.unionByName(files.mapInPandas(task, "artifact_type string, name string, digest string"))
    if not exists(spark, f"{folder}/maps"):
        return out

    @F.pandas_udf("string")
    def entry(path: pd.Series, content: pd.Series) -> pd.Series:
        def one(p: str, b: bytes) -> str:
            if p.rpartition("/")[2] == "map_bundle.json":
                return canonical({"path": p, "payload": {k: v for k, v in json.loads(b).items() if k not in VOLATILE}})
            return canonical({"path": p, "sha256": hashlib.sha256(b).hexdigest()})

        return pd.Series([one(p, bytes(b)) for p, b in zip(path, content, strict=True)])

    place = F.regexp_extract("path", "/maps/([^/]+)/", 1), F.regexp_extract("path", "/maps/[^/]+/(.*)$", 1)
    maps = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/maps").select(place[0].alias("name"), place[1].alias("file"), "content").where("name <> ''")
    maps = maps.select("name", F.struct(F.split("file", "/").alias("at"), entry("file", "content").alias("e")).alias("r"))
    whole = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["e"]), ","), F.lit("]"))
    return out.unionByName(maps.groupBy("name").agg(F.sha2(whole, 256).alias("digest")).select(F.lit("map").alias("artifact_type"), "name", "digest"))


class SyntheticFrames(DataSource):
    """Data source ``frames``: option n rows (frame_id, timestamp at option fps), one partition for each option chunk."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "frame_id long, timestamp double"

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(self.options)


class _FrameReader(DataSourceReader):
    def __init__(self, options):
        self.n, self.fps, self.chunk = int(options.get("n", 100)), float(options.get("fps", 30)), int(options.get("chunk", 1_000_000))

    def partitions(self):
        return [InputPartition(k) for k in range(0, self.n, self.chunk)]

    def read(self, partition):
        for k in range(partition.value, min(self.n, partition.value + self.chunk)):
            yield k, k / self.fps
