"""Where a sequence's frames, stamps and calibration lie, the frames in order, and decoding by a function of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators.ordered import first_n
from strandline.sources import readers

#: The folders a camera's frames may be in, and the calibration files, in the order they are tried.
CAMERA_FOLDERS = {f"image_{i}": (f"image_{i}", f"image_0{i}") for i in range(4)}
CALIBRATION_FILES = ("calib.txt", "calib_cam_to_cam.txt")


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in name order, on whatever file system it names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(str(s.getPath().toString()) for s in found or ())


def sequence_folder(spark: SparkSession, root: str, sequence: str) -> str:
    """root/sequences/name, root/name or the first root/*/name."""
    for pattern in (f"{root}/sequences/{sequence}", f"{root}/{sequence}", f"{root}/*/{sequence}"):
        if found := listed(spark, pattern):
            return found[0]
    raise FileNotFoundError(f"no sequence {sequence} under {root}")


def image_folder(spark: SparkSession, folder: str, camera: str = "image_2") -> str:
    """The first of a camera's folders, or of their data folders, that holds frames."""
    for alias in CAMERA_FOLDERS.get(camera, (camera,)):
        for path in (f"{folder}/{alias}", f"{folder}/{alias}/data"):
            if listed(spark, f"{path}/*.png"):
                return path
    raise FileNotFoundError(f"no frames of {camera} in {folder}")


def calibration_file(spark: SparkSession, folder: str, root: str) -> str | None:
    """A sequence's own calibration, else that beside it, unless beside it is the root; None where there is none."""
    parent = folder.rpartition("/")[0]
    places = [folder] if parent.rstrip("/").endswith(root.rstrip("/")) else [folder, parent]
    return next((f"{p}/{n}" for p in places for n in CALIBRATION_FILES if readers.exists(spark, f"{p}/{n}")), None)


def sequence_stamps(spark: SparkSession, folder: str, images: str) -> DataFrame:
    """idx, ts: seconds of times.txt as they are, else of the frames' timestamps.txt from its first parsed line on."""
    if readers.exists(spark, f"{folder}/times.txt"):
        lines = readers.numbered_lines(spark, f"{folder}/times.txt").where(F.trim("line") != "")
        return lines.select((F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1).cast("long").alias("idx"), F.trim("line").cast("double").alias("ts"))
    for place in (images, images.removesuffix("/data")):
        if readers.exists(spark, f"{place}/timestamps.txt"):
            return readers.stamps(spark, f"{place}/timestamps.txt", True).select("idx", "ts")
    return spark.createDataFrame([], "idx long, ts double")


def sequence_frames(spark: SparkSession, root: str, sequence: str, camera: str = "image_2", most: int | None = None) -> DataFrame:
    """idx, path, ts of a sequence's frames by name; ts by place, null beyond the stamps; at most the first ``most``."""
    folder = sequence_folder(spark, root, sequence)
    images = image_folder(spark, folder, camera)
    frames = readers.frame_catalogue(spark, images).where(F.regexp_extract("path", "/([^/]+)/[^/]+$", 1) == images.rpartition("/")[2])
    frames = frames.withColumn("_folder", F.lit(images))
    return first_n(frames, ["_folder"], ["idx"], most).select("idx", "path").join(sequence_stamps(spark, folder, images), "idx", "left")


def decoded(spark: SparkSession, frames: DataFrame, read: Callable[[bytes], object], kind: str, attempts: int = 2) -> DataFrame:
    """frames(idx, path) with ``value``, what ``read`` makes of the file's bytes, retries and dropped.

    A frame that ``read`` answers with None on every attempt is kept as a drop marker, so that numbers stay dense.  Files
    are read by the tasks, as many at once as there are cores; a frame that lies nowhere is dropped as well."""
    names = [r[0] for r in frames.select(F.regexp_extract("path", "^(.*)/", 1)).distinct().collect()]  # folders, not frames
    rows = {f.name: f.dataType.simpleString() for f in frames.schema}
    if not names:
        return frames.withColumns({"value": F.lit(None).cast(kind), "retries": F.lit(0), "dropped": F.lit(True)})
    files = spark.read.format("binaryFile").load(names).select("path", "content")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values, retries = [], []
            for content in pdf["content"]:
                value, tries = None, 0
                while value is None and content is not None and tries < attempts:
                    value, tries = read(bytes(content)), tries + 1
                values.append(value)
                retries.append(max(tries - 1, 0))
            yield pdf.drop(columns="content").assign(value=values, retries=retries, dropped=[v is None for v in values])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.items())
    return frames.join(files, "path", "left").select(*rows, "content").mapInPandas(task, f"{schema}, value {kind}, retries int, dropped boolean")
