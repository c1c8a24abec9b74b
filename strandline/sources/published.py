"""Tables that are replaced as a whole: a version is written beside the one in use, and one small manifest says which counts.

Spark's own commit protocol settles what a version's tasks leave behind; digest and number of rows are observed on the way.  Until
the manifest is renamed into its place, readers see the version before, so a failed task, driver or executor changes nothing."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandline.sources.sinks import write_text

MANIFEST = "manifest.json"


class Conflict(RuntimeError):
    """Another writer published between this one's start and end."""


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def row_digest(df: DataFrame) -> list[Column]:
    """Two sums of hashes of whole rows, columns by name: equal for equal rows in any order.  Maps are hashed as their sorted entries."""
    parts = [F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in sorted(df.schema.fields, key=lambda f: f.name)]
    nulls = F.concat(*[F.col(f"`{n}`").isNull().cast("int").cast("string") for n in sorted(df.columns)])
    return [F.coalesce(F.sum(F.xxhash64(F.lit(seed), nulls, *parts).cast("decimal(38,0)")).cast("string"), F.lit("0")) for seed in (1, 2)]


def manifest(spark: SparkSession, path: str, version: str | None = None) -> dict[str, Any] | None:
    """What is said of the version in use, or of an earlier one that is still kept; None where nothing has been published."""
    where, fs = _path(spark, f"{path}/{MANIFEST}" if version is None else f"{path}/versions/{version}.json")
    if not fs.exists(where):
        return None
    return json.loads(spark.read.text(where.toString(), wholetext=True).first()["value"])


def publish(df: DataFrame, path: str, by: tuple[str, ...] = (), seed: int | None = None, config_hash: str = "", recorded_at: str | None = None, extra: dict[str, Any] | None = None, keep: int = 2) -> dict[str, Any]:
    """Writes the rows as the next version and puts it in use; returns its manifest.

    A manifest holds version, previous, recorded_at (now, unless given), determinism (seed, config_hash), rows, digest and schema.  The
    newest ``keep`` versions stay, so readers that have begun can end.  Empty tables are an error, and so is another
    writer's version in between (``Conflict``); what was written is removed then.  Two writers that look in the same moment, just
    before their renames, both succeed: the later one is in use."""
    if keep < 1:
        raise ValueError("the version in use has to be kept")
    spark, version = df.sparkSession, uuid.uuid4().hex
    before, seen = manifest(spark, path), Observation()
    folder, fs = _path(spark, f"{path}/versions/{version}")
    a, b = row_digest(df)
    try:
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), a.alias("a"), b.alias("b")).write
        (writer.partitionBy(*by) if by else writer).parquet(folder.toString())
        found = seen.get
        if not found["rows"]:
            raise ValueError("nothing to write")
        now = manifest(spark, path)
        if (now or {}).get("version") != (before or {}).get("version"):
            raise Conflict(f"published meanwhile: {now and now['version']}")
    except BaseException:
        fs.delete(folder, True)
        raise
    said = {"version": version, "previous": [before["version"], *before["previous"]][: keep - 1] if before and keep > 1 else [], "recorded_at": recorded_at or datetime.now(timezone.utc).isoformat(), "determinism": {"seed": seed, "config_hash": config_hash}, "rows": found["rows"], "digest": f"{found['a']}:{found['b']}", "schema": df.schema.jsonValue(), "partitions": list(by)} | (extra or {})
    text = json.dumps(said, indent=2, sort_keys=True)
    write_text(spark, f"{path}/versions/{version}.json", text)
    write_text(spark, f"{path}/{MANIFEST}.{version}", text)
    context, rename = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    source, target = _path(spark, f"{path}/{MANIFEST}.{version}")[0], _path(spark, f"{path}/{MANIFEST}")[0]
    context.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(source), fs.makeQualified(target), rename)
    gone = {before["version"], *before["previous"]} - {version, *said["previous"]} if before else set()
    for old in gone:
        for name in (old, f"{old}.json"):
            fs.delete(_path(spark, f"{path}/versions/{name}")[0], True)
    return said


def published(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The rows of the version in use, or of an earlier one that is still kept; nothing published is an error."""
    said = manifest(spark, path, version)
    if said is None:
        raise FileNotFoundError(f"nothing published in {path}")
    schema = spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromJson(json.dumps(said["schema"])).toDDL()
    return spark.read.schema(schema).parquet(f"{path}/versions/{said['version']}").select(*[f"`{f['name']}`" for f in said["schema"]["fields"]])


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the rows in use are those that were written."""
    rows, said = published(spark, path), manifest(spark, path)
    n, a, b = rows.agg(F.count(F.lit(1)), *row_digest(rows)).first()
    return (n, f"{a}:{b}") == (said["rows"], said["digest"])
