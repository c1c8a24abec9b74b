"""Versions are put in use whole or not at all."""

import pytest
from pyspark.sql import functions as F

from strandline.sources import published


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def versions(tmp_path):
    return sorted(p.name for p in (tmp_path / "table" / "versions").iterdir() if not p.name.startswith("."))


def test_versions_manifest_and_digest(spark, tmp_path, path):
    rows = spark.range(100).selectExpr("id", "id % 3 as part", "if(id % 5 = 0, null, string(id)) as text", "map('b', id, 'a', 2 * id) as m")
    one = published.publish(rows, path, by=("part",), seed=3, config_hash="h", extra={"note": "first"})
    assert one["rows"] == 100 and one["determinism"] == {"seed": 3, "config_hash": "h"} and one["note"] == "first" and one["recorded_at"]
    got = published.published(spark, path)
    assert got.columns == rows.columns and sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))
    assert published.verify(spark, path)
    same = published.publish(rows.repartition(7), path, recorded_at="then")
    assert same["digest"] == one["digest"] and same["recorded_at"] == "then" and same["previous"] == [one["version"]]
    assert published.published(spark, path, one["version"]).count() == 100
    three = published.publish(rows.where("id > 0"), path)
    assert three["digest"] != one["digest"] and versions(tmp_path) == sorted(f"{v}{e}" for v in (same["version"], three["version"]) for e in ("", ".json"))


def test_a_failed_task_leaves_the_old_version(spark, tmp_path, path):
    old = published.publish(spark.range(10), path)
    before = versions(tmp_path)
    broken = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 990, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    for df, error in ((broken, "lost"), (spark.range(0), "nothing to write")):
        with pytest.raises(Exception, match=error):
            published.publish(df, path)
        assert published.manifest(spark, path) == old and versions(tmp_path) == before
        assert published.published(spark, path).count() == 10


def test_two_writers(spark, tmp_path, path, monkeypatch):
    published.publish(spark.range(3), path)
    said, calls = published.manifest, []

    def meanwhile(*a):
        calls.append(a)
        if len(calls) == 2:
            monkeypatch.undo()
            published.publish(spark.range(4), path)
        return said(*a)

    monkeypatch.setattr(published, "manifest", meanwhile)
    with pytest.raises(published.Conflict):
        published.publish(spark.range(5), path)
    assert published.published(spark, path).count() == 4


def test_nothing_there(spark, path):
    assert published.manifest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        published.published(spark, path)
    with pytest.raises(ValueError):
        published.publish(spark.range(1), path, keep=0)
