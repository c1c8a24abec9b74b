"""Arrays of JSON documents that are read in splits, against ``json.loads``."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.sources import arrays

PIECES = ['"', "\\", ",", "[", "]", "{", "}", "é", "x", " ", "\n", ":", '"events": [1, 2']


@pytest.fixture
def split_size(spark):
    def put(size: str) -> None:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield put
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def documents(seed: int, n: int, items: int) -> list[dict]:
    rnd = random.Random(seed)

    def word() -> str:
        return "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(9)))

    def value(deep: int = 0):
        kind = rnd.randrange(7 if deep < 3 else 4)
        if kind < 4:
            return [rnd.random(), None, word(), rnd.randrange(9)][kind]
        return [value(deep + 1) for _ in range(rnd.randrange(4))] if kind < 6 else {word(): value(deep + 1) for _ in range(3)}

    return [{word(): value(), "a": {"events": [value()]}, "events": [{"i": i, "v": value(), "w": word()} for i in range(rnd.randrange(items))], f"{word()}z": value(), "other": [{"events": [1]}]} for _ in range(n)]


@pytest.mark.parametrize("size, docs, items", [("61b", 2, 12), ("700b", 5, 40), ("128m", 5, 40)])
def test_splits_anywhere(spark, tmp_path, split_size, size, docs, items):
    found = documents(len(size), docs, items)
    path = tmp_path / "a.json"
    path.write_text("\n".join(json.dumps(d, ensure_ascii=k % 2 == 0, indent=1 if k % 3 else None) for k, d in enumerate(found)), encoding="utf-8")
    split_size(size)
    for most in (1_000, 0):  # starts are broadcast, or shuffled
        rows = arrays.array_texts(spark, str(path), "events", most).orderBy("block", "n").collect()
        assert [json.loads(r["item"]) for r in rows] == [e for d in found for e in d["events"]]
        assert len({r["block"] for r in rows}) > 1 or size == "128m"


def test_top_arrays_typed_rows_and_edges(spark, tmp_path, split_size):
    split_size("50b")
    (tmp_path / "a.json").write_text(json.dumps([{"x": i, "s": f"a,{i}\\"} for i in range(40)]))
    (tmp_path / "b.json").write_text(" [ ] ")
    (tmp_path / "c.json").write_text('{"other": [1, 2]}')
    rows = arrays.array_items(spark, str(tmp_path), None, "x int, s string").orderBy("x").collect()
    assert [tuple(r) for r in rows] == [(i, f"a,{i}\\") for i in range(40)]
    assert arrays.array_texts(spark, str(tmp_path / "c.json"), "events").count() == 0
    with pytest.raises(ValueError):
        arrays.array_texts(spark, str(tmp_path), "a,b")


@pytest.mark.parametrize("text", ['{"events": [{"a": 1}', '{"events": [{"a": "1]}'])
def test_truncated_documents_fail(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="doesn't end"):
        arrays.array_texts(spark, str(tmp_path), "events").count()


def test_one_line_larger_than_its_splits(spark, tmp_path, split_size):
    """One document without a line break, in many partitions; no task sees more than its split."""
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"events": [{"i": i, "note": "n" * (i % 50)} for i in range(20_000)]}))
    split_size("128k")
    rows = arrays.array_texts(spark, str(path), "events")
    assert len(rows.groupBy(F.spark_partition_id()).count().collect()) > 5
    got = arrays.array_items(spark, str(path), "events", "i long, note string").agg(F.count("*"), F.sum("i"), F.sum(F.length("note"))).first()
    assert tuple(got) == (20_000, 19_999 * 10_000, sum(i % 50 for i in range(20_000)))
