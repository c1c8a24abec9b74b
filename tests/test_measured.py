"""Measured runs: budgets, several at once, cancelled through Spark."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from strandline.plans import measured
from strandline.plans.measured import Budget, run_measured


def slow(spark):
    """Tasks of twenty seconds."""

    def task(batches):
        for b in batches:
            time.sleep(20)
            yield b

    return spark.range(0, 4, 1, 2).mapInPandas(task, "id long")


def test_rows_are_counted_on_the_way(spark):
    got = run_measured(spark, {"a": lambda s: s.range(70), "b": lambda s: s.range(30).where("id > 3"), "c": lambda s: 5}, {"a": Budget(rows=60)}, at_once=3, fail_fast=False)
    assert [(r["name"], r["status"], r["rows"], r["value"]) for r in got] == [("a", "budget_exceeded", 70, None), ("b", "pass", 26, None), ("c", "pass", None, 5)]
    assert measured.overall(got) == "regressed" and measured.statistics(got)["run_count"] == 3


def test_a_run_over_its_time_cancels_the_rest(spark):
    began = time.monotonic()
    got = run_measured(spark, {"late": slow, "beside": slow, "never": lambda s: s.range(1)}, {"late": Budget(seconds=1.5)}, at_once=2)
    assert [r["status"] for r in got] == ["budget_exceeded", "cancelled", "cancelled"]
    assert got[2]["runtime_s"] == 0 and time.monotonic() - began < 9
    assert spark.range(5).count() == 5


def test_errors_are_results(spark):
    def fails(s):
        return s.range(3).select(F.raise_error(F.lit("no such thing")))

    got = run_measured(spark, {"bad": fails, "next": lambda s: s.range(1)}, at_once=1)
    assert [r["status"] for r in got] == ["error", "cancelled"] and "no such thing" in got[0]["error"]["message"]
    got = run_measured(spark, {"bad": fails, "next": lambda s: s.range(1)}, fail_fast=False)
    assert [r["status"] for r in got] == ["error", "pass"] and measured.overall(got) == "error"


def test_no_more_than_asked_at_once(spark):
    now, most, lock = [0], [0], threading.Lock()

    def run(s):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.1)
        with lock:
            now[0] -= 1
        return 1

    run_measured(spark, {str(i): run for i in range(6)}, at_once=2)
    assert most[0] == 2
    with pytest.raises(ValueError):
        run_measured(spark, {}, at_once=0)
    with pytest.raises(ValueError):
        Budget(seconds=-1)
