"""Runs that are measured and held to budgets, several at once.

Each run is a function of the session; a DataFrame that it returns is written (to nowhere by default) while Spark counts its rows on
the way (``observe``), so measuring costs no second pass.  A run past its time has its Spark jobs cancelled by tag, on
all executors; so have the others where one fails and ``fail_fast`` is set."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from time import monotonic
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Seconds between two looks at runs that have a time budget or are being cancelled.
LOOK_S = 0.2


@dataclass(frozen=True)
class Budget:
    """Most seconds and rows of a run; None for any number."""

    seconds: float | None = None
    rows: int | None = None

    def __post_init__(self):
        if min(self.seconds or 0, self.rows or 0) < 0:
            raise ValueError("budgets must not be negative")


def _nowhere(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def run_measured(spark: SparkSession, runs: Mapping[str, Callable[[SparkSession], Any]], budgets: Mapping[str, Budget] | None = None, at_once: int = 1, fail_fast: bool = True, sink: Callable[[DataFrame], Any] = _nowhere, judge: Callable[[Any], str] = lambda value: "pass") -> list[dict[str, Any]]:
    """name, status, runtime_s, rows (of a DataFrame), value (of anything else) and error of each run, in the order of ``runs``.

    Status: ``error``, ``budget_exceeded``, ``cancelled`` (stopped or never started, because another run did not pass), or what
    ``judge`` says of the value.  Runs that are not DataFrames should do their work in Spark jobs: plain Python is
    not interrupted, only what it asks of Spark next."""
    if at_once < 1:
        raise ValueError("at least one run at a time")
    budgets, context, session = budgets or {}, spark.sparkContext, uuid.uuid4().hex
    began: dict[str, float] = {}
    stopped: dict[str, str] = {}

    def one(name: str) -> dict[str, Any]:
        tag, result = f"run-{session}-{list(runs).index(name)}", {"name": name, "status": "cancelled", "runtime_s": 0.0, "rows": None, "value": None, "error": None}
        if name in stopped:
            return result
        began[name] = monotonic()
        context.addJobTag(tag)
        try:
            value = runs[name](spark)
            if isinstance(value, DataFrame):
                seen = Observation()
                sink(value.observe(seen, F.count(F.lit(1)).alias("rows")))
                result |= {"rows": seen.get["rows"], "status": judge(None)}
            else:
                result |= {"value": value, "status": judge(value)}
        except Exception as error:  # noqa: BLE001 - a run's failure is a result here
            result |= {"status": "error", "error": {"type": type(error).__name__, "message": str(error)}}
        finally:
            context.removeJobTag(tag)
        result["runtime_s"] = monotonic() - began[name]
        budget = budgets.get(name, Budget())
        over = budget.seconds is not None and result["runtime_s"] > budget.seconds or budget.rows is not None and (result["rows"] or 0) > budget.rows
        if name in stopped and result["status"] == "error":
            result |= {"status": stopped[name]}
        elif over and result["status"] != "error":
            result["status"] = "budget_exceeded"
        return result

    def stop(names: list[str], status: str) -> None:
        for name in names:
            stopped.setdefault(name, status)
            if name in began:  # asked again at each look, for jobs that start in between
                context.cancelJobsWithTag(f"run-{session}-{list(runs).index(name)}")

    out: dict[str, dict[str, Any]] = {}
    with ThreadPoolExecutor(at_once) as pool:
        waiting: dict[Future, str] = {pool.submit(inheritable_thread_target(spark)(one), name): name for name in runs}
        failed = False
        while waiting:
            timed = failed or any(b.seconds is not None for b in budgets.values())
            done, _ = wait(waiting, timeout=LOOK_S if timed else None, return_when=FIRST_COMPLETED)
            for future in done:
                out[waiting.pop(future)] = result = future.result()
                failed |= fail_fast and result["status"] != "pass"
            now, left = monotonic(), list(waiting.values())
            late = [n for n in left if n in began and (b := budgets.get(n)) and b.seconds is not None and now - began[n] > b.seconds]
            stop(late, "budget_exceeded")
            if failed:
                stop(left, "cancelled")
    return [out[name] for name in runs]


def statistics(results: list[dict[str, Any]]) -> dict[str, float]:
    """Number of runs that ran, and total, mean, most and least of their seconds."""
    times = [float(r["runtime_s"]) for r in results if r["status"] != "cancelled"]
    found = {"run_count": float(len(times)), "total_runtime_s": sum(times)}
    return found | ({"mean_runtime_s": sum(times) / len(times), "max_runtime_s": max(times), "min_runtime_s": min(times)} if times else {})


def overall(results: list[dict[str, Any]]) -> str:
    """error over regressed over pass."""
    kinds = {r["status"] for r in results}
    return "error" if "error" in kinds else "pass" if kinds <= {"pass"} else "regressed"
