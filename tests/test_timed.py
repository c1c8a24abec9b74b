"""Reordering with timers, against a replay of the same batches."""

import os
import random

import pandas as pd
import pytest

from strandline.streaming import ops, timed


@pytest.fixture
def store(spark):
    spark.conf.set(*timed.STATE_STORE)
    yield
    spark.conf.unset(timed.STATE_STORE[0])


def stream(spark, tmp_path, batches, **settings):
    """One file a batch, in order; times are seconds after an hour."""
    for i, rows in enumerate(batches):
        file = tmp_path / "in" / f"{i:03d}.parquet"
        file.parent.mkdir(exist_ok=True)
        frame = pd.DataFrame(rows, columns=["run", "n", "t"]).astype({"n": "Int64"})
        frame.assign(t=pd.to_datetime(frame["t"] + 3600, unit="s").astype("datetime64[us]")).to_parquet(file)
        os.utime(file, (1_000_000 + i, 1_000_000 + i))
    items = spark.readStream.schema("run string, n long, t timestamp").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    name = f"timed_{tmp_path.name.replace('-', '_')}"
    found = ops.run_available(timed.reorder_timed(items, "run", "n", "t", **settings), name, str(tmp_path / "state")).collect()
    out: dict = {}
    for r in sorted(found, key=lambda r: r["place"]):
        out.setdefault(r["run"], []).append((r["seq"], r["forced"]))
    return out


def test_gaps_filled_in_time_or_given_up(spark, tmp_path, store):
    batches = [
        [("a", 0, 0), ("a", 2, 1), ("a", 3, 2), (None, 0, 2), ("a", None, 2)],
        [("a", 1, 4), ("b", 5, 5), ("b", 7, 6), ("b", 8, 20)],
        [("c", 0, 30)],  # the watermark passes what b's 5 and 7 wait for; 8 is next then
        [("b", 6, 31), ("a", 2, 32), ("a", 4, 32)],  # given up; repeated; next
        [("c", 1, 33)],
    ]
    got = stream(spark, tmp_path, batches, wait_s=10, idle_s=1000)
    assert got == {"a": [(0, False), (1, False), (2, False), (3, False), (4, False)], "b": [(5, True), (7, True), (8, False)], "c": [(0, False), (1, False)]}


def test_forced_flush_and_idle_runs(spark, tmp_path, store):
    batches = [[("a", n, 1) for n in (0, 2, 3, 4, 5)], [("z", 0, 500)], [("z", 1, 501)], [("a", 0, 502), ("a", 1, 503)], [("z", 2, 504)]]
    got = stream(spark, tmp_path, batches, wait_s=10, idle_s=100, limit=4)
    # 2, 3 and 4 are the first three quarters of the four that wait; the state of a is gone when it comes back
    assert sorted(s for s, _ in got["a"]) == [0, 0, 1, 2, 3, 4, 5] and got["z"] == [(0, False), (1, False), (2, False)]


def test_as_a_replay(spark, tmp_path, store):
    rnd, wait = random.Random(11), 6
    numbers = [n for n in range(60) if n % 13]  # some never come
    rnd.shuffle(numbers)
    numbers = sorted(numbers, key=lambda n: n + rnd.randrange(8))
    rows = [("a", n, i) for i, n in enumerate(numbers)] + [("a", numbers[3], 20)]
    batches = [[r for r in rows if r[2] // 9 == k] for k in range(7)] + [[("end", 0, 1000)], [("end", 1, 1001)]]
    got = stream(spark, tmp_path, batches, wait_s=wait, idle_s=10_000)["a"]
    expected, waiting, out, mark = 0, {}, [], -1
    for batch in batches:
        for run, n, t in batch:
            if run == "a" and t > mark and n >= expected:
                waiting.setdefault(n, t + wait)
        while expected in waiting:
            waiting.pop(expected)
            out.append((expected, False))
            expected += 1
        for deadline in sorted(d for d in waiting.values() if d <= mark):
            due = [n for n, d in waiting.items() if d <= deadline]
            for n in sorted(n for n in waiting if due and n <= max(due)):
                waiting.pop(n)
                out.append((n, True))
                expected = n + 1
            while expected in waiting:
                waiting.pop(expected)
                out.append((expected, False))
                expected += 1
        mark = max([mark, *[t for _, _, t in batch]])
    assert [s for s, _ in got] == sorted({s for s, _ in got})
    assert got == out


def test_settings_that_cannot_be(spark):
    with pytest.raises(ValueError):
        timed.reorder_timed(spark.range(1), "id", "id", "id", wait_s=5, idle_s=1)
