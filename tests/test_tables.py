"""Table functions in SQL against the DataFrame forms."""

import pytest
from pyspark.sql.types import DoubleType

from strandline.functions import tables
from strandline.operators import trajectory


@pytest.fixture(scope="module")
def sql(spark):
    tables.register(spark)
    return spark.sql


def test_keyframes_from_sql_equal_the_operator(spark, sql):
    rows = spark.range(200).selectExpr("id % 7 as run", "id as step", "double(id * id % 23) / 40 as x", "double(id % 11) / 100 as yaw", "double(1 + id % 5) / 4 as match_ratio", "'unused' as other")
    rows = rows.select("*", trajectory.planar_pose(rows.x, rows.x, rows.yaw).alias("pose"))
    rows.createOrReplaceTempView("steps")
    got = sql("select * from keyframes(table(steps), key => 'run', ordered => 'step', far => 0.2) order by step").collect()
    want = trajectory.keyframes(rows, "run", "step", far=0.2).orderBy("step").collect()
    assert got == want and 7 < sum(r["keyframe"] for r in got) < 200


def test_null_and_skipped_values(spark, sql):
    spark.createDataFrame([("a", 1, 10.0), ("a", 2, None), ("a", 3, 30.0), (None, 1, 350.0), (None, 2, 5.0), ("b", 1, None), ("b", 2, float("nan"))], "k string, i int, v double").createOrReplaceTempView("readings")
    got = sql("select * from moving_average(table(readings), key => 'k', ordered => 'i', value => 'v', alpha => 0.5)").collect()
    assert {(r["k"], r["i"]): r["ema"] for r in got} == {("a", 1): 10.0, ("a", 2): 10.0, ("a", 3): 20.0, (None, 1): 350.0, (None, 2): 177.5}
    got = sql("select * from clamped_yaw(table(readings), key => 'k', ordered => 'i', yaw => 'v')").collect()
    assert {(r["k"], r["i"]): r["yaw_held"] for r in got} == {("a", 1): 10.0, ("a", 3): 15.0, (None, 1): 350.0, (None, 2): 355.0}


def test_a_callers_own_fold(spark):
    def counting(step: float = 1.0):
        def one(state: list, flag: bool | None) -> float:
            state[0] = state[0] + step if flag else 0.0
            return state[0]

        return lambda: [0.0], one

    tables.register(spark, "my_", {"streak": tables.fold_function(counting, ("flag",), "streak", DoubleType())})
    spark.createDataFrame([(1, i, f) for i, f in enumerate([True, True, False, None, True])], "k int, i int, good boolean").createOrReplaceTempView("flags")
    got = spark.sql("select streak from my_streak(table(flags), key => 'k', ordered => 'i', flag => 'good', step => 2) order by i").collect()
    assert [r["streak"] for r in got] == [2.0, 4.0, 0.0, 0.0, 2.0]


def test_absent_columns_are_named(spark, sql):
    with pytest.raises(Exception, match="no such columns: speed"):
        sql("select * from moving_average(table(select 1 as k, 2 as i), key => 'k', ordered => 'i', value => 'speed', alpha => 0.5)")


def test_folds_by_batches_equal_the_operator(spark, monkeypatch):
    """Keys that run over several batches, many keys in a share, a null key."""
    monkeypatch.setattr(tables, "SHARES", 3)
    rows = spark.range(900).selectExpr("nullif(id % 7, 3) as run", "id as step", "double(id * id % 23) / 40 as x", "double(id % 11) / 100 as yaw", "double(1 + id % 5) / 4 as ratio", "'unused' as other")
    rows = rows.select("*", trajectory.planar_pose(rows.x, rows.x, rows.yaw).alias("pose"))
    p = tables.batched(rows, "keyframes", "run", "step", match_ratio="ratio")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = spark.sql("select * from keyframes_batches(table({p}) partition by share order by (run, step), far => 0.2) order by step", p=p).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = trajectory.keyframes(rows.withColumnRenamed("ratio", "match_ratio"), "run", "step", far=0.2).orderBy("step").collect()
    assert got == want and len(got) == 900 and 7 < sum(r["keyframe"] for r in got) < 900


def test_batches_with_null_and_skipped_values(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, None), ("a", 3, 30.0), (None, 1, 350.0), (None, 2, 5.0), ("b", 1, None), ("b", 2, float("nan"))], "k string, i int, v double")
    for function, name, want in (("moving_average", "ema", {("a", 1): 10.0, ("a", 2): 10.0, ("a", 3): 20.0, (None, 1): 350.0, (None, 2): 177.5}), ("clamped_yaw", "yaw_held", {("a", 1): 10.0, ("a", 3): 15.0, (None, 1): 350.0, (None, 2): 355.0})):
        p = tables.batched(df, function, "k", "i", **{"value" if name == "ema" else "yaw": "v"})
        got = spark.sql(f"select * from {function}_batches(table({{p}}) partition by share order by (k, i){', alpha => 0.5' if name == 'ema' else ''})", p=p).collect()
        assert {(r["k"], r["i"]): r[name] for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError, match="no such columns: speed"):
        tables.batched(df, "moving_average", "k", "i", value="speed")


def test_keyframes_of_all_lines_go_by_batches(spark):
    """A Python call for each row and a new object for each order took 126 us a line."""
    from strandline.plans import surface

    plan = surface.sql_keyframes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ArrowEvalPythonUDTF" in plan and "BatchEvalPythonUDTF" not in plan
