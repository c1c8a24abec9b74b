"""Registered queries, beside their SQL: arrays inside large documents, and folds called from SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.functions import tables
from strandline.lineage import shared_folder
from strandline.operators import trajectory
from strandline.plans import measured
from strandline.plans.catalogue import EV, SQL, _points, events, query, table
from strandline.sources import arrays, published

c = F.col


@query(f"select event_id, stage, user_id, round(duration_s, 6) as duration_s, round(memory_delta, 6) as memory_delta from {EV}")
def json_array_scan(spark, sf_dir):
    """All events, written as documents that hold up to 1,000 of them under a key, and read back in splits of files."""
    folder = f"{shared_folder(spark)}/arrays-{uuid.uuid4().hex}"
    fields = ["event_id", "stage", "user_id", "duration_s", "memory_delta"]
    e = events(spark, sf_dir).select(*fields)
    held = e.groupBy(F.floor(c("event_id") / 1_000).alias("part")).agg(F.collect_list(F.struct(*fields)).alias("events"))
    held.select(F.to_json(F.struct(c("part"), c("events"))).alias("value")).write.text(folder)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema)
    rows = arrays.array_items(spark, folder, "events", kinds)
    return rows.withColumns({n: F.round(n, 6) for n in ("duration_s", "memory_delta")})


@query(SQL["keyframe_select"])
def sql_keyframes(spark, sf_dir):
    """Lines of orders as trajectories, by a table function that takes them in batches."""
    p = _points(spark, sf_dir).select("seq", "idx", trajectory.planar_pose(c("x"), c("y"), c("y") / 50).alias("pose"), (c("x") / 50).alias("match_ratio"))
    p = tables.batched(p, "keyframes", "seq", "idx")
    return spark.sql("select * from keyframes_batches(table({p}) partition by share order by (seq, idx), far => 10)", p=p)


@query(f"""with recursive o as (select user_id, event_id, duration_s as x, row_number() over (partition by user_id order by event_id) as i from {EV}),
f(user_id, event_id, i, y) as (select user_id, event_id, i, x from o where i = 1 union all select f.user_id, o.event_id, o.i, 0.3 * o.x + 0.7 * f.y from f join o on o.user_id = f.user_id and o.i = f.i + 1)
select user_id, event_id, round(y, 6) as ema from f""")
def sql_moving_average(spark, sf_dir):
    tables.register(spark)
    e = events(spark, sf_dir).select("user_id", "event_id", c("duration_s").cast("double").alias("duration_s"))
    return spark.sql("select user_id, event_id, round(ema, 6) as ema from moving_average(table({e}), key => 'user_id', ordered => 'event_id', value => 'duration_s', alpha => 0.3)", e=e)


_COUNTED, _MOST = ("customer", "orders", "lineitem", "events"), 20_000


@query(" union all ".join(f"select '{t}' as name, count(*) as rows, case when count(*) > {_MOST} then 'budget_exceeded' else 'pass' end as status from {t}" for t in _COUNTED))
def measured_runs(spark, sf_dir):
    """Whole tables read at once, two at a time, each held to a budget of rows."""
    found = measured.run_measured(spark, {t: lambda s, t=t: table(s, sf_dir, t) for t in _COUNTED}, dict.fromkeys(_COUNTED, measured.Budget(rows=_MOST)), at_once=2, fail_fast=False)
    return spark.createDataFrame([(r["name"], r["rows"], r["status"]) for r in found], "name string, rows long, status string")


@query("select o_orderkey, o_custkey, round(o_totalprice, 2)::double as o_totalprice, o_orderstatus from orders")
def published_orders(spark, sf_dir):
    """All orders, published by status over an earlier version of their keys alone, and read from the version in use."""
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", c("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus")
    published.publish(orders.select("o_orderkey"), path)
    published.publish(orders, path, by=("o_orderstatus",), seed=7)
    return published.published(spark, path).withColumn("o_totalprice", F.round("o_totalprice", 2))
