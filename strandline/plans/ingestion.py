"""Registered queries, beside their SQL: ingestion, solver gates, lookups, losses and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import ingestion, joins, ordered, similarity, telemetry
from strandline.plans.catalogue import EV, events, query, r6, stats_sql, table

c = F.col

#: Every third event takes from the queue, the others put.
_PUT = "event_id % 3 <> 0"


@query(f"""with recursive e as (select user_id, event_id, {_PUT} as put, row_number() over (partition by user_id order by event_id) as n from {EV}),
f(user_id, event_id, n, done, depth, puts, gets) as (select distinct user_id, null::bigint, 0::bigint, true, 0, 0, 0 from e
 union all select user_id, event_id, n, went, depth + case when went then case when put then 1 else -1 end else 0 end, puts + (put and not went)::int, gets + (not put and not went)::int
 from (select e.user_id, e.event_id, e.n, e.put, f.depth, f.puts, f.gets, case when e.put then f.depth < 6 else f.depth > 0 end as went from f join e on e.user_id = f.user_id and e.n = f.n + 1))
select user_id, event_id, done, depth, depth / 6 as depth_ratio, puts as blocked_puts, gets as blocked_gets from f where n > 0""")
def queue_replay(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("put", F.expr(_PUT))
    return ingestion.replay_queue(rows, "user_id", "event_id", "put", capacity=6)


@query(f"""with recursive e as (select user_id, event_id, event_id % 2 = 0 as spawned, row_number() over (partition by user_id order by event_id) as n from {EV}),
f(user_id, event_id, n, active, total) as (select distinct user_id, null::bigint, 0::bigint, 0::bigint, 0::bigint from e
 union all select e.user_id, e.event_id, e.n, case when e.spawned then f.active + 1 else greatest(f.active - 1, 0) end, f.total + e.spawned::int from f join e on e.user_id = f.user_id and e.n = f.n + 1)
select event_id, active as active_workers, total as total_spawned from f where n > 0""")
def worker_accounting(spark, sf_dir):
    return ingestion.worker_counts(events(spark, sf_dir), ["user_id"], "event_id", c("event_id") % 2 == 0).select("event_id", "active_workers", "total_spawned")


@query("""with k as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 4 <> 0 as a, l_suppkey % 3 <> 0 as b, l_linenumber % 2 = 0 as d, l_discount as u, l_tax as v from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, a or b or d as decoded, case when a then 1 when b then 2 else 3 end as attempts, case when a then 0 when b then 1 else 2 end as retries,
 round(case when a then 0 when b then 0.02 + 0.01 * u else 0.04 + 0.01 * (u + v) end, 6) as waited_s from k""")
def retry_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    outcomes, draws = F.array(c("l_partkey") % 4 != 0, c("l_suppkey") % 3 != 0, c("l_linenumber") % 2 == 0), F.array(c("l_discount").cast("double"), c("l_tax").cast("double"))
    got = ingestion.retried(rows, outcomes, draws, most=3)
    return r6(got.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "decoded", "attempts", "retries", "waited_s"), "waited_s")


@query(f"""with k as (select user_id, stage, row_number() over (partition by user_id order by event_id desc) as r from {EV} where memory_delta >= 20)
select user_id, stage, count(*) as failures, count(*) filter (r <= 16) as kept from k group by 1, 2""")
def failure_report(spark, sf_dir):
    return ingestion.failure_report(events(spark, sf_dir).where("memory_delta >= 20"), ["user_id"], "stage", ["event_id"], 16)


@query("""with l as (select l_orderkey, count(*) as iterations from lineitem group by 1),
w as (select o_orderkey, o_totalprice as cost, iterations, lag(o_totalprice) over k as last_cost, lag(iterations) over k as last_iterations from orders join l on l_orderkey = o_orderkey window k as (partition by o_custkey order by o_orderkey)),
r as (select *, (cost - last_cost) / nullif(abs(last_cost), 0) as cost_ratio, (iterations - last_iterations) / nullif(abs(last_iterations), 0) as iteration_ratio from w),
t as (select *, array_to_string([x for x in [case when cost > 400000 then 'max_cost' end, case when cost_ratio > 0.25 then 'max_cost_ratio' end, case when iteration_ratio > 0.5 then 'max_iteration_ratio' end] if x is not null], ',') as triggered from r)
select o_orderkey, round(cost - last_cost, 4) as cost_delta, iterations - last_iterations as iteration_delta, round(cost_ratio, 6) as cost_ratio, round(iteration_ratio, 6) as iteration_ratio, triggered,
 case when triggered <> '' then 'regressed' when last_cost is null then 'baseline' else 'pass' end as status from t""")
def solver_gate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("iterations"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", c("o_totalprice").alias("cost")).join(lines, "o_orderkey")
    got = ordered.solver_gate(rows, ["o_custkey"], "o_orderkey", limits={"max_cost": 400_000, "max_cost_ratio": 0.25, "max_iteration_ratio": 0.5})
    got = got.select("o_orderkey", F.round("cost_delta", 4).alias("cost_delta"), "iteration_delta", "cost_ratio", "iteration_ratio", F.array_join("triggered", ",").alias("triggered"), "status")
    return r6(got, "cost_ratio", "iteration_ratio")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem qualify row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) <= 25")
def frame_limit(spark, sf_dir):
    return ordered.first_n(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 25).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("""with t as (select o_custkey, o_totalprice as x, row_number() over (partition by o_custkey order by o_orderkey) as i from orders where o_orderkey % 2 = 0),
e as (select o_custkey, o_totalprice as x, row_number() over (partition by o_custkey order by o_orderkey) as i from orders where o_orderkey % 2 = 1)
select o_custkey, count(*) as pairs, round(sqrt(avg(pow(t.x - e.x, 2))), 4) as rmse from t join e using (o_custkey, i) group by 1""")
def positional_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    got = joins.positional_pairs(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], ["o_orderkey"])
    return got.groupBy("o_custkey").agg(F.count("*").alias("pairs"), F.round(F.sqrt(F.avg(F.pow(c("o_totalprice") - c("o_totalprice_est"), F.lit(2.0)))), 4).alias("rmse"))


@query("select l_orderkey, count(p_partkey) as found, count(*) - count(p_partkey) as missing, coalesce(sum(p_size), 0)::bigint as total_size from lineitem left join (select * from part where p_partkey % 5 <> 0) on p_partkey = l_partkey group by 1")
def keyed_lookup(spark, sf_dir):
    store = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(c("p_partkey").alias("l_partkey"), "p_size")
    got = joins.keyed_lookup(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), store, "l_partkey")
    return got.groupBy("l_orderkey").agg(F.count_if("found").alias("found"), F.count_if(~c("found")).alias("missing"), F.coalesce(F.sum("p_size"), F.lit(0)).cast("long").alias("total_size"))


_TRACKED = " union all ".join(f"select l_suppkey, 'l_{m}' as measure, l_{m}::double as value from lineitem" for m in ("quantity", "discount", "tax"))


@query(f"select l_suppkey, measure, {stats_sql('value', sample=False)} from ({_TRACKED}) group by 1, 2")
def measure_trackers(spark, sf_dir):
    got = telemetry.trackers(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_quantity", "l_discount", "l_tax"])
    return r6(got, "total", "mean", "min", "max", "variance", "stdev", "p50", "p90", "p95", "p99")


@query(f"""with z as (select event_id, pow(duration_s / 10, 2) as z, 1.5 as s from {EV})
select event_id, round(case when sqrt(z) <= s then z else 2 * s * sqrt(z) - s * s end, 6) as huber_0, round(case when sqrt(z) <= s then 1 else s / sqrt(z) end, 6) as huber_1, round(case when sqrt(z) <= s then 0 else -0.5 * s / z end, 6) + 0.0 as huber_2,
 round(s * s * ln(1 + z / (s * s)), 6) as cauchy_0, round(1 / (1 + z / (s * s)), 6) as cauchy_1, round(-1 / (s * s * pow(1 + z / (s * s), 2)), 6) + 0.0 as cauchy_2,
 round(s * s / 6 * (1 - case when sqrt(z) <= s then pow(1 - z / (s * s), 3) else 0 end), 6) as tukey_0, round(case when sqrt(z) <= s then pow(1 - z / (s * s), 2) else 0 end, 6) as tukey_1, round(case when sqrt(z) <= s then -2 * (1 - z / (s * s)) / (s * s) else 0 end, 6) + 0.0 as tukey_2 from z""")
def robust_losses(spark, sf_dir):
    z = F.pow(c("duration_s") / 10, F.lit(2.0))
    names = {f"{k}_{i}": v for k in ("huber", "cauchy", "tukey") for i, v in enumerate(scalars.robust_loss(k, z, 1.5))}
    return r6(events(spark, sf_dir).select("event_id", *[v.cast("double").alias(n) for n, v in names.items()]), *names)


@query("""with k as (select c_custkey, sha256(c_custkey::varchar) as a, sha256(c_nationkey::varchar) as b from customer)
select c_custkey, list_sum([(substr(a, 2 * i + 1, 2) <> substr(b, 2 * i + 1, 2))::int for i in range(32)])::int as bytes from k""")
def differing_bytes(spark, sf_dir):
    digest = lambda n: F.unhex(F.sha2(c(n).cast("string"), 256))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.differing_bytes(digest("c_custkey"), digest("c_nationkey")).alias("bytes"))


@query("select c_custkey, c_acctbal::double as balance, trunc(c_acctbal)::bigint as whole from customer")
def number_maps(spark, sf_dir):
    texts = F.create_map(F.lit("balance"), c("c_acctbal").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.number_map(texts)["balance"].alias("balance"), scalars.number_map(texts, "long")["balance"].alias("whole"))


@query("select vec_id, label from embeddings order by sha256('7:' || vec_id), vec_id limit 300")
def sampled_vectors(spark, sf_dir):
    return similarity.sampled(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 300, 7)
