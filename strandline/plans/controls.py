"""More registered queries, beside their SQL: calibration, maps, control plane and reports of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import calibration, control, maps
from strandline.plans.catalogue import _CENTRES, _ASSIGN, _HEALTH_STATE, EV, _health, events, query, r6, table

c = F.col

_CAMERAS = """(select s_nationkey as rig, 'image_' || s_suppkey as camera, s_acctbal as fx, (s_suppkey % 4) * 0.0005 as skew, s_nationkey - 2.0 as cx, (s_suppkey % 3) * 0.4 + 0.8 as last, s_acctbal / 500 as tx, s_suppkey % 5 as ty from supplier)"""


@query(f"""with c as (select *, arg_min(tx, camera) over w as rx, arg_min(ty, camera) over w as ry, min(camera) over w as ref from {_CAMERAS} window w as (partition by rig)),
d as (select *, sqrt(pow(tx - rx, 2) + pow(ty - ry, 2)) as baseline from c)
select rig, camera, 'error' as level, 'focal_length' as rule from d where fx <= 0 union all select rig, camera, 'warning', 'skew' from d where skew > 0.001 union all select rig, camera, 'warning', 'last_element' from d where abs(last - 1) > 0.00101
union all select rig, camera, 'warning', 'principal_point' from d where cx < 0 union all select rig, camera, 'warning', 'translation' from d where sqrt(tx * tx + ty * ty) > 10
union all select rig, camera, 'error', 'baseline_zero' from d where camera <> ref and baseline <= 0 union all select rig, camera, 'warning', 'baseline_small' from d where camera <> ref and baseline > 0 and baseline < 0.001""")
def calibration_checks(spark, sf_dir):
    s, key, zero = table(spark, sf_dir, "supplier"), c("s_suppkey"), F.lit(0.0)
    k = F.array(c("s_acctbal"), (key % 4) * 0.0005, c("s_nationkey") - 2.0, zero, F.lit(700.0), F.lit(200.0), zero, zero, (key % 3) * 0.4 + 0.8)
    t = F.array(c("s_acctbal") / 500, (key % 5).cast("double"), zero)
    return calibration.check_cameras(s.select(c("s_nationkey").alias("rig"), F.concat(F.lit("image_"), key).alias("camera"), k.alias("k"), t.alias("t")), ["rig"])


_FACTS = "(select c_custkey, c_nationkey % 7 <> 0 as present, count(o_orderkey) as n_images, count(*) filter (o_orderstatus <> 'P') as n_stamps, count(*) filter (o_orderpriority = '1-URGENT') as n_calibrations, case when c_nationkey % 2 = 0 then count(*) filter (o_orderstatus = 'F') end as n_truth from customer left join orders on o_custkey = c_custkey group by c_custkey, c_nationkey)"


def _facts(spark, sf_dir) -> DataFrame:
    o, n = table(spark, sf_dir, "orders"), c("c_nationkey")
    counts = o.groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_images"), F.count_if(c("o_orderstatus") != "P").alias("n_stamps"), F.count_if(c("o_orderpriority") == "1-URGENT").alias("n_calibrations"), F.count_if(c("o_orderstatus") == "F").alias("n_f"))
    joined = table(spark, sf_dir, "customer").join(counts, "c_custkey", "left").fillna(0, ["n_images", "n_stamps", "n_calibrations", "n_f"])
    return joined.select("c_custkey", (n % 7 != 0).alias("present"), "n_images", "n_stamps", "n_calibrations", F.when(n % 2 == 0, c("n_f")).alias("n_truth"))


_ISSUES = f"""(with f as {_FACTS} select c_custkey, 'error' as level, 'absent' as rule from f where not present union all select c_custkey, 'error', 'no_images' from f where present and n_images = 0 union all select c_custkey, 'error', 'no_ground_truth' from f where present and n_truth = 0
union all select c_custkey, 'warning', 'no_stamps' from f where present and n_stamps = 0 union all select c_custkey, 'warning', 'stamp_count' from f where present and n_images > 0 and n_stamps > 0 and n_images <> n_stamps union all select c_custkey, 'warning', 'no_calibration' from f where present and n_calibrations = 0)"""


@query(f"select * from {_ISSUES}")
def dataset_checks(spark, sf_dir):
    return calibration.check_datasets(_facts(spark, sf_dir), ["c_custkey"])


@query(f"select k.c_custkey, count(*) filter (level = 'error') as errors, count(*) filter (level = 'warning') as warnings, count(*) filter (level = 'error') = 0 as ok from customer k left join {_ISSUES} i on i.c_custkey = k.c_custkey group by 1")
def dataset_verdict(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return calibration.dataset_verdict(f, calibration.check_datasets(f, ["c_custkey"]), ["c_custkey"])


@query("""with k as (select s_suppkey, case s_suppkey % 4 when 0 then 'P_rect_0' when 1 then 'P' when 2 then 'P_' else 'R_' end || (s_suppkey % 13) as key from supplier)
select s_suppkey, case when key like 'R%' then null else 'image_' || cast(regexp_extract(key, '(\\d+)$', 1) as int) end as camera, case when s_suppkey % 6 < 4 then (s_suppkey % 6)::int else -1 end as camera_id, case when length(s_suppkey::varchar) < 4 then lpad(s_suppkey::varchar, 4, '0') else s_suppkey::varchar end as drive from k""")
def camera_keys(spark, sf_dir):
    n = c("s_suppkey")
    prefix = F.when(n % 4 == 0, "P_rect_0").when(n % 4 == 1, "P").when(n % 4 == 2, "P_").otherwise("R_")
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.camera_name(F.concat(prefix, n % 13)).alias("camera"), F.coalesce(scalars.camera_id(F.concat(F.lit("image_0"), n % 6)), F.lit(-1)).alias("camera_id"), scalars.drive_id(n.cast("string")).alias("drive"))


@query("""select s_suppkey, round(s_acctbal / (2 * tan(radians(60 + s_nationkey) / 2)), 6) as focal, round(-(a - 300.0 * d) / 700, 6) as tx, round(-(b - 200.0 * d) / 710, 6) as ty, round(-d, 6) as tz from (select *, s_acctbal as a, s_nationkey * 2.0 as b, s_suppkey * 0.001 as d from supplier)""")
def camera_matrices(spark, sf_dir):
    one, zero = F.lit(1.0), F.lit(0.0)
    p = F.array(F.lit(700.0), zero, F.lit(300.0), c("s_acctbal"), zero, F.lit(710.0), F.lit(200.0), c("s_nationkey") * 2.0, zero, zero, one, c("s_suppkey") * 0.001)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", scalars.fov_intrinsics(c("s_acctbal"), F.lit(480.0), c("s_nationkey") + 60.0)[0].alias("focal"), scalars.projection_offset(scalars.projection_intrinsics(p), p).alias("t"))
    return r6(rows.select("s_suppkey", "focal", *[c("t")[i].alias(n) for i, n in enumerate(("tx", "ty", "tz"))]), "focal", "tx", "ty", "tz")


@query(f"{_ASSIGN}, f as (select distinct label as frame_id from embeddings union all select -1), g as (select label, word, count(*) / sum(count(*)) over (partition by label) as share from d where r = 1 group by label, word) select f.frame_id, w.word, round(coalesce(share, 0), 6) as share from f cross join w left join g on g.label = f.frame_id and g.word = w.word")
def map_histograms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    frames = e.select(c("label").alias("frame_id")).distinct().union(spark.sql("select -1"))
    d = e.select(c("label").alias("frame_id"), c("embedding").cast("array<double>").alias("v"))
    return r6(maps.build_map(frames, d, _CENTRES).select("frame_id", F.posexplode("hist").alias("word", "share")), "share")


@query("""with k as (select l_orderkey, l_linenumber::bigint * 1000000000 + l_partkey * 100 + l_suppkey % 100 as frame_id, l_discount * 10 as score, 2 * l_quantity as match_count, l_quantity as inliers from lineitem),
n as (select *, row_number() over (partition by l_orderkey order by score desc, frame_id) as r from k), b as (select *, row_number() over (partition by l_orderkey order by inliers desc, score desc, frame_id) as p from n where r <= 3 and score >= 0.35 and match_count >= 20 and inliers >= 12)
select l_orderkey, frame_id, score, inliers from b where p = 1""")
def relocalize_best(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem").select("l_orderkey", (c("l_linenumber") * F.lit(1000000000).cast("long") + c("l_partkey") * 100 + c("l_suppkey") % 100).alias("frame_id"), (c("l_discount") * 10).alias("score"), (2 * c("l_quantity")).alias("match_count"), c("l_quantity").alias("inliers"))
    return maps.relocalize(k, "l_orderkey", most=3, least_score=0.35, least_matches=20, least_inliers=12).select("l_orderkey", "frame_id", "score", "inliers")


@query(f"select event_id, array_to_string(list(event_id) over (partition by user_id order by event_id rows between 4 preceding and current row), ',') as frames from {EV}")
def recent_keyframes(spark, sf_dir):
    return maps.recent_keyframes(events(spark, sf_dir), ["user_id"], "event_id", c("event_id")).select("event_id", F.array_join("window", ",").alias("frames"))


@query("select l_suppkey, l_orderkey, l_linenumber, l_extendedprice from lineitem qualify row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) <= 20")
def strongest_features(spark, sf_dir):
    rows = maps.strongest(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"], 20)
    return rows.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("select l_partkey, l_orderkey, l_linenumber, l_extendedprice from lineitem qualify row_number() over (partition by l_partkey order by l_extendedprice, l_orderkey, l_linenumber, l_suppkey) <= 5")
def closest_matches(spark, sf_dir):
    rows = maps.closest(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice", ["l_orderkey", "l_linenumber", "l_suppkey"], 5)
    return rows.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""select l_partkey, count(l_quantity) as match_count, round(avg(l_quantity), 6) as mean_distance, round(median(l_quantity), 6) as median_distance, round(least(greatest(1.5 * least(greatest(median(l_quantity) / 25, 0.5), 2), 1), 2), 6) as threshold from lineitem group by 1""")
def match_statistics(spark, sf_dir):
    m = maps.match_statistics(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity")
    return r6(m.withColumn("threshold", scalars.adaptive_threshold(c("median_distance"), 1.5, 1.0, 2.0)), "mean_distance", "median_distance", "threshold")


_EDGE = "l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey"


@query(f"select l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey order by l_partkey % 50, l_linenumber, l_discount, l_tax, sha256({_EDGE})) - 1 as place from lineitem")
def edge_order(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").withColumns({"i": c("l_partkey") % 50, "j": c("l_linenumber"), "s": c("l_discount"), "weight": c("l_tax")})
    return maps.ordered_edges(e, ["l_suppkey"], F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", c("place").cast("long").alias("place"))


@query("""with k as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::bigint as px, l_linenumber::bigint as py, (l_partkey * 7 + l_suppkey) % 28 as diff from lineitem)
select l_orderkey, l_linenumber, l_partkey from k a where not exists (select 1 from k b where b.l_orderkey = a.l_orderkey and b.diff >= 25 and abs(a.px - b.px) <= 2 and abs(a.py - b.py) <= 2)""")
def masked_points(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    points = rows.select("l_orderkey", "l_linenumber", "l_partkey", (c("l_quantity") + 0.5).alias("x"), (c("l_linenumber") + 0.25).alias("y"))
    changes = rows.select("l_orderkey", c("l_quantity").cast("long").alias("px"), c("l_linenumber").cast("long").alias("py"), ((c("l_partkey") * 7 + c("l_suppkey")) % 28).alias("diff"))
    return maps.unmasked(points, changes, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""with m as (select l_orderkey, sum(l_extendedprice) as mass, sum(l_linenumber * l_extendedprice) as a, sum(l_quantity * l_extendedprice) as b from lineitem group by 1)
select l_orderkey, round(mass, 3) as mass, round(a / mass, 6) as cx, round(b / mass, 6) as cy, round(degrees(atan2(b / mass - 3, a / mass - 3)), 6) as angle_deg from m""")
def patch_orientation(spark, sf_dir):
    pixels = table(spark, sf_dir, "lineitem").select("l_orderkey", c("l_linenumber").alias("px"), c("l_quantity").alias("py"), c("l_extendedprice").alias("value"))
    return r6(maps.patch_moments(pixels, ["l_orderkey"], 7), "cx", "cy", "angle_deg").withColumn("mass", F.round("mass", 3))


@query(f"""with k as (select *, row_number() over (partition by user_id order by event_id desc) as r from {EV})
select user_id, event_id, row_number() over (partition by user_id order by case when memory_delta > 90 then 0 else 1 end, ts, stage, event_id) - 1 as place from k where r <= 32""")
def recovery_order(spark, sf_dir):
    a = events(spark, sf_dir).withColumns({"severity": F.when(c("memory_delta") > 90, "tripped").otherwise("degraded"), "queued_at_s": c("ts"), "seq_id": c("event_id")})
    return control.recovery_order(a, ["user_id"], "event_id", 32).select("user_id", "event_id", c("place").cast("long").alias("place"))


@query(f"with o as (select distinct user_id, memory_delta::bigint as seq from {EV} where memory_delta is not null) select user_id, seq, row_number() over (partition by user_id order by seq) = seq + 1 as ready from o")
def strict_reorder(spark, sf_dir):
    o = events(spark, sf_dir).select("user_id", c("memory_delta").cast("long").alias("seq"))
    return control.contiguous(o, ["user_id"], "seq")


_LOST = "(stage = 'error' and memory_delta < 60)"


@query(f"""with w as (select *, row_number() over o = 1 as is_first, coalesce(lag({_LOST}) over o, false) or memory_delta < 20 as few, stage = 'view' and memory_delta > 80 as broken, duration_s > 15 as moved from {EV} window o as (partition by user_id order by event_id)),
s as (select event_id, stage, memory_delta, few, broken, case when {_LOST} and memory_delta < 30 then 'dropped' when {_LOST} then 'skipped' when is_first then 'bootstrap' when (few or broken) and moved then 'relocalized' when few then 'skipped' when broken then 'failure' else 'ok' end as status from w)
select event_id, status, case when status = 'dropped' then 'late' when status = 'skipped' and {_LOST} then 'decode' when status = 'skipped' then 'min_matches' when status = 'failure' then 'parallax' end as failure_reason from s""")
def frame_status(spark, sf_dir):
    bad, m = c("stage") == "error", c("memory_delta")
    f = events(spark, sf_dir).withColumns({"match_count": m, "drop_reason": F.when(bad & (m < 30), "late"), "feature_error": F.when(bad & (m >= 30) & (m < 60), "decode"), "pose_error": F.when((c("stage") == "view") & (m > 80), "parallax"), "relocalized": c("duration_s") > 15})
    return control.frame_status(f, ["user_id"], "event_id", 20).select("event_id", "status", "failure_reason")


@query(f"""select event_id, round(case when duration_s < 1 or memory_delta < 1 then 1 else duration_s / memory_delta end, 6) as scale, round(greatest(duration_s, case when memory_delta > 50 then memory_delta end), 6) as largest, round(duration_s + coalesce(case when memory_delta > 50 then memory_delta end, 0), 6) as total from {EV}""")
def map_metrics(spark, sf_dir):
    held = F.map_filter(F.create_map(F.lit("depth"), c("duration_s"), F.lit("drops"), c("memory_delta")), lambda k, v: (k == "depth") | (v > 50))
    e = events(spark, sf_dir).withColumn("m", held)
    return r6(e.select("event_id", scalars.loop_scale(c("duration_s"), c("memory_delta"), 1.0).alias("scale"), scalars.largest_of(c("m"), ("depth", "drops", "gone")).alias("largest"), scalars.total_of(c("m"), ("depth", "drops", "gone")).alias("total")), "scale", "largest", "total")


@query("""select c_custkey, sha256('{"config_hash":"abc","run_id":"' || c_name || '","salt":null,"seed":' || c_nationkey || ',"stage":"' || c_mktsegment || '"}') as correlation_id from customer""")
def correlation_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.correlation_id(c("c_mktsegment"), c("c_nationkey"), F.lit("abc"), c("c_name"), F.lit(None).cast("string")).alias("correlation_id"))


@query("select c_custkey, case when c_nationkey > 10 then c_name else c_mktsegment end as seed, c_mktsegment as config_hash, case when c_nationkey > 20 then c_name end as config_path from customer")
def determinism_merge(spark, sf_dir):
    name, n = c("c_name"), c("c_nationkey")
    first = F.when(n > 10, F.create_map(F.lit("seed"), name))
    second = F.create_map(F.lit("seed"), c("c_mktsegment"), F.lit("config_hash"), c("c_mktsegment"))
    third = F.when(n > 20, F.create_map(F.lit("config_path"), name, F.lit("seed"), F.lit("unused")))
    m = scalars.first_wins(first, second, third)
    return table(spark, sf_dir, "customer").select("c_custkey", *[m[k].alias(k) for k in ("seed", "config_hash", "config_path")])


@query(f"select user_id, stage, array_to_string(list(memory_delta::bigint order by event_id), ',') as series from {EV} group by 1, 2")
def metric_series(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("k", c("memory_delta").cast("long"))
    return control.metric_series(e, ["user_id", "stage"], "event_id", "k").withColumn("series", F.array_join("series", ","))


_REPORT = """(with d as (select lang, doc_id // 2 as name, doc_id % 2 as side, sha256(text) as digest from documents), a as (select lang, name, max(digest) as digest_a from d where side = 0 group by all), b as (select lang, name, max(digest) as digest_b from d where side = 1 group by all)
select lang, name, digest_a, digest_b, case when digest_a is null or digest_b is null then 'missing' when digest_a = digest_b then 'match' else 'mismatch' end as status from a full outer join b using (lang, name))"""


def _report(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", F.floor(c("doc_id") / 2).alias("name"), (c("doc_id") % 2).alias("side"), F.sha2("text", 256).alias("digest"))
    return control.determinism_report(d.where("side = 0"), d.where("side = 1"), ["lang", "name"])


@query(f"select * from {_REPORT}")
def determinism_report(spark, sf_dir):
    return _report(spark, sf_dir)


@query(f"select lang, case when bool_and(status = 'match') then 'pass' else 'fail' end as status, count(*) as artifacts from {_REPORT} group by 1")
def determinism_status(spark, sf_dir):
    return control.determinism_status(_report(spark, sf_dir), ["lang"])


@query(f"""with s as (select user_id, sha256(string_agg(sha256(stage || ':' || state || ':' || errors), '' order by stage)) as snapshot_digest from {_HEALTH_STATE} group by 1),
e as (select user_id, sha256(string_agg(sha256(stage || ':' || event_id), '' order by ts, stage, event_id)) as event_digest from {EV} group by 1)
select user_id, snapshot_digest, event_digest, sha256(snapshot_digest || ':' || event_digest) as digest from s full outer join e using (user_id)""")
def control_plane_report(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"timestamp_s": c("ts"), "seq_id": c("event_id")})
    return control.control_plane_report(_health(spark, sf_dir), e, ["user_id"], F.concat_ws(":", "stage", "state", "errors"), F.concat_ws(":", "stage", "event_id"))


@query()
def pressure_tuning(spark, sf_dir):
    return control.tune(events(spark, sf_dir).withColumn("ratio", c("memory_delta") / 100), "stage", "event_id", "ratio")


@query()
def pending_fates(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", "ts", c("memory_delta").cast("long").alias("seq"), F.when(c("stage") == "view", "frame").otherwise("result").alias("kind"))
    return control.pending_fates(e, "user_id", "event_id", "ts", "seq", "kind", capacity=8, ttl=864_000.0)


@query()
def memo_hits(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("hash", F.sha2(F.concat_ws(":", "stage", "memory_delta"), 256))
    return control.memo_hits(e, "user_id", "event_id", "ts", "hash", ttl=864_000.0)
