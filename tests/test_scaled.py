"""Operators whose groups no task may hold: products, selections, alignments, propagation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import blocks, descriptors, joins, recognition, scans, similarity, sparse, telemetry, trajectory


def motions(rng, n):
    """Row-major 4x4 rigid motions."""
    q = rng.normal(size=(n, 4))
    w, x, y, z = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    m = np.zeros((n, 4, 4))
    m[:, :3, :3] = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], axis=1).reshape(-1, 3, 3)
    m[:, :3, 3], m[:, 3, 3] = rng.normal(size=(n, 3)), 1
    return m


@pytest.mark.parametrize(("width", "fan"), [(7, 5), (1_024, 1_024)])
def test_products_over_many_spans_equal_a_sequential_product(spark, width, fan):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for key, n in (("a", 700), ("b", 3), (None, 40)):
        now = np.eye(4)
        for i, m in enumerate(motions(rng, n)):
            now = now @ m
            place = i * 2 - 30
            want[key, place] = now.copy()
            rows.append((key, place, m.ravel().tolist()))
    rows += [("a", 5_000, None), ("a", 5_001, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "s string, i long, pose array<double>").repartition(6)
    got = scans.prefix_products(df, "s", "i", "pose", width, fan).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose(np.reshape(r["pose"], (4, 4)), want[r["s"], r["i"]], atol=1e-9)
    assert scans.prefix_products(df.limit(0), "s", "i", "pose").count() == 0


def test_numbers_run_on_over_spans(spark):
    rows = [(k, float(x), y) for k in ("a", None) for x in (0, 1, 1, 5, 900, 901, 901, 5_000) for y in (1, 2)] + [("a", None, 3)]
    got = scans.numbered(spark.createDataFrame(rows, "k string, x double, y int"), ["k"], ["x", "y"], width=10).collect()
    for k in ("a", None):
        mine = sorted((r["place"], r["x"] if r["x"] is not None else -1, r["y"]) for r in got if r["k"] == k)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1] for m in mine] == sorted(m[1] for m in mine)


@pytest.mark.parametrize(("group", "sharp"), [(20, 200), (1, 50), (4_096, 10_000)])
def test_quantiles_are_exact(spark, monkeypatch, group, sharp):
    """Heavy ties, tails, negative and equal values; brackets that go round several times."""
    monkeypatch.setattr(scans, "GROUP", group)
    monkeypatch.setattr(scans, "SHARP", sharp)
    rng = np.random.default_rng(5)
    groups = {"normal": rng.normal(size=3_000), "ties": np.repeat([1.0, 2.0, 7.5], [900, 1_000, 50]), "tail": np.exp(rng.normal(size=2_500) * 30), "one": np.array([3.0]), "two": np.array([1.0, 2.0]), "same": np.full(400, -4.25), None: rng.integers(0, 40, 800).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None), ("gone", None)], "k string, v double").repartition(5)
    at = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "least": 0.0, "most": 1.0}
    got = {r["k"]: r for r in scans.exact_quantiles(df, ["k"], "v", at).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, q in at.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, q), rel=1e-12), (k, name)
    assert scans.exact_quantiles(df.limit(0), ["k"], "v", at).count() == 0


def test_no_task_holds_a_large_group(spark, monkeypatch):
    """All but the few rows between two values of a sketch stay out of the sorted lists."""
    monkeypatch.setattr(scans, "GROUP", 500)
    df = spark.range(40_000).select(F.lit("all").alias("k"), F.xxhash64("id").cast("double").alias("v"))
    seen = []
    select = scans._select

    def spy(rows, names, asked):
        seen.append(asked.count())
        return select(rows, names, asked)

    monkeypatch.setattr(scans, "_select", spy)
    got = scans.exact_quantiles(df, ["k"], "v", {"p50": 0.5}).first()
    values = np.sort([r["v"] for r in df.collect()])
    assert seen == [2] and got["p50"] == pytest.approx(np.quantile(values, 0.5), rel=1e-12)


def test_digest_by_ranks_equals_the_builtin(spark, monkeypatch):
    monkeypatch.setattr(scans, "GROUP", 30)
    monkeypatch.setattr(scans, "SHARP", 100)
    df = spark.range(2_000).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("stage"), (F.xxhash64("id") % 1_000 / 8).alias("duration_s"))
    want = df.rollup("stage").agg(F.grouping_id().alias("g"), F.percentile("duration_s", F.lit(0.95)).alias("p"), F.count("*").alias("n"))
    got = telemetry.digest(df)
    key = lambda a, n, p: (str(a), n, round(p, 9))
    assert sorted(key(r["stage"], r["event_count"], r["p95"]) for r in got.collect()) == sorted(key(r["stage"], r["n"], r["p"]) for r in want.collect())
    assert telemetry.digest(df, exact=False).count() == 5


def test_stored_sketches_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 4).alias("run"), (F.xxhash64("id") / 2.0**63).alias("v"))
    stored = scans.sketches(df, ["k", "run"], "v")
    merged = {r["k"]: r for r in scans.merged_quantiles(stored, ["k"], {"p50": 0.5, "p99": 0.99}).collect()}
    for k in (0, 1):
        values = np.array([r["v"] for r in df.where(F.col("k") == k).collect()])
        assert merged[k]["n"] == 10_000
        assert abs((values < merged[k]["p50"]).mean() - 0.5) < 0.03 and abs((values < merged[k]["p99"]).mean() - 0.99) < 0.02


@pytest.mark.parametrize("mirror", [1, -1])
def test_errors_in_space_equal_a_direct_alignment(spark, monkeypatch, mirror):
    monkeypatch.setattr(scans, "SPAN", 16)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for seq in range(4):
        g = rng.normal(size=(90, 3)) * [3, 2, 1] + 1e5 * (seq == 3)
        e = (g - g.mean(0)) @ motions(rng, 1)[0, :3, :3] * 0.5 * [1, 1, mirror] + rng.normal(size=(90, 3)) * 0.1 + 7
        r, t, s = trajectory.align_matrix(e, g)
        off = g - (s * e @ r.T + t)
        ate, rpe = np.linalg.norm(off, axis=1), np.linalg.norm(off[4:] - off[:-4], axis=1)
        want[seq] = [s, np.sqrt((ate**2).mean()), np.sqrt((rpe**2).mean()), ate.mean(), np.median(ate), np.median(rpe)]
        rows += [(seq, i * 3, *map(float, g[i]), *map(float, e[i])) for i in range(90)]
    rows += [(9, i, 1.0, 2.0, float(i), 5.0, 5.0, 5.0) for i in range(3)]  # an estimate that doesn't move
    df = spark.createDataFrame(rows, "seq long, idx long, gx double, gy double, gz double, ex double, ey double, ez double").repartition(5)
    got = {r["seq"]: r for r in trajectory.errors_3d(df, ["seq"], 4).collect()}
    report = df.select(F.col("seq").cast("string").alias("sequence"), "idx", F.array("gx", "gy", "gz").alias("g"), F.array("ex", "ey", "ez").alias("e"), F.lit(4).alias("delta"))
    full = {int(r["sequence"]): r for r in trajectory.error_report(report).collect()}
    for seq, w in want.items():
        assert [got[seq][k] for k in ("scale", "ate_rmse", "rpe_rmse")] == pytest.approx(w[:3], rel=1e-6)
        assert [full[seq][k] for k in ("ATE_RMSE", "RPE_RMSE", "ATE_MEAN", "ATE_MEDIAN", "RPE_MEDIAN")] == pytest.approx(w[1:], rel=1e-6)
    assert got[9]["scale"] is None and got[9]["ate_rmse"] is None and full[9]["ATE_MEDIAN"] is None


def brute_states(states, needs):
    now = dict(states)
    for _ in range(len(now)):
        for stage in sorted(now):
            up = [now.get(n, "healthy") for s, n in needs if s == stage]
            if "tripped" in up:
                now[stage] = "degraded" if now[stage] != "tripped" else "tripped"
            elif ("recovering" in up or "degraded" in up) and now[stage] == "healthy":
                now[stage] = "degraded"
    return now


def test_propagation_reaches_its_fixed_point(spark):
    chain = [(f"c{i:02}", "healthy") for i in range(50)]
    chain[0] = ("c00", "tripped")
    loop = [(f"l{i}", "healthy") for i in range(5)]
    odd = [("t", "tripped"), ("r", "recovering"), ("r2", "recovering"), ("d", "degraded"), ("x", "healthy"), ("y", "healthy"), ("alone", "healthy")]
    needs = [(f"c{i:02}", f"c{i - 1:02}") for i in range(1, 50)] + [(f"l{i}", f"l{(i + 1) % 5}") for i in range(5)] + [("l3", "d"), ("r", "t"), ("r2", "d"), ("x", "r2"), ("y", "nowhere"), ("t", "d"), ("x", "r2"), (None, "t"), ("y", None)]
    states = chain + loop + odd
    df, up = spark.createDataFrame(states, "stage string, state string"), spark.createDataFrame(needs, "stage string, needs string")
    want = brute_states(states, needs)
    assert {r["stage"]: r["state"] for r in joins.propagate(df, up).collect()} == want
    assert want["c49"] == "degraded" and want["l0"] == "degraded" and want["r"] == "degraded" and want["r2"] == "recovering"
    two = {r["stage"]: r["state"] for r in joins.propagate(df, up, 2).collect()}
    assert two["c02"] == "degraded" and two["c03"] == "healthy"
    assert {r["state"] for r in joins.propagate(df.where("state = 'healthy'"), up).collect()} == {"healthy"}


def test_recognition_is_exact_and_reads_few_lists(spark):
    rng = np.random.default_rng(6)
    n, words = 400, 60
    common = rng.integers(0, 4, size=(n, words)) * (rng.random((n, words)) < 0.06)
    common[:, 0] = rng.integers(1, 3, n)  # in every item, with little to add
    rare = np.zeros((n, 200))
    for i in range(n):
        rare[i, i // 4] = 6 + i % 4  # four places look alike
    counts = np.hstack([common, rare])
    counts[7] = counts[6]
    rows = [(int(i), f"w{j}", float(counts[i, j])) for i, j in zip(*np.nonzero(counts))] + [(999, "lonely", 1.0)]
    items = recognition.unit_weights(spark.createDataFrame(rows, "id long, word string, n double").repartition(4))
    queries = items.where("id % 5 = 1 or id = 999")
    unit = counts / np.linalg.norm(counts, axis=1, keepdims=True)
    got = {}
    for r in recognition.recognise(items, queries, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert set(got) == {i for i in range(n) if i % 5 == 1}
    for i in got:
        s = np.round(unit @ unit[i], 9)
        want = [j for j in np.lexsort((np.arange(n), -s)) if j != i and s[j] > 0][:3]
        assert [(rank, j) for rank, j, _ in sorted(got[i])] == [(k + 1, j) for k, j in enumerate(want)]
        assert [score for _, _, score in sorted(got[i])] == pytest.approx([s[j] for j in want], abs=1e-8)
    terms = recognition.bounded(queries, items)
    assert recognition.candidates(terms, items, 3).count() < 0.2 * n * (n / 5)  # all share a word with all
    assert recognition.recognise(items.limit(0), queries, 3).count() == 0


def brute_matches(a, b, radius, ratio):
    out = set()
    for pair in {p for p, _, _ in a}:
        mine, other = sorted((i, x) for p, i, x in a if p == pair and x is not None), sorted((i, x) for p, i, x in b if p == pair and x is not None)
        off = lambda x, y: sum((u ^ v).bit_count() for u, v in zip(x, y, strict=True))
        for i, x in mine:
            found = sorted((off(x, y), j) for j, y in other)
            if not found:
                continue
            d, j = found[0]
            y = dict(other)[j]
            back = min((off(z, y), k) for k, z in mine)[1]
            if d <= radius and back == i and (len(found) == 1 or d < ratio * found[1][0]):
                out.add((pair, i, j, d))
    return out


@pytest.mark.parametrize("radius", [4, 12, 25])
def test_descriptors_match_as_by_all_distances(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, size=(60, 4), dtype=np.uint64) * 2 + rng.integers(0, 2, size=(60, 4), dtype=np.uint64)

    def noisy(x, flips):
        x = x.copy()
        for at in rng.choice(256, flips, replace=False):
            x[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
        return x

    a = [("p" if k % 3 else "q", k, noisy(base[k], rng.integers(0, 10))) for k in range(60)]
    b = [("p" if k % 3 else "q", 1_000 + k, noisy(base[k], rng.integers(0, 14))) for k in range(60)] + [("p", 2_000 + k, noisy(base[k], 12)) for k in range(0, 60, 2)]
    a += [("p", 70, a[1][2]), ("p", 71, base[0] * 0), ("p", 72, base[0] * 0), ("lone", 1, base[0])]
    b += [("p", 3_000, b[4][2]), ("p", 3_001, base[0] * 0), ("lone", 5, base[0])]
    signed = lambda x: [int(v) for v in x.astype(np.int64)]
    frame = lambda rows, n: spark.createDataFrame([(p, i, signed(x)) for p, i, x in rows] + [(None, 8, signed(base[0])), ("p", 9_999, None)], f"pair string, {n} long, bits array<long>").repartition(4)
    got = descriptors.match(frame(a, "a"), frame(b, "b"), radius, 4)
    whole = lambda rows: [(p, i, [int(v) for v in x]) for p, i, x in rows]
    want = brute_matches(whole(a), whole(b), radius, 0.8)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 3
    pairs = descriptors.within(frame(a, "a"), frame(b, "b"), radius, 4).select("a", "b").collect()
    assert len(pairs) == len({tuple(r) for r in pairs})


def test_descriptor_bits_are_packed(spark):
    row = spark.createDataFrame([([0, 63, 64, 200],)], "at array<int>").select(descriptors.packed(F.col("at"), 4).alias("b")).first()
    assert row["b"] == [1 - 2**63, 1, 0, 1 << 8]
    with pytest.raises(ValueError, match="radius"):
        descriptors.within(None, None, 48, 4)


@pytest.mark.parametrize("size", [1, 3])
def test_conjugate_gradients_equal_a_dense_solve(spark, size):
    rng = np.random.default_rng(size)
    n = 40
    a, b = np.zeros((n * size, n * size)), np.zeros(n * size)
    rows, off = [], []
    links = [(k, k, 1.0) for k in range(n)] + [(k, k + 1, 2.0) for k in range(n - 1)] + [(3, 30, 5.0)]
    for f, (i, j, w) in enumerate(links):
        states = sorted({i, j})
        jac = rng.normal(size=(size, size * len(states)))
        r = rng.normal(size=size)
        at = np.concatenate([np.arange(size) + s * size for s in states])
        a[np.ix_(at, at)] += w * jac.T @ jac
        b[at] -= w * jac.T @ r
        rows += [(f, s, q, col, float(jac[q, k * size + col]), w) for k, s in enumerate(states) for q in range(size) for col in range(size)]
        off += [(f, q, float(r[q])) for q in range(size)]
    blocks, right = sparse.normal_equations(spark.createDataFrame(rows, "factor long, state long, row int, col int, value double, weight double"), spark.createDataFrame(off, "factor long, row int, value double"), size)
    x, residuals = sparse.conjugate_gradients(blocks, right, size, 1e-11)
    got = {r["i"]: r["x"] for r in x.collect()}
    want = np.linalg.solve(a, b).reshape(n, size)
    assert residuals[-1] <= 1e-11 and all(np.allclose(got[k], want[k], rtol=1e-5, atol=1e-7) for k in range(n))
    assert sparse.conjugate_gradients(blocks.limit(0), right.limit(0), size)[0].count() == 0


def test_nearest_by_tiles_and_cells_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 9)
    monkeypatch.setattr(blocks, "PASSING", 14)
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, size=(90, 4)).astype(float)  # many ties
    v[5] = v[6] = 0
    labels = [None if i % 11 == 3 else i % 3 for i in range(90)]
    df = spark.createDataFrame([(i, labels[i], v[i].tolist()) for i in range(90)], "id long, label int, v array<double>").repartition(5)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, size, where=size > 0, out=np.zeros_like(v))
    s = np.round(unit @ unit.T, 9)
    met = lambda i, j: labels[i] is not None and labels[i] == labels[j]
    to = {i: min(((-s[i, j], j) for j in range(90) if (i + j) % 2 and met(i, j)), default=(0, None))[1] for i in range(90)}
    want = {(i, to[i]) for i in range(0, 90, 2) if to[i] is not None and to[to[i]] == i}
    got = similarity.mutual_cosine(df.where("id % 2 = 0"), df.where("id % 2 = 1"), "label").collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 5
    found = {}
    for r in similarity.cosine_top_k(df.select("id", "v"), df.where("id % 5 = 0").select("id", "v"), 7, least=0.1).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for q in range(0, 90, 5):
        best = [j for j in np.lexsort((np.arange(90), -s[q])) if j != q and s[q, j] >= 0.1][:7]
        assert [j for _, j in sorted(found.get(q, {}).items())] == best


def test_a_tile_of_scores_is_small_and_a_task_keeps_k(monkeypatch):
    rng = np.random.default_rng(5)
    best, s = blocks.TopK(np.arange(50), 3), rng.normal(size=(50, 20_000))
    for at in range(0, 20_000, blocks.TILE):
        best.offer(s[:, at : at + blocks.TILE].copy(), np.arange(1_000 + at, 1_000 + min(at + blocks.TILE, 20_000)))
        assert best.n <= 8 * 50 * 3 + 50 * blocks.TILE
    assert best.table().num_rows == 150 and blocks.TILE <= 1_024


def test_recognition_shuffles_no_pairs_of_a_common_word(spark):
    texts = [(i, " ".join(["all"] * (1 + i % 3) + [f"w{i % 7}", f"x{i % 11}", f"lone{i}"])) for i in range(60)] + [(70, ""), (71, "apart"), (72, None)]
    bags = recognition.bags(spark.createDataFrame(texts, "id long, text string").where("text is not null").repartition(3))
    found = recognition.nearest_bags(bags, bags.where("id % 10 = 0"), 4, block=3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    words = {i: t.split(" ") if t else [] for i, t in texts}
    names = sorted({w for x in words.values() for w in x})
    n = np.array([[x.count(w) for w in names] for i, x in words.items() if i < 60], float)
    unit = n / np.linalg.norm(n, axis=1, keepdims=True)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
    assert set(got) == set(range(0, 60, 10))
    for q in got:
        s = np.round(unit @ unit[q], 9)
        want = [j for j in np.lexsort((np.arange(60), -s)) if j != q][:4]
        assert [j for _, (j, _) in sorted(got[q].items())] == want and got[q][1][1] == pytest.approx(s[want[0]])


@pytest.mark.parametrize(("size", "runs", "most"), [(1, 5, 1), (2, 5, 1), (1, 20, 60)])
def test_systems_dealt_to_parts_equal_a_dense_solve(spark, size, runs, most):
    """Chains of 10 states, as they are (solved without a step over all parts) or cut by parts that they are coupled across."""
    rng = np.random.default_rng(size)
    n = 50
    a, b, rows, off = np.zeros((n * size, n * size)), np.zeros(n * size), [], []
    for f, states in enumerate([(k,) for k in range(n)] + [(k, k + 1) for k in range(n - 1) if k % 10 < 9]):
        jac, r = rng.normal(size=(size, size * len(states))) + np.tile(3 * np.eye(size), len(states)), rng.normal(size=size)
        at = np.concatenate([np.arange(size) + s * size for s in states])
        a[np.ix_(at, at)] += jac.T @ jac
        b[at] -= jac.T @ r
        rows += [(f, s, s * runs // n, q, col, float(jac[q, k * size + col]), 1.0) for k, s in enumerate(states) for q in range(size) for col in range(size)]
        off += [(f, q, float(r[q])) for q in range(size)]
    blocks, right = sparse.normal_equations(spark.createDataFrame(rows, "factor long, state long, part long, row int, col int, value double, weight double"), spark.createDataFrame(off, "factor long, row int, value double"), size)
    x, residuals = sparse.conjugate_gradients(blocks, right, size, 1e-11)
    got = {r["i"]: r["x"] for r in x.collect()}
    want = np.linalg.solve(a, b).reshape(n, size)
    assert residuals[-1] <= 1e-11 and len(residuals) <= most and all(np.allclose(got[k], want[k], rtol=1e-5, atol=1e-7) for k in range(n))
    assert sparse.conjugate_gradients(blocks.limit(0), right.limit(0), size)[0].count() == 0


def test_descriptors_meet_only_where_their_bits_allow_it(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 40)
    monkeypatch.setattr(blocks, "PASSING", 90)
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 257, 600)
    sizes[:150] = 256 - sizes[:150] % 3  # full ones are all near each other
    rows = []
    for k, n in enumerate(sizes.tolist()):
        bits = np.zeros(256, np.uint8)
        bits[rng.choice(256, n, replace=False)] = 1
        if k % 3 == 2:
            bits = rows[k - 1][2].copy()
            bits[rng.choice(256, k % 7, replace=False)] ^= 1
        rows.append(("p" if k % 5 else "q", k, bits))
    a, b = [r for r in rows if r[1] % 2 == 0], [r for r in rows if r[1] % 2]
    long = lambda x: [int(v) for v in np.packbits(x).view(np.int64)]
    frame = lambda rows, n: spark.createDataFrame([(p, i, long(x)) for p, i, x in rows], f"pair string, {n} long, bits array<long>").repartition(4)
    got = descriptors.match(frame(a, "a"), frame(b, "b"), 24, 4)
    plain = lambda rows: [(p, i, [int(v) for v in np.packbits(x).view(np.uint64)]) for p, i, x in rows]
    want = brute_matches(plain(a), plain(b), 24, 0.8)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50
    found = descriptors._nearest(frame(a, "id"), frame(b, "id").withColumn("n", F.lit(1)), 4, 30, 2, False)
    assert found.agg(F.max("distance")).first()[0] <= 30  # no more than the ratio test needs is kept


def test_sketches_bound_scores_and_leave_out_only_what_is_below_the_best(spark):
    rng = np.random.default_rng(3)
    p = 1 / np.arange(1, 401)
    texts, n = [], 900
    for i in range(n):
        kind = "abc"[i % 3]
        at = rng.choice(400, rng.integers(1, 120), p=p / p.sum())
        texts.append([f"{kind}{w}" for w in at] + (texts[i - 3][:60] if i % 7 == 6 else []))
    bags = recognition.bags(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string").repartition(3))
    rows = bags.orderBy("id").collect()
    sizes = np.array([len(r["words"]) for r in rows])
    words, weights = np.concatenate([r["words"] for r in rows]).astype(np.int64), np.concatenate([r["weights"] for r in rows])
    index = recognition.Postings(np.arange(n), sizes, words, weights)
    names = np.unique(words)
    unit = np.zeros((n, len(names)))
    unit[np.repeat(np.arange(n), sizes), np.searchsorted(names, words)] = weights
    s = unit @ unit.T
    for sketch in (index.first, index.second):
        assert (sketch @ sketch.T + index.room >= s).all()
    got = {}
    for r in recognition.nearest_bags(bags, bags.where("id % 5 = 0"), 4, block=60).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for q in range(0, n, 5):
        t = np.round(s[q], 9)
        want = [j for j in np.lexsort((np.arange(n), -t)) if j != q and t[j] > 0][:4]
        assert [j for _, j, _ in sorted(got[q])] == want and [x for _, _, x in sorted(got[q])] == pytest.approx([t[j] for j in want], abs=1e-8)
