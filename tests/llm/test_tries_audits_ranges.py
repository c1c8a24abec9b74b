"""The conversation trie, the source audit and the range join against brute force and SQL, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import convtrie, divergence, mixing, queries, rangejoin
from strandline.llm.storage import Workspace

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_source_divergence", "op13_range_join"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = c.execute(queries.oracle_sql()[name])
    names = sorted(got.columns)
    assert sorted(d[0] for d in want.description) == names
    place = [[d[0] for d in want.description].index(n) for n in names]
    rows = sorted((tuple(r[k] for k in place) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.select(names).collect()), key=repr) == rows


# --- conversation trie -----------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, span long, block int, path string, x1 long"


def make_turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p", 3) for r in rows], TURNS).repartition(3)


def brute_trie(rows, splice=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if splice else 0
        sign = -1 if c < 0 else 1
        built[c] = own.get(c - sign * (abs(c) % 100), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = set()
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        kids = sum(len(n) == len(node) + 1 for n in below)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(node)))
        out.add((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("bits", [1, 10])
def test_trie_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(convtrie, "BITS", bits)
    rng = random.Random(3)
    rows = [(None, 1, "user", "lost"), (None, None, None, None), (40_000, None, "user", "first"), (40_000, 0, None, None), (40_000, 0, "a", "tie"), (40_000, 0, "a", "tie"), (-250, 3, "user", "below zero"), (-250, 1, "user", "é" * 40_000)]
    for c in [*range(60), *range(100, 130), *range(250, 260), 905]:
        n = rng.choice([1, 2, 3, 7, 9])
        rows += [(c, k if c != 7 else None, rng.choice(["user", "assistant"]) if c % 3 else "user", rng.choice(["", "same", "otheré"]) if c % 4 else "same") for k in range(n)]
    rows += [(1_000, k, "user", f"t{k}") for k in range(40)] + [(2_000 + j, k, "user", f"t{k}" if k < j else f"own{j}") for j in range(6, 30, 3) for k in range(j + 2)]
    got = trie_rows(convtrie.conversation_trie(make_turns(spark, rows), F.expr("conv_id - conv_id % 100"), F.expr("crc32(cast(conv_id as string)) % 6"), 5))
    assert got == brute_trie(rows)
    assert trie_rows(convtrie.conversation_trie(make_turns(spark, rows))) == brute_trie(rows, splice=False)


def test_trie_of_nothing_and_of_one_turn(spark):
    assert convtrie.conversation_trie(make_turns(spark, []).limit(0)).count() == 0
    assert trie_rows(convtrie.conversation_trie(make_turns(spark, [(5, None, None, None)]))) == brute_trie([(5, None, None, None)], splice=False)


def test_trie_copies_share_their_nodes(spark):
    rows = [(c, k, "user", f"turn {k}") for c in range(3_000) for k in range(2)]
    got = trie_rows(convtrie.conversation_trie(make_turns(spark, rows)))
    ends = hashlib.sha256(",".join(map(str, range(3_000))).encode()).hexdigest()
    assert {(d, n, leaves, saved) for _, d, _, n, _, leaves, saved, _ in got} == {(0, 3_000, 1, 2_999 * 12), (1, 3_000, 1, 2_999 * 12), (2, 3_000, 1, 2_999 * 6)}
    assert next(r[7] for r in got if r[1] == 2) == ends


def test_peeling_takes_as_many_rounds_as_paths_hang_below_each_other(spark):
    rows = [(i, i - 1 if i else None, 0, 1) for i in range(6)] + [(100 + i, 2, 0, 10) for i in range(50)]
    work = Workspace(spark, "peel")
    kept = []
    keep, work.keep = work.keep, lambda df, name: kept.append(name) or keep(df, name)
    got = {r["path"]: (r["leaves"], r["saved"]) for r in convtrie.peel(spark.createDataFrame(rows, "path long, up long, at long, saved long"), work).collect()}
    assert got[0] == (56, 506) and got[2] == (54, 504) and got[5] == (1, 1) and len(got) == 56
    assert len(kept) == 7  # the start, and six rounds for the chain of six


# --- source divergence -----------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, groups = Counter(), {}
        for la, source, words in docs:
            if la == lang:
                df.update(set(words))
                groups.setdefault(source, Counter()).update(words)
        kept = [t for t in df if df[t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[t] for t in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def make_texts(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, 3, "i") for r in rows], "text string, lang string, source string, term string, n long, df long, block int, item string").repartition(4)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" + ("é" if i % 5 == 0 else "") + ("ß日" if i % 11 == 0 else "") for i in range(90)]
    rows = [(None, "en", "s0"), ("", "en", "only empty"), ("\x00 12_-\x7f", None, None), (None, "lonely", "one"), (None, "two", "a"), ("", "two", "b")]
    for k in range(400):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", "s3", None, "S1", "é"])
        text = rng.choice([" ", "1", "\n"]).join(rng.choice(words[(hash(source or "") % 7) * 0 + len(source or "") * 5 :]) for _ in range(rng.randrange(0, 30)))
        rows.append((text.upper() if k % 3 == 0 else text, lang, source))
    rows += [rows[50]] * 5 + [("worda " * 40_000, "en", "s1"), ("Longest" * 30_000, "en", "s2")]
    return rows


@pytest.mark.parametrize(("block", "seat", "rounds", "held", "piece"), [(32_768, 4, 8, 200_000, 1 << 20), (7, 1, 1, 10, 64), (20, 2, 2, 50, 1_000)])
def test_audit_equals_brute_force(spark, monkeypatch, texts, block, seat, rounds, held, piece):
    for name, value in (("BLOCK", block), ("SEAT", seat), ("ROUNDS", rounds), ("HELD", held), ("PIECE", piece)):
        monkeypatch.setattr(divergence, name, value)
    for least, top in ((5, 4), (1, 50)) if seat == 4 else ((5, 4),):
        got = divergence.audit_sources(make_texts(spark, texts), least, top).select("lang", "source", "part", "item", "value", "rank")
        assert sorted(tuple(r) for r in got.collect()) == brute_audit(texts, least, top)


def test_audit_of_nothing(spark):
    assert divergence.audit_sources(make_texts(spark, [("a", "b", "c")]).limit(0)).count() == 0


def test_shares_are_exact_for_large_counts():
    n = np.array([0, 1, 10**14, 3 * 10**14])
    total, terms = 4 * 10**14 + 1, 777
    assert divergence.shares(n, total, terms).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in n]


@pytest.mark.parametrize("seats", [2, 4, 6, 10])
def test_tournament_pairs_every_two_seats_once(spark, seats):
    df = spark.range(seats).selectExpr("cast(id as int) as seat", f"{seats} as n").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(seats - 2)))).withColumn("to", divergence.partner("seat", "n", "turn"))
    rows = df.collect()
    assert Counter(frozenset((r["seat"], r["to"])) for r in rows) == {frozenset((a, b)): 2 for a in range(seats) for b in range(a)}
    assert all(len({r["to"] for r in rows if r["turn"] == t}) == seats for t in range(seats - 1))


# --- range join ------------------------------------------------------------------------------------------------------


def make_vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, lab, "c", 5, 6, True) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, cell string, node long, mult long, home boolean").repartition(3)


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_ranges(rows, least):
    n, up = [0] * len(rows), list(range(len(rows)))
    root = lambda k: k if up[k] == k else root(up[k])
    for a, (_, v, la) in enumerate(rows):
        for b in range(a):
            w, lb = rows[b][1:]
            if la is not None and la == lb and sound(v) and sound(w) and len(v) == len(w) and rangejoin.exact_cosine(np.array(v, float), np.array(w, float)) >= least:
                n[a] += 1
                n[b] += 1
                up[root(a)] = root(b)
    least_id = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        least_id[root(k)].append(i)
    first = lambda k: min((i for i in least_id[root(k)] if i is not None), default=None)
    return sorted(((i, n[k], first(k), i is not None and i == first(k)) for k, (i, _, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows, base = [], rng.normal(size=(6, 12))
    for k in range(420):
        v = base[k % 6] + rng.normal(size=12) * [0.02, 0.1, 0.15, 0.6][k % 4]
        rows.append((k, v.tolist(), [1, 1, 1, 2, None][k % 5]))
    rows += [(500 + k, base[0].tolist(), 1) for k in range(30)] + [(530, (base[0] * 3).tolist(), 1), (531, (-base[0]).tolist(), 1)]
    rows += [(540, None, 1), (541, [], 1), (542, [0.0] * 12, 1), (543, [1.0, None] + [0.0] * 10, 1), (544, [float("nan")] * 12, 1), (545, [float("inf")] + [1.0] * 11, 1)]
    rows += [(None, base[1].tolist(), 1), (None, base[1].tolist(), 1), (3, base[2].tolist(), 1), (3, rng.normal(size=12).tolist(), 2), (550, base[1][:5].tolist(), 1), (551, base[1][:5].tolist(), 1)]
    rows += [(560, [1e200 * x for x in base[3]], 1), (561, [1e-200 * x for x in base[3]], 1), (None, [7.0] * 3, 9), (None, None, 9)]
    rows += [(570, [49.0, (100**2 - 98**2) ** 0.5 / 2], 8), (571, [1.0, 0.0], 8), (572, [0.98, 0.199], 8)]
    return rows


def range_rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize(("cell", "block", "copies", "gain"), [(1_024, 1_024, 16, 0.8), (20, 7, 1e9, 1.0), (40, 16, 4, 0.9)])
def test_range_join_equals_brute_force(spark, monkeypatch, vectors, cell, block, copies, gain):
    for name, value in (("CELL", cell), ("BLOCK", block), ("COPIES", copies), ("GAIN", gain)):
        monkeypatch.setattr(rangejoin, name, value)
    assert range_rows(rangejoin.near_duplicates(make_vectors(spark, vectors))) == brute_ranges(vectors, 0.98)


def test_range_join_of_nothing_and_long_vectors(spark):
    assert rangejoin.near_duplicates(make_vectors(spark, [(1, [1.0], 1)]).limit(0)).count() == 0
    rng = np.random.default_rng(1)
    long = rng.normal(size=20_000)
    rows = [(1, long.tolist(), 1), (2, (long + rng.normal(size=20_000) * 0.01).tolist(), 1), (3, rng.normal(size=20_000).tolist(), 1)]
    assert range_rows(rangejoin.near_duplicates(make_vectors(spark, rows))) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_cells_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(8)
    x = rangejoin.unit(np.repeat(rng.normal(size=(60, 5)), 5, axis=0) + rng.normal(size=(300, 5)) * 0.1)
    for radius in (0.05, 0.2, 0.5):
        pivots = rangejoin.spread_pivots(x[:120], radius)
        home, _, reach = rangejoin.assign(x, pivots, radius)
        near = np.linalg.norm(x[:, None] - x[None], axis=2) <= radius
        for a, b in zip(*np.nonzero(near), strict=True):
            first = min(home[a], home[b])
            assert reach[a, first] and reach[b, first]


def test_pivots_leave_cells_apart_and_name_cores(spark, monkeypatch):
    """Clusters far from each other share no cell, and a tight family is settled by its count."""
    rng = np.random.default_rng(2)
    centres = np.eye(8)
    rows = [(k, (centres[k % 8] + rng.normal(size=8) * 0.004).tolist(), 1) for k in range(800)]
    monkeypatch.setattr(rangejoin, "CELL", 150)
    found = {}
    cells = rangejoin._cells
    monkeypatch.setattr(rangejoin, "_cells", lambda r, radius, work: found.setdefault("rows", cells(r, radius, work)))
    got = range_rows(rangejoin.near_duplicates(make_vectors(spark, rows)))
    assert all(r[1] == 99 for r in got) and sum(r[3] for r in got) == 8
    assert found["rows"].where("not home").count() == 0 and found["rows"].where("core").count() == 800


# --- mixing, on sources with large documents and copies ---------------------------------------------------------------


def words(n):
    return " ".join(["w"] * n)


@pytest.mark.parametrize("bucket", [300, 10_000])
def test_mixing_totals_do_not_depend_on_buckets(spark, monkeypatch, bucket):
    """One document of 40 % of its source: totals are met, and copies stay fair."""
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rows = [(0, words(4_000), "a")] + [(i, words(10), "a") for i in range(1, 601)] + [(1_000 + i, words(5), "bc"[i % 2]) for i in range(2_400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    large, taken = [], []
    for seed in range(7, 15):
        out = mixing.mix_sources(df, weights=(0.8, 0.5, 0.5), share=0.45, seed=seed).toPandas()
        per = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
        assert (abs(per["taken"] - per["target"]) <= 10).all() and (out["copies"] <= 3).all() and len(out) == len(rows)
        large.append(int(out[out.doc_id == 0]["copies"].iloc[0]))
        taken.append(per.loc["a", "target"])
    assert taken[0] == pytest.approx(22_000 * 0.45 * 0.8 / 1.8) and 0 < sum(large) < len(large)


def test_large_documents_are_fair_and_leave_a_pool_that_can_be_met():
    rng = np.random.default_rng(0)
    sizes, n = np.array([4_000, 900, 50, 50, 10]), np.array([1, 1, 3, 1, 1])
    whole, mean, runs = 10_000.0, np.zeros(5), 3_000
    for _ in range(runs):
        got, rest = mixing.take_large(sizes, n, rng.random(5), 8_000.0, whole, 3.0)
        assert 0 <= rest <= 3 and rest * (whole - (sizes * n).sum()) + (sizes * got).sum() == pytest.approx(8_000)
        mean += np.array(got) / runs
    assert np.abs(mean - 0.8 * n).max() < 0.06
    assert mixing.take_large(np.array([950]), np.array([1]), np.array([0.99]), 800.0, 1_000.0, 3.0)[0] == [1]  # leaving it out would miss by far
    assert mixing.take_large(np.array([1_000]), np.array([1]), np.array([0.1]), 200.0, 1_000.0, 3.0)[0] == [0]
    assert mixing.take_large(np.array([1_000]), np.array([1]), np.array([0.5]), 3_000.0, 1_000.0, 3.0)[0] == [3]


def test_mixing_spreads_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "UNFOLD", 100)
    monkeypatch.setattr(mixing, "LARGE", 64)
    rows = [(None, words(7), "a")] * 1_000 + [(5, words(3), "a")] * 250 + [(i, words(2), "b") for i in range(10, 400)] + [(None, None, "a")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix_sources(df).toPandas()
    per = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), n=("size", "count"))
    assert per["n"].tolist() == [1_253, 390] and (abs(per["taken"] - per["target"]) <= 7).all()
    copies = out[out["size"] == 7]["copies"]
    assert len(copies) == 1_000 and copies.max() - copies.min() <= 1
    again = mixing.mix_sources(df.repartition(2)).toPandas()
    key = ["doc_id", "size", "copies"]
    assert sorted(map(tuple, out.fillna(-1)[key].values)) == sorted(map(tuple, again.fillna(-1)[key].values))
