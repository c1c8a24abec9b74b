"""Each corpus operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import chatformat, decontam, hashing, langid, learning, linededup, mixing, ngramjoin, quality, substring, toxicity, vptree
from strandline.llm.components import components
from strandline.llm.storage import Workspace

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "n long, s1 long, pg string, id long, cluster string, spans string, size long, key string, cut string, block int"


def make_docs(spark, rows, odd=True):
    """rows of (doc_id, text) with source, lang, length and columns whose names clash with inner ones."""
    full = [(i, t, f"src{(i or 0) % 3}" if i != 5 else None, "en" if i != 4 else None, len(t) if t else 0) + ((7, 8, "p", 9, "c", "s", 3, "k", "u", 1) if odd else ()) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, n_chars long" + (f", {ODD}" if odd else "")).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"Word{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = say(120), say(45)
    out = [(0, None), (1, ""), (2, " \t\n "), (3, "one two three"), (4, "one two three"), (5, "ONE two three"), (6, "one two three four five")]
    for k in range(7, 40):
        w = list(base)
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((k, " ".join(w)))
    for k in range(40, 60):
        w = say(rng.randrange(5, 90))
        at = rng.randrange(len(w))
        out.append((k, " ".join(w[:at] + passage[: rng.randrange(15, 45)] + w[at:])))
    out += [(60, " ".join(base)), (61, " ".join(base * 2)), (62, "\n".join(" ".join(say(4)) for _ in range(3000))), (62 + 1, " ".join(passage) + "\x0b\n" + " ".join(passage).replace(" ", "\t"))]
    return out


def brute_components(rows, n=5, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}
    root = lambda x: x if up[x] == x else root(up[x])
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_ngram_join_equals_brute_force(spark, rows):
    got = {r[0]: (r[1], r[2]) for r in ngramjoin.jaccard_components(make_docs(spark, rows)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("bits", [21, 6])
def test_ngram_join_blocks_and_long_lists(spark, rows, monkeypatch, bits):
    for name, value in (("BLOCK_DOCS", 5), ("SHORT", 3), ("BLOCK_GROUPS", 4), ("HEAVY", 2), ("SKETCH_BITS", bits)):
        monkeypatch.setattr(ngramjoin, name, value)
    got = {r[0]: (r[1], r[2]) for r in ngramjoin.jaccard_components(make_docs(spark, rows, False)).collect()}
    assert got == brute_components(rows)


def test_ngram_join_null_ids_and_repeats(spark):
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in ngramjoin.jaccard_components(make_docs(spark, [(3, "a b c"), (3, "a b c"), (None, "a b c"), (9, "a b c")])).collect())
    assert got == [(-1, 1, None), (3, 1, 3), (3, 1, 3), (9, 1, 3)]
    assert ngramjoin.jaccard_components(make_docs(spark, [])).count() == 0


def test_parity_bound_never_loses_a_link():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 90).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(40, 90)], rng.integers(0, 2**63, rng.integers(1, 25)).astype(np.uint64)])) for _ in range(60)]
    low = [np.bincount((s & np.uint64(ngramjoin.PARITY - 1)).astype(int), minlength=ngramjoin.PARITY) & 1 for s in sets]
    maps = [np.append(np.packbits(x.astype(np.uint8)).view(">u8").astype(np.uint64), np.uint64(len(s))) for x, s in zip(low, sets)]
    linked, passed = ngramjoin.overlaps(sets, sets, 60), ngramjoin.near(maps, maps, 60)
    assert linked.any() and not passed.all() and (passed | ~linked).all()
    part = ngramjoin.spanned(sets, ngramjoin.overlaps, 60, tile=7)
    up = list(range(60))
    for i, j in zip(*np.nonzero(linked)):
        a, b = sorted((up[i], up[j]))
        up = [a if x == b else x for x in up]
    assert part.tolist() == up


def brute_cut(rows, width=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard", [6000, 3])
def test_substring_equals_brute_force(spark, rows, shard, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_ANCHORS", shard)
    got = substring.remove_repeats(make_docs(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_cut(rows)


def test_substring_odd_rows(spark):
    text = " ".join(f"x{i}" for i in range(30))
    got = sorted((r[0] if r[0] is not None else -1, r["n_removed"]) for r in substring.remove_repeats(make_docs(spark, [(2, text), (2, text), (None, text), (8, text)])).collect())
    assert got == [(-1, 0), (2, 0), (2, 0), (8, 30)]
    assert substring.remove_repeats(make_docs(spark, [])).count() == 0


def test_suffix_automaton_finds_first_ends():
    rng = random.Random(2)
    a, texts = substring.SuffixAutomaton(), [[rng.randrange(3) for _ in range(40)] for _ in range(6)]
    for d, t in enumerate(texts):
        a.add(t, d, 0)
    probe = [rng.randrange(3) for _ in range(60)]
    for i, v in enumerate(a.match(probe, 4)):
        hits = [(d, e) for d, t in enumerate(texts) for e in range(3, 40) if i >= 3 and t[e - 3 : e + 1] == probe[i - 3 : i + 1]]
        assert (v >= 0) == bool(hits)
        assert not hits or (a.doc[v], a.end[v]) == min(hits)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    lines = [f"line {i}" for i in range(12)]
    rows = [(0, None), (1, ""), (2, "a\nb"), (3, "\n\n\n\n\n")] + [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 30)))) for k in range(4, 40)]
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["pg"]) for r in linededup.dedup_lines(make_docs(spark, rows)).collect()}
    seen = set()
    for i, t in rows:
        ls = t.split("\n") if t is not None else []
        gone = [False] * len(ls)
        for k in range(len(ls) - 2):
            key = tuple(ls[k : k + 3])
            if key in seen:
                gone[k : k + 3] = [True] * 3
            seen.add(key)
        assert got[i] == (None if t is None else "\n".join(x for x, g in zip(ls, gone) if not g), sum(gone), "p"), i
    odd = linededup.dedup_lines(make_docs(spark, [(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (7, "a\nb\nc")])).select("doc_id", "n_removed").collect()
    assert sorted((r[0] or -1, r[1]) for r in odd) == [(-1, 0), (1, 0), (1, 0), (7, 3)]
    assert linededup.dedup_lines(make_docs(spark, [])).count() == 0


def test_line_dedup_shuffles_touched_texts_only(spark):
    """Without rows to cut no text passes an exchange; long texts, ties and repeated windows inside one document."""
    rows = [(k, f"a{k}\nb{k}\nc{k}") for k in range(20)] + [(None, "x\ny\nz")] * 5
    got = linededup.dedup_lines(make_docs(spark, rows)).collect()
    assert len(got) == 25 and all(r["n_removed"] == 0 and r["n_lines"] == 3 for r in got)
    long = "\n".join(f"line {i % 1000}" for i in range(20_000))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(make_docs(spark, [(1, long), (2, long), (3, "\n".join(f"line {i}" for i in range(1000)))])).collect()}
    assert [(got[k]["n_lines"], got[k]["n_removed"]) for k in (1, 2, 3)] == [(20_000, 19_000), (20_000, 20_000), (1000, 1000)]
    assert got[1]["text"] == "\n".join(f"line {i}" for i in range(1000)) and got[2]["text"] == got[3]["text"] == ""


def test_chat_collapse(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "<|im_end|>"), (4, 0, "user", "other"), (5, 0, "user", "other"), (None, 0, "user", "x"), (6, None, None, None), (3, 2, "user", "<|im_end|>")]
    df = spark.createDataFrame([r + (9,) for r in rows], "conv_id long, turn long, role string, text string, len long")
    got = {r["conv_id"]: r for r in chatformat.collapse_and_render(df).collect()}
    assert set(got) == {3, 4, 6}
    assert got[3]["n_turns"] == 3 and got[4]["n_copies"] == 2
    assert got[3]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyo<|im_end|>\n<|im_start|>user\n< |im_end|><|im_end|>\n"
    assert chatformat.collapse_and_render(df.limit(0)).count() == 0


def test_targets_and_pivoting(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 60)))) for i in range(900)] + [(None, "a b"), (1, "a b")]
    df = make_docs(spark, rows).withColumn("source", F.when(F.col("doc_id") < 40, "a").when(F.col("doc_id") < 500, "b").when(F.col("doc_id") < 880, "c"))
    out = mixing.mix_sources(df).toPandas()
    assert len(out) == len(rows) and (out["taken"] <= 3 * out["size"]).all()
    per = out.fillna({"source": "~"}).groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    total, weights, goal = per["size"].sum(), dict(zip(["a", "b", "c", "~"], [1, 2, 3, 1])), {}
    left, names = float(total), set(per.index)
    while names:
        w = sum(weights[n] for n in names)
        over = {n for n in names if left * weights[n] / w > 3 * per["size"][n]}
        for n in over or names:
            goal[n] = 3.0 * per["size"][n] if over else left * weights[n] / w
        left -= sum(goal[n] for n in over)
        names -= over or names
    for n in per.index:
        assert per["target"][n] == pytest.approx(goal[n]) and abs(per["taken"][n] - goal[n]) <= 60, n
    again = mixing.mix_sources(df.repartition(5)).toPandas()
    assert sorted(zip(out["doc_id"].fillna(-1), out["taken"])) == sorted(zip(again["doc_id"].fillna(-1), again["taken"]))
    assert mixing.mix_sources(make_docs(spark, [])).count() == 0


def test_pivot_keeps_mass_and_is_fair():
    sizes = np.array([50, 40, 7, 7, 3, 2, 1, 1, 30, 5] * 3)
    for p in (np.full(30, 0.37), np.linspace(0.1, 0.9, 30)):
        mean = np.zeros(30)
        for seed in range(400):
            q = mixing.pivot(np.arange(30), sizes, p, seed)
            assert (sizes * q).sum() == pytest.approx((sizes * p).sum()) and ((q > 0) & (q < 1)).sum() <= 1
            mean += q / 400
        assert np.abs(mean - p).max() < 0.13


def test_mixing_tree_has_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    df = make_docs(spark, [(i, " ".join(["w"] * (i % 37 + 1))) for i in range(600)])
    out = mixing.mix_sources(df).toPandas()
    per = out.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"))
    assert len(out) == 600 and (abs(per["taken"] - per["target"]) <= 37).all()


def test_vantage_tree_exact_at_factor_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:160] = x[99]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, []), (None, [1.0] * 8), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, k=20, factor=1.0, shard=150).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    d = x.astype(float)
    assert set(got) == set(range(0, 700, 20))
    for q, found in got.items():
        s = (d * d[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        assert [found[k][0] for k in range(1, 21)] == order
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_vantage_search_keeps_ties_and_doubles(spark):
    """64 unit vectors and more tie for each query; a column of doubles, of which some are beyond single precision."""
    rng = np.random.default_rng(4)
    x = np.zeros((420, 72))
    x[:, 0] = 1.0
    for i in range(420):
        x[i, 1 + i % 64] = 1.0
    x[0] = x[20] = 0.0
    x[0, 0] = x[20, 0] = 1.0
    x[300:] = rng.normal(size=(120, 72)) * 1e-9
    x[400:] *= 1e200
    df = spark.createDataFrame([(int(i), v.tolist(), 7, "s") for i, v in enumerate(x)], "vec_id long, embedding array<double>, id long, shard string")
    got = {}
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, k=20, factor=1.0, shard=130).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in range(0, 420, 20):
        s = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(420), -s)) if i != q][:20]
        assert [i for i, _ in got[q]] == order and [v for _, v in got[q]] == s[order].tolist(), q


def test_vantage_search_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = df.toPandas().sort_values("vec_id")
    x = np.stack(p["embedding"]).astype(float)
    got = vptree.nearest(df, F.col("vec_id") % 20 == 0).toPandas().groupby("query_id")["vec_id"].apply(set)
    hit = [len(got[q] & {i for i in np.argsort(-(x @ x[q]))[:21] if i != q}) / 20 for q in range(0, len(x), 20)]
    assert np.mean(hit) >= 0.9


def test_toxicity_and_quality_hold_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    y = {r["doc_id"]: r for r in labels.collect()}
    model = toxicity.fit_toxicity(docs, labels)
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0 and i in y
    tox = [(r["score"] >= 0.5, y[r["doc_id"]]["toxic"] == 1) for r in toxicity.score_toxicity(docs, model).collect() if held(r["doc_id"])]
    assert np.mean([a == b for a, b in tox]) > 0.95 and np.mean([a for a, b in tox if b]) > 0.85
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert len(scored) == docs.count()
    assert np.mean([(r["score"] >= 0.5) == (y[r["doc_id"]]["quality"] == 1) for r in scored if held(r["doc_id"])]) > 0.93


def test_levenshtein_walk_equals_distance():
    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, z in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != z)))
        return row[-1]

    rng, stems = random.Random(4), ["idiot", "trash", "scum", "vequ", "worthless"]
    trie, screen = toxicity.Trie(stems), toxicity.Screen(stems)
    for _ in range(3000):
        w = list(rng.choice(stems) + rng.choice(["", "s", "ing"]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = rng.choice(["", "x", "é", w[at]])
        word = "".join(w) or "a"
        best = min(min(far(word[:k], s) for k in range(len(word) + 1)) for s in stems if len(s) >= 5)
        exact = any(word.startswith(s) for s in stems)
        found = trie.matches(word)
        assert (found is not None) == (exact or best <= 1)
        if found:
            data = np.frombuffer(word.encode(), np.uint8)
            assert len(screen(data, np.array([0]), np.array([len(data)])))


def test_scores_of_odd_rows(spark):
    odd = make_docs(spark, [(1, None), (2, ""), (3, "12 34 !!"), (None, "you idiot"), (4, "you idiot"), (4, "you idiot"), (5, 'he said "you idiot" to her'), (6, "x" * 300_000)])
    labels = spark.createDataFrame([(100 + i, i % 2, i % 2) for i in range(400)], "doc_id long, toxic int, quality int")
    train = make_docs(spark, [(100 + i, ("you are an idiot and a clown %d" % i) if i % 2 else "a calm and quiet day number %d" % i) for i in range(400)])
    model = toxicity.fit_toxicity(train, labels)
    got = {}
    for r in toxicity.score_toxicity(odd, model).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert min(got[4]) > 0.5 and got[4][0] == got[4][1] == got[None][0] and got[5][0] < got[4][0]
    assert all(got[k][0] < 0.5 for k in (1, 2, 3, 6))
    none = toxicity.fit_toxicity(train, labels.limit(0))
    assert all(r["score"] < 1e-9 for r in toxicity.score_toxicity(odd, none).collect())
    assert {r["score"] for r in quality.score_quality(odd, quality.fit_quality(train, labels.limit(0))).collect()} == {0.5}
    assert quality.score_quality(odd, quality.fit_quality(train, labels)).count() == 8
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit_languages(docs)
    got = langid.predict_languages(docs, model).where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    assert got.where("lang_pred = lang").count() / got.count() > 0.98
    odd = {r["doc_id"]: r for r in langid.predict_languages(make_docs(spark, [(1, None), (2, ""), (3, "12 — 34"), (4, "the thing of it"), (5, "ß")]), model).collect()}
    assert [odd[k]["lang_pred"] == "und" for k in (1, 2, 3, 4, 5)] == [True, True, True, False, False] and odd[1]["score"] == 0 and odd[1]["ambiguous"]
    assert langid.predict_languages(make_docs(spark, []), model).count() == 0
    assert langid.predict_languages(make_docs(spark, [(1, "a")]), langid.fit_languages(make_docs(spark, []))).first()["lang_pred"] == "und"


def test_language_learns_from_a_row_s_own_language(spark):
    """Rows that share an id teach their own language each, those without one teach nothing, and the bound holds with repeats."""
    de, en = "der hund und die katze schlafen im haus %d", "the dog and the cat sleep in a house %d"
    rows = [(k % 7, (de if k % 2 else en) % (k // 2), "de" if k % 2 else "en") for k in range(300)] + [(k % 7, de % k, None) for k in range(300)]
    rows += [(1, en % 0, "en")] * 200 + [(None, de % 3, "en")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").where("doc_id is null or crc32(cast(doc_id as string)) % 4 <> 2")
    got = langid.predict_languages(df, langid.fit_languages(df)).where("text is not null").collect()
    assert all(r["lang_pred"] == ("de" if r["text"].startswith("der") else "en") for r in got)
    few = learning.one_row_each(df, df.where("doc_id is not null").select("doc_id").distinct(), ["text", "lang"])
    assert few.count() == df.where("doc_id is not null").select("doc_id").distinct().count()
    tie = langid.predict_languages(df.limit(3), {"langs": ["en"]}).collect()
    assert {r["lang_pred"] for r in tie} == {"en"}


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 12):
        c = langid.codewords(k)
        gaps = [(c[i] != c[j]).sum() for i in range(k) for j in range(i)]
        assert min(gaps) >= max(1, c.shape[1] // 4)


def test_decontamination(spark):
    item = "If Anna has 12 apples and gives Bruno 3 kg of pears how many apples does Anna have left after that"
    changed = item.replace("12", "75").replace("Anna", "Clara")
    wrong = item.replace("12", "75").replace("how many apples does Anna", "how many apples does Zoe")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, "too short")], "item_id long, text string")
    filler = " ".join(f"filler{i}" for i in range(50))
    rows = [(1, f"{filler} {item} {filler}"), (2, f"{filler}\n{changed}\n{filler}"), (3, filler), (4, None), (5, ""), (6, wrong), (None, item), (7, " ".join(item.split()[:9]))]
    rows += [(1, filler), (1, item), (None, filler), (8, f"{filler} {item} " + "long " * 60_000 + changed)]
    plain = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r["items"]), r["coverage"], r["longest_run"], r["reparameterised"], r["contaminated"]) for r in df.collect())
    got = plain(decontam.find_contamination(make_docs(spark, rows), bench))
    assert len(got) == len(rows) and {r[0] for r in got if r[5]} == {-1, 1, 2, 8}
    assert [r[5] for r in got if r[0] == 1] == [False, True, True] and [r[5] for r in got if r[0] == -1] == [False, True]
    assert all(r[1] == ((1,) if r[5] else ()) for r in got) and [r[4] for r in got if r[0] in (2, 8)] == [True, False]
    two = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, "too short"), (9, " ".join(f"filler{i}" for i in range(60, 90)))], "item_id long, text string")
    assert plain(decontam.find_contamination(make_docs(spark, rows), two, block=1)) == got
    odd = make_docs(spark, rows).withColumn("items", F.lit("x")).withColumn("contaminated", F.lit(3))
    kept = decontam.flag_contamination(odd, bench)
    assert set(kept.columns) == set(odd.columns) | {"coverage", "longest_run", "reparameterised"} and kept.where("contaminated and pg = 'p'").count() == 5
    assert decontam.find_contamination(make_docs(spark, []), bench).count() == 0
    assert decontam.find_contamination(make_docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def brute_contaminated(text, items, width=8, least=5, share=0.5, run=13):
    """Items whose words stand in the text, aligned, for the share or the run that counts: every alignment is tried."""
    strip = lambda w: w.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "%$")).lower()
    words, out = [strip(w) for w in text.split()], []
    for key, item in items.items():
        mine = [strip(w) for w in item.split()]
        size = min(width, len(mine))
        for d in range(-len(mine), len(words)) if size >= least else ():
            same = [0 <= d + k < len(words) and words[d + k] == mine[k] for k in range(len(mine))]
            on = sorted({k + j for k in range(len(mine) - size + 1) if all(same[k : k + size]) for j in range(size)})
            if len(on) / len(mine) >= share or decontam._longest(on) >= run:
                out.append(key)
                break
    return out


def test_decontamination_equals_brute_force_on_plain_passages(spark):
    """Lower-case words without numbers have no slots, so the operator comes down to alignments of equal words."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("abcdefghijklm") + rng.choice("nopqrstuvwxyz") for _ in range(n))
    items = {k: say(n) for k, n in enumerate([3, 4, 5, 6, 8, 9, 12, 20, 30, 45, 60])}
    rows = []
    for k in range(120):
        words, item = say(rng.randrange(0, 60)).split(), items[rng.randrange(11)].split()
        a = rng.randrange(len(item))
        piece = item[a : a + rng.randrange(1, len(item) + 1)]
        if rng.random() < 0.3 and piece:
            piece[rng.randrange(len(piece))] = "zz"
        at = rng.randrange(len(words) + 1)
        rows.append((k, " ".join(words[:at] + piece + words[at:])))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for block in (decontam.BLOCK_ITEMS, 4):
        got = {r["doc_id"]: r["items"] for r in decontam.find_contamination(make_docs(spark, rows), bench, block=block).collect()}
        assert got == {k: brute_contaminated(t, items) for k, t in rows}


def test_decontamination_finds_exact_copies(spark):
    """Items of placeholders mostly, and short ones behind a word that ends no sentence."""
    items = {1: "The Quick Brown Fox Jumps Over The Lazy Dog Near River Banks", 2: "FIND THE AREA OF THE LARGE SQUARE BELOW", 3: "Paris 12 km Rome 30 km Berlin 7 kg Madrid 5 kg", 4: "What is the capital of France", 5: "Why do cats always land on feet"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    filler = " ".join(f"filler{i}" for i in range(30))
    rows = [(1, f"{filler} {items[1]} {filler}"), (2, f"{filler}\n{items[2]}\n{filler}"), (3, f"{filler} {items[3]}. {filler}"), (4, f"{filler} Q1) {items[4]}? {filler}"), (5, f"{filler} so, {items[5]}? {filler}"), (6, f"{filler} Rome 12 km Oslo 30 km Bonn 7 kg Wien 5 kg {filler}"), (7, f"{filler} Q1) What is the capital of Spain {filler}")]
    for block in (decontam.BLOCK_ITEMS, 2):
        got = {r["doc_id"]: r for r in decontam.find_contamination(make_docs(spark, rows), bench, block=block).collect()}
        assert all(got[k]["items"] == [k] and got[k]["coverage"] == 1 and not got[k]["reparameterised"] for k in items)
        assert not got[6]["contaminated"]
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    bench = spark.createDataFrame([(1, f"at 12 {long} and 12 again")], "item_id long, text string")
    rows = [(1, f"{filler} at 12 {long} and 13 again {filler}"), (2, f"{filler} at 12 {' '.join(long.split()[:10])} {filler}")]
    got = {r["doc_id"]: r["contaminated"] for r in decontam.find_contamination(make_docs(spark, rows), bench).collect()}
    assert got == {1: True, 2: False}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (5, 5), (None, 4), (20, 21)] + [(100 + i, 101 + i) for i in range(300)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in components(df, Workspace(spark, "t")).collect()}
    assert all(got[k] == 1 for k in (1, 2, 3, 9)) and got[21] == 20 and 5 not in got and 4 not in got
    assert {got[k] for k in range(100, 401)} == {100}
    assert components(df.limit(0), Workspace(spark, "t")).count() == 0


def test_word_hashes_do_not_depend_on_place():
    text = "Alpha béta\tgamma\n\x0balpha " + "z" * (3 * hashing.PIECE) + " gamma"
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, rows = hashing.bounds(data, np.array([0, len(data)]))
    h = hashing.word_hashes(data, s, e, lower=True)
    words = text.encode().split()
    assert len(h) == len(words) == rows[1] and h[0] == h[3] and h[2] == h[-1] and len(set(h.tolist())) == 4
    for n in (2, 3, 5):
        g = hashing.grams(np.concatenate([h, h]), n)
        assert g[0] == g[len(h)] and len(g) == 2 * len(h) - n + 1


def test_pipeline_stages(spark):
    """Each stage on its predecessor's rows, against brute force."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "source_mixing"]
    docs, rows, work = spark.read.parquet(f"{SF}/documents.parquet"), [], Workspace(spark, "stages")
    for name, stage in corpus_pipeline.STAGES:
        docs = work.keep(stage(spark, docs, SF), name)
        rows.append({r["doc_id"]: r for r in docs.collect()})
    languages, lines, near, clean, mixed = rows
    assert set(languages) == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} and docs.count() == len(mixed)
    assert set(lines) == set(languages) and sum(len(r["text"]) for r in lines.values()) < sum(len(r["text"]) for r in languages.values())
    assert set(near) == {i for i, (_, c) in brute_components([(i, r["text"]) for i, r in lines.items()]).items() if c == i}
    items = [r["text"].split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i, r in near.items() if any(" ".join(x) in " ".join(r["text"].split()) for x in items)}
    assert whole <= set(near) - set(clean) and len(set(near) - set(clean)) <= len(whole) + 0.02 * len(near)
    assert set(mixed) == set(clean) and all(r["size"] == len(clean[i]["text"].encode().split()) for i, r in mixed.items())
    assert {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, SF).collect()} == {i: r["taken"] for i, r in mixed.items()}


def test_quotation_is_read_from_the_whole_line():
    import pyarrow as pa

    far = 'they "' + "so " * 400 + "idiot "
    texts = [far + '" end', "first \" line\nidiot", "a “b” idiot", "«" + "x " * 300 + "idiot", "idiot", None]
    part = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    trie, screen = toxicity.Trie(["idiot"]), toxicity.Screen(["idiot"])
    _, hits = toxicity.hit_features(part, trie, screen, frozenset(), {"idiot": 1.0}, {})
    assert [[h[3] for h in row] for row in hits] == [[True], [False], [False], [True], [False], []]


def test_substring_windows_known_only_here_are_counted(spark, monkeypatch):
    """A passage shorter than a window at home, longer elsewhere: windows over its edge are settled by the exact count."""
    rng = random.Random(12)
    say = lambda n, a: [f"{a}{rng.randrange(10**6)}" for _ in range(n)]
    for trial in range(3):
        p = say(26, "p")
        rows = [(1, " ".join(say(9, "h") + p + say(9, "h")))]
        rows += [(2 + k, " ".join(say(7, "e") + ["x"] + p + say(7, "f"))) for k in range(4)]
        rows += [(9, rows[2][1]), (10, " ".join(p[:21] + p[:21] + ["x"] + p))]
        for shard in (6000, 1):
            monkeypatch.setattr(substring, "SHARD_ANCHORS", shard)
            got = substring.remove_repeats(make_docs(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
            assert {r[0]: tuple(r[1:]) for r in got} == brute_cut(rows)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty, unlabelled, very long and clashing input through all stages."""
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, None), (3, ""), (4, "a b c d e f g"), (None, "one two three"), (5, "12 34"), (4, "a b c d e f g")]
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, df, ids in (("empty", make_docs(spark, []), []), ("unlabelled", make_docs(spark, rows).withColumn("lang", F.lit(None).cast("string")), [-1, 1, 2, 3, 4, 5]), ("labelled", make_docs(spark, rows), [-1, 1, 4])):
        docs, work = df, Workspace(spark, name)
        for stage, f in corpus_pipeline.STAGES:
            docs = work.keep(f(spark, docs, str(tmp_path)), stage)
            if stage != "source_mixing":
                assert docs.columns == corpus_pipeline.COLUMNS
        assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in docs.collect()) == ids, name


def test_pipeline_near_duplicates_odd_rows(spark):
    import corpus_pipeline

    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (3, None), (4, "")]
    got = corpus_pipeline.near_duplicates(spark, make_docs(spark, rows), SF)
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got.collect()) == [-1, 1, 3, 4]


def test_components_do_not_depend_on_the_task_limit(spark, monkeypatch):
    from strandline.llm import components as c

    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    found = []
    for limit in (c.ONE_TASK, 0):
        monkeypatch.setattr(c, "ONE_TASK", limit)
        found.append(sorted(tuple(r) for r in components(df, Workspace(spark, "limit")).collect()))
    assert found[0] == found[1] and len({n for n, _ in found[0]}) == len(found[0])


def test_ngram_join_lists_a_copy_once_and_passes_agree(spark, monkeypatch):
    rng = random.Random(5)
    common = [f"c{k}" for k in range(30)]
    texts = [" ".join([*common, *(f"w{rng.randrange(6)}" for _ in range(3))]) for _ in range(25)]
    rows = [(copy * 100 + k, t) for copy in range(8) for k, t in enumerate(texts)]
    seen, plain = [], ngramjoin.connect
    monkeypatch.setattr(ngramjoin, "connect", lambda index, *a, **b: (seen.append(index), plain(index, *a, **b))[1])
    for name, value in (("HEAVY", 2), ("ABOVE_MEAN", 0), ("SHORT", 3), ("PASS_TOKENS", 400)):
        monkeypatch.setattr(ngramjoin, name, value)
    got = {r[0]: (r[1], r[2]) for r in ngramjoin.jaccard_components(make_docs(spark, rows).repartition(8)).collect()}
    assert got == brute_components(rows)
    assert seen[0].count() == seen[0].distinct().count() > 0
