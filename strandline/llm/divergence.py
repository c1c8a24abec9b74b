"""Source divergence audit by systolic rotation.

Within a language, every source's smoothed distribution over the language's kept terms is compared with that of each other source,
and with the language's own.  The kept terms of a language are dealt to blocks of about ``BLOCK`` by hash; the counts of ``SEAT``
sources over one block are a bundle, packed as deltas and squeezed.  Bundles stay in their partition (dealt once by language,
block and seat, and held there) while the packed bundles of peers travel: in each round of a round-robin tournament every seat meets
one other, the lower numbered of the two at home, and a meeting writes both directions of all its pairs of sources.  ``ROUNDS``
rounds make one pass, whose partial sums are written before the next begins, so that what travels at a time is bounded by ``ROUNDS``
/ 2 times the packed counts however many sources there are.  A source's own terms above the language's share are ranked by a heap of
``top`` in each bundle; only heaps' contents are ranked globally.

All arithmetic is in integers: p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), by three steps of long division so that nothing
overflows below 9 * 10**15 words.

Defined results: null text, lang and source are ''.  A document's terms are maximal runs of characters but ASCII non-letters, with A-Z
lower-cased; each row is a document of its own, repeated ids and texts included.  Texts are worked through in pieces, whatever their
length.  A group without terms takes part with counts of 0; a language without kept terms has pairs of value 0 and no terms; a
language with one source has no pairs.  Empty tables give empty results; columns but the three named are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.storage import Workspace

#: Terms of a block, sources of a seat, rounds of a pass.
BLOCK, SEAT, ROUNDS = 32_768, 4, 8
#: Distinct terms that a task holds before it hands its counts on, and bytes of a text worked through at once.
HELD, PIECE = 200_000, 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(text: memoryview) -> Counter:
    """Terms of a UTF-8 text and how often each occurs."""
    found, at = Counter(), 0
    while at < len(text):
        piece = bytes(text[at : at + PIECE]).translate(_FOLD)
        end = len(piece) if at + PIECE >= len(text) else piece.rfind(b" ") + 1
        if not end:  # one term that is longer than a piece
            end = next((k for k in range(at + PIECE, len(text)) if _FOLD[text[k]] == 32), len(text)) - at
            piece = bytes(text[at : at + end]).translate(_FOLD)
        found.update(piece[:end].split())
        at += end
    return found


def _partials(batches):
    """lang, source, term, n, df: a task's counts; a null term marks a group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out():
        for (lang, source), (n, df) in held.items():
            terms = list(n)
            for k in range(0, len(terms) + 1, 20_000):
                part = terms[k : k + 20_000]
                names = pa.array([*part, None], pa.binary()).cast(pa.string())
                rows = len(part) + 1
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * rows, pa.string()), "source": pa.array([source] * rows, pa.string()), "term": names, "n": pa.array([*(n[t] for t in part), 0], pa.int64()), "df": pa.array([*(df[t] for t in part), 0], pa.int64())})
        held.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
            counts = term_counts(memoryview(text.as_buffer()) if text.is_valid else memoryview(b""))
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(counts)
            df.update(counts.keys())
            size += len(n)
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def _pack(values: np.ndarray) -> bytes:
    """Signed integers of small size, squeezed."""
    return zlib.compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 5) / (total + 5 * terms)), exactly."""
    whole = total + 5 * terms
    rest, out = counts + 5, np.zeros(len(counts), np.int64)
    for _ in range(3):
        out, rest = out * 1_000 + rest * 1_000 // whole, rest * 1_000 % whole
    return out + 1


BUNDLE = "lang string, block int, seat int, size long, terms long, sources array<string>, totals array<long>, idx array<binary>, counts array<binary>, lang_total long, lang_counts array<binary>"


def _bundle(table: pa.Table) -> pa.Table:
    """The rows of one language, block and seat as one row; a row without idx states a source's totals."""
    head = table.filter(pc.is_null(table.column("idx"))).sort_by("source").to_pylist()
    body = table.filter(pc.is_valid(table.column("idx"))).sort_by([("source", "ascending"), ("idx", "ascending")])
    names = np.array(body.column("source").to_pylist(), object)
    idx, n, of_lang = (body.column(c).to_numpy() for c in ("idx", "n", "lang_n"))
    parts = [np.flatnonzero(names == h["source"]) for h in head]
    packed = lambda v: [_pack(np.asarray(x, np.int64)) for x in v]
    one = {"lang": head[0]["lang"], "block": head[0]["block"], "seat": head[0]["seat"], "size": head[0]["size"], "terms": head[0]["terms"], "sources": [h["source"] for h in head], "totals": [h["n"] for h in head]}
    one |= {"idx": packed(np.diff(idx[p], prepend=0) for p in parts), "counts": packed(n[p] for p in parts), "lang_total": head[0]["lang_n"], "lang_counts": packed(of_lang[p] for p in parts)}
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.int64(), pa.list_(pa.binary())]
    return pa.table({k: pa.array([v], t) for (k, v), t in zip(one.items(), kinds, strict=True)})


def _dense(size: int, terms: int, total: int, idx: bytes, counts: bytes) -> np.ndarray:
    full = np.zeros(size, np.int64)
    full[np.cumsum(_unpack(idx))] = _unpack(counts)
    return shares(full, total, terms) if size else full


def _meet(batches):
    """Both directions of each pair of sources of a meeting; a bundle without a visitor meets itself."""
    for b in batches:
        for r in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
            at_home = [_dense(r["size"], r["terms"], *x) for x in zip(r["totals"], r["idx"], r["counts"], strict=True)]
            if r["v_sources"] is None:
                pairs = [(x, y, at_home[i], at_home[j]) for i, x in enumerate(r["sources"]) for j, y in enumerate(r["sources"][:i])]
            else:
                guests = [_dense(r["size"], r["terms"], *x) for x in zip(r["v_totals"], r["v_idx"], r["v_counts"], strict=True)]
                pairs = [(x, y, at_home[i], guests[j]) for i, x in enumerate(r["sources"]) for j, y in enumerate(r["v_sources"])]
            found = [(x, y, int(np.abs(p - q).sum())) for x, y, p, q in pairs]
            found += [(y, x, v) for x, y, v in found]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([r["lang"]] * len(found), pa.string()), "source": pa.array(cols[0], pa.string()), "item": pa.array(cols[1], pa.string()), "value": pa.array(cols[2], pa.int64())})


def _heaps(top: int):
    def heaps(batches):
        for b in batches:
            for r in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                for source, total, idx, counts, of_lang in zip(r["sources"], r["totals"], r["idx"], r["counts"], r["lang_counts"], strict=True):
                    at, n, q = np.cumsum(_unpack(idx)), _unpack(counts), _unpack(of_lang)
                    if not len(at):
                        continue
                    above = shares(n, total, r["terms"]) - shares(q, r["lang_total"], r["terms"])
                    best = heapq.nsmallest(top, ((-int(above[k]), int(at[k])) for k in np.flatnonzero((n > 0) & (above > 0))))
                    if best:
                        rows = len(best)
                        yield pa.RecordBatch.from_pydict({"lang": pa.array([r["lang"]] * rows, pa.string()), "source": pa.array([source] * rows, pa.string()), "block": pa.array([r["block"]] * rows, pa.int32()), "idx": pa.array([k for _, k in best], pa.int32()), "value": pa.array([-v for v, _ in best], pa.int64())})

    return heaps


def partner(seat: str, seats: str, turn: str):
    """Who a seat meets in a round of the tournament of an even number of seats: turn from 0 to seats - 2 (circle method)."""
    odd = f"({seats} - 1)"
    across = f"pmod({turn} - {seat}, {odd})"
    middle = f"cast(pmod({turn} * ({seats} div 2), {odd}) as int)"  # the one that would meet itself: twice it is the turn
    return F.expr(f"cast(case when {seat} = {odd} then {middle} when {across} = {seat} then {odd} else {across} end as int)")


def _bundles(docs: DataFrame, least_docs: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(_partials, "lang string, source string, term string, n long, df long")
    found = work.keep(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    kept = found.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= least_docs)
    kept = work.keep(kept.select("lang", "term", "lang_n"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    langs = found.where("term is null").select("lang").distinct().join(langs, "lang", "left").select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    langs = work.keep(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK)).cast("int")), "langs")
    placed = kept.join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    placed = work.keep(placed.select("lang", "block", "term", "lang_n", (F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).alias("idx")), "placed")
    counts = work.keep(found.where("term is not null").select("lang", "term", "source", "n").join(placed, ["lang", "term"]), "placed-counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    seats = found.where("term is null").select("lang", "source").withColumn("seat", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / SEAT).cast("int"))
    seats = work.keep(seats.join(totals, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", "seat", F.coalesce("n", F.lit(0)).alias("n"), "terms", "lang_total", "blocks"), "seats")
    sizes = placed.groupBy("lang", "block").agg(F.count("*").alias("size"))
    heads = seats.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sizes, ["lang", "block"], "left")
    heads = heads.select("lang", "block", "seat", "source", F.lit(None).cast("int").alias("idx"), "n", F.col("lang_total").alias("lang_n"), F.coalesce("size", F.lit(0)).alias("size"), "terms")
    nothing = F.lit(None).cast("long")
    body = counts.join(seats.select("lang", "source", "seat"), ["lang", "source"]).select("lang", "block", "seat", "source", F.col("idx").cast("int").alias("idx"), "n", "lang_n", nothing.alias("size"), nothing.alias("terms"))
    return work.keep(heads.union(body).groupBy("lang", "block", "seat").applyInArrow(_bundle, BUNDLE), "bundles"), placed


def audit_sources(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of docs(text, lang, source)."""
    work = Workspace(docs.sparkSession, "audit")
    bundles, placed = _bundles(docs, least_docs, work)
    key = ["lang", "block", "seat"]
    home = bundles.drop("lang_total", "lang_counts")
    resident = home.repartition(*key).persist(StorageLevel.MEMORY_AND_DISK)
    most = bundles.groupBy("lang").agg((F.max("seat") + 1).alias("n")).withColumn("n", (F.col("n") + F.col("n") % 2).cast("int"))  # an odd one out rests
    most = work.keep(most, "tournament")
    rounds = (most.agg(F.max("n")).first()[0] or 1) - 1
    meeting = "lang string, source string, item string, value long"
    empty = [F.lit(None).cast(t).alias(f"v_{c}") for c, t in (("sources", "array<string>"), ("totals", "array<long>"), ("idx", "array<binary>"), ("counts", "array<binary>"))]
    sums = work.keep(resident.select("*", *empty).mapInArrow(_meet, meeting).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pass-home")
    for k, first in enumerate(range(0, rounds, ROUNDS)):
        travel = home.join(most, "lang").withColumn("turn", F.explode(F.sequence(F.lit(first), F.lit(min(first + ROUNDS, rounds) - 1)))).where("turn < n - 1")
        travel = travel.withColumn("to", partner("seat", "n", "turn")).where("to < seat")
        travel = travel.select("lang", "block", F.col("to").alias("seat"), *[F.col(c).alias(f"v_{c}") for c in ("sources", "totals", "idx", "counts")])
        met = resident.join(travel.hint("shuffle_hash"), key).mapInArrow(_meet, meeting)
        sums = sums.union(work.keep(met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), f"pass-{k}"))
    resident.unpersist()
    # A pair of sources meets once, so each pass states its pairs whole
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(first).alias("rank"))
    heaps = bundles.mapInArrow(_heaps(top), "lang string, source string, block int, idx int, value long")
    terms = heaps.join(placed.select("lang", "block", "idx", F.col("term").alias("item")), ["lang", "block", "idx"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(first).alias("rank")).where(F.col("rank") <= top)
    return pairs.union(terms)
