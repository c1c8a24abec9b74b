"""Similarity join of documents on word shingles by a grouped prefix join.

Documents are sets of distinct five-word shingles, kept as 64-bit hashes.  Two sets can only reach the threshold if
their prefixes share a shingle, when all are sorted by one global order: by the count of a fixed-size sketch, then by
hash, so that heavy shingles come last.  Any order gives the same result; a sketch that fills up keeps heavy shingles apart
from the rest and leaves rare ones in the order of their hashes.

Documents with identical prefix and size form one group; posting lists are over groups.  Pairs of groups are filtered
before any set is looked at: those of short lists by a positional bound on the overlap, those of long ones by a bound on the
symmetric difference, the differing bits of two parity bitmaps.  Groups that a chain of passing pairs connects are a
cluster.  Clusters are expanded to their members, one for each set, and verified exactly.

Long lists and large clusters are worked through in blocks (``connect``): each block is connected by itself, then members
of one part of each connected component meet, and at last only what still lies outside a cell's largest component visits all
its blocks.  Only links that join separate parts are written, never all pairs, and no group lands in one task.

Defined results: null text, or text without words: size 0, no links, own component.  Repeated rows and equal sets: same
component; rows that share an id and differ in text are documents of their own.  A row whose id is null keeps its size and
gets a null component.  Very long texts are hashed whole, slice by slice.  An empty table gives an empty result.  Columns
other than the id and the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm import hashing
from strandline.llm.components import components
from strandline.llm.storage import Workspace

#: Slots of the sketch of repeated shingles: 2**21, so that a broadcast of it is 4 MB whatever the input.
SKETCH_BITS = 21
#: Bits of the filter over candidate ids: 2**24, so 2 MB.
FILTER_BITS = 24
#: A block of a candidate cluster holds about so many shingles and documents; one of a long posting list, so many groups.
BLOCK_SHINGLES, BLOCK_DOCS, BLOCK_GROUPS = 200_000, 192, 1_024
#: Posting lists of at most so many groups give pairs, bound by position; longer ones are compared by bitmaps.
SHORT = 16
#: Bits of a set's parity bitmap.
PARITY = 512
#: A shingle is heavy from this many repeats on, and from this many times the mean of a slot; its list goes without counting.
HEAVY, ABOVE_MEAN = 16, 4
#: Cells of more than one block are broadcast up to this many; beyond, they are joined by shuffling.
FEW = 100_000
#: Prefix tokens whose lists are made at once, about 24 bytes of shuffle each; more are gone through in several passes.
PASS_TOKENS = 64_000_000


def shingle_sets(batch: pa.RecordBatch, n: int, column: str = "text") -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    data, offsets = hashing.raw(batch.column(batch.schema.get_field_index(column)))
    starts, ends, rows = hashing.bounds(data, offsets)
    words = hashing.word_hashes(data, starts, ends, lower=True)
    full = hashing.grams(words, n)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(full[a : b - n + 1])
        elif b > a:
            yield hashing.mix(hashing.grams(words[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _repeats(n: int, limit: int = 1_500_000):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, totals = [], 0, np.zeros(1 << SKETCH_BITS, np.int32)

        def settle() -> None:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            again = c > 1
            np.add.at(totals, (h[again] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), c[again].astype(np.int32))

        for batch in batches:
            for part in hashing.slices(batch):
                for s in shingle_sets(part, n):
                    held.append(s)
                    count += len(s)
                if count >= limit:
                    settle()
                    held, count = [], 0
        if held:
            settle()
        slots = np.flatnonzero(totals)
        for at in range(0, len(slots), 200_000):
            some = slots[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some].astype(np.int64))], ["slot", "n"])

    return task


def _prefixes(n: int, percent: int, sketch, heavy: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen_groups = sketch.value, set()
        for batch in batches:
            for part in hashing.slices(batch):
                sizes, one, two, groups, rare, common, last, low = [], [], [], [], [], [], [], []
                valid = part.column(0).is_valid().to_pylist()
                for ok, s in zip(valid, shingle_sets(part, n), strict=True):
                    size = len(s)
                    p = size + percent * -size // 100 + 1 if size else 0
                    seen = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    head, c = s[seen == 0][:p], np.zeros(0, np.uint16)
                    if len(head) < p:
                        rest, c = s[seen > 0], seen[seen > 0]
                        order = np.argsort(c, kind="stable")[: p - len(head)]
                        head, c = np.concatenate([head, rest[order]]), c[order]
                    sizes.append(size)
                    mixed = hashing.mix(s + np.uint64(size))
                    one.append(int(mixed.sum(dtype=np.uint64)))
                    two.append(int(np.bitwise_xor.reduce(hashing.mix(mixed + np.uint64(77)))) if size else 0)
                    last.append((int(c[-1]) if len(c) else 0, int(head[-1]) - 2**63) if size else (0, 0))
                    groups.append(int(hashing.mix(np.array([int(hashing.mix(head + np.arange(len(head), dtype=np.uint64)).sum(dtype=np.uint64)) ^ size], np.uint64))[0]))
                    low.append((s & np.uint64(PARITY - 1)).astype(np.int64))
                    if not ok or (groups[-1], one[-1], two[-1]) in seen_groups:  # a set's tokens once for each task
                        head, c = head[:0], c[:0]
                    elif size:
                        seen_groups.add((groups[-1], one[-1], two[-1]))
                    cut = len(head) - int((c >= heavy).sum())
                    rare.append(head[:cut])
                    common.append(head[cut:])
                as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                joined = lambda x: hashing.lists(hashing.signed(np.concatenate(x)), [len(y) for y in x])
                bits = np.bincount(np.repeat(np.arange(len(low)) * PARITY, sizes) + np.concatenate(low), minlength=len(low) * PARITY) & 1
                parity = np.packbits(bits.astype(np.uint8).reshape(len(low), PARITY), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(np.array(sizes, np.int64)), as_long(one), as_long(two), as_long(groups), pa.array([x for x, _ in last], pa.int64()), pa.array([x for _, x in last], pa.int64()), joined(rare), joined(common), pa.array([x.tobytes() for x in parity], pa.binary())],
                    ["doc_id", "n", "s1", "s2", "pg", "last_count", "last_hash", "rare", "common", "parity"],
                )

    return task


def _bits(batches):
    """Words of the filter that a task's ids set."""
    import pandas as pd

    words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for pdf in batches:
        at = id_slots(pdf["doc_id"].to_numpy(np.int64))
        np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    some = np.flatnonzero(words)
    yield pd.DataFrame({"at": some.astype(np.int32), "bits": words[some].view(np.int64)})


def id_slots(ids: np.ndarray) -> np.ndarray:
    return (hashing.mix(ids.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(spark: SparkSession, ids: DataFrame):
    """A broadcast filter of fixed size that passes at least the given ids (column doc_id)."""
    words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    found = ids.where("doc_id is not null").mapInPandas(_bits, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(words)


def passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = id_slots(ids)
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def only_ids(docs: DataFrame, keep, inverse: bool = False) -> DataFrame:
    """The documents (doc_id, text) whose id the filter passes, or those whose id it doesn't; null ids never pass."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            on = passes(keep.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~on if inverse else on))

    return docs.mapInArrow(task, docs.schema)


def overlaps(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets reach the threshold, by multiplying rows of a shingle table, slice by slice of its columns."""
    both = left if right is left else left + right
    start = 0 if right is left else len(left)
    sizes = np.array([len(s) for s in both], np.int64)
    inverse = np.unique(np.concatenate(both), return_inverse=True)[1]
    kept = np.bincount(inverse)
    column = np.cumsum(kept > 1) - 1
    use = kept[inverse] > 1
    row, inverse = np.repeat(np.arange(len(both)), sizes)[use], column[inverse[use]]
    order = np.argsort(inverse, kind="stable")
    row, inverse = row[order], inverse[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    width = 8192
    for lo in range(0, int(inverse[-1]) + 1 if len(inverse) else 0, width):
        a, b = np.searchsorted(inverse, [lo, lo + width])
        hit = np.zeros((len(both), width), np.float32)
        hit[row[a:b], inverse[a:b] - lo] = 1
        shared += hit[: len(left)] @ hit[start:].T
    union = sizes[: len(left), None] + sizes[start:][None, :] - shared
    return (100 * shared.astype(np.int64) >= percent * union.astype(np.int64)) & (shared > 0)


def near(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of bitmaps (the last word is the set's size) can reach the threshold: no more bits differ than shingles."""
    a, b = np.array(left, np.uint64), np.array(right, np.uint64)
    total = a[:, -1].astype(np.int64)[:, None] + b[:, -1].astype(np.int64)[None, :]
    room = total + 2 * (-total * percent // (100 + percent))
    return np.bitwise_count(a[:, None, :-1] ^ b[None, :, :-1]).sum(2, dtype=np.int64) <= room


def spanned(items: list[np.ndarray], passes, percent: int, tile: int = 512) -> np.ndarray:
    """The part of each item (its smallest number) when pairs that pass are connected; pairs of one part aren't compared."""
    part = np.arange(len(items))

    def merge(rows: np.ndarray, columns: np.ndarray, hits: np.ndarray) -> None:
        for i in np.flatnonzero(hits.any(1)).tolist():
            found = np.unique(np.append(part[columns[hits[i]]], part[rows[i]]))
            if len(found) > 1:
                part[np.isin(part, found)] = found[0]

    for _ in range(8 if len(items) > tile else 0):  # a few stars connect most of a large group
        lone = np.flatnonzero(np.bincount(part, minlength=len(part))[part] == 1)
        if len(lone) < 2:
            break
        merge(lone[:1], lone[1:], np.hstack([passes(items[lone[0] : lone[0] + 1], [items[i] for i in lone[k : k + 8 * tile]], percent) for k in range(1, len(lone), 8 * tile)]))
        if part[lone[0]] == lone[0] and (part == lone[0]).sum() == 1:
            break
    order = np.argsort(part, kind="stable")
    cuts = [order[k : k + tile] for k in range(0, len(order), tile)]
    for x, rows in enumerate(cuts):
        for columns in cuts[x:]:
            if part[rows].min() == part[rows].max() == part[columns].min() == part[columns].max():
                continue
            left = [items[i] for i in rows]
            merge(rows, columns, passes(left, left if columns is rows else [items[i] for i in columns], percent))
    return part


def _blocks(visits: bool, passes, percent: int, load, most: int):
    """Rows by cell and block, those at home first: connects each block, or its visitors to what is at home there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home, guests, out = None, ([], [], []), ([], [], []), ([], [])

        def settle() -> None:
            if not visits and len(home[0]) > 1:
                part = spanned(home[2], passes, percent)
                on = np.flatnonzero(part != np.arange(len(part)))
                out[0].extend(home[0][i] for i in part[on])
                out[1].extend(home[0][i] for i in on)
            if guests[0] and home[0]:
                other = np.array(guests[1])[:, None] != np.array(home[1])[None, :]
                hits = passes(guests[2], home[2], percent) & other if other.any() else other
                for i in np.flatnonzero(hits.any(1)).tolist():
                    at = np.flatnonzero(hits[i])
                    parts = dict(zip((home[1][j] for j in at), at.tolist(), strict=True))
                    out[0].extend(home[0][j] for j in parts.values())
                    out[1].extend([guests[0][i]] * len(parts))
            for x in guests:
                x.clear()

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            kinds, nodes, comps = (batch.column(i).to_pylist() for i in (3, 4, 5))
            for k, item in enumerate(load(batch)):
                if keys[k] != now:
                    settle()
                    now = keys[k]
                    for x in home:
                        x.clear()
                for x, v in zip(guests if kinds[k] else home, (nodes[k], comps[k], item), strict=True):
                    x.append(v)
                if len(guests[0]) >= most:
                    settle()
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
                out = ([], [])
        settle()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return task


def connect(index: DataFrame, attach, passes, percent: int, load, work: Workspace, label: str, most: int, most_n: int | None = None) -> DataFrame:
    """Links (a, b) that connect, in every cell (k1, k2) of index(k1, k2, node, n), what passing pairs connect.

    A cell is dealt to blocks of about ``most`` nodes (and ``most_n`` of n), and each block is connected by itself.  Of a cell
    of several blocks, one node of each component then is compared with those of the other blocks; after that, nodes outside
    the cell's largest component visit all its blocks.  So every pair of different components has been compared, and a cell
    that is one component has been read once.  ``attach`` adds the column payload, from which ``load`` makes items.
    """
    kind = "a long, b long"
    deal = lambda rows: attach(rows).select("k1", "k2", "block", "kind", "node", "comp", "payload").repartition("k1", "k2", "block").sortWithinPartitions("k1", "k2", "block", "kind", "node")
    run = lambda rows, visits: deal(rows).mapInArrow(_blocks(visits, passes, percent, load, most), kind)
    small = lambda df, n: F.broadcast(df) if n <= FEW else df
    size = F.ceil(F.count("*") / most)
    if most_n:
        size = F.greatest(size, F.ceil(F.sum("n") / most_n))
    hot = work.keep(index.groupBy("k1", "k2").agg(size.cast("int").alias("parts")).where("parts > 1"), f"{label}-hot")
    n_hot = hot.count()
    block = F.expr("cast(pmod(xxhash64(node, k1, k2), parts) as int)")
    dealt = index.join(small(hot, n_hot), ["k1", "k2"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("block", block)
    first = work.keep(run(dealt.withColumn("kind", F.lit(0)).withColumn("comp", F.col("node")), False), f"{label}-1")
    if not n_hot:
        return first

    inside = work.keep(index.join(small(hot, n_hot), ["k1", "k2"]).withColumn("block", block), f"{label}-inside")

    def placed(links: DataFrame, name: str) -> DataFrame:
        found = components(links, work, f"{label}-{name}")
        return work.keep(inside.join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"), f"{label}-{name}-placed")

    heads = placed(first, "a").groupBy("k1", "k2", "comp").agg(F.min_by(F.struct(*[c for c in index.columns if c not in ("k1", "k2")]), "node").alias("x"))
    heads = heads.select("k1", "k2", "comp", "x.*")
    again = heads.groupBy("k1", "k2").agg(size.cast("int").alias("parts"))
    heads = heads.join(small(again, n_hot), ["k1", "k2"]).withColumn("block", block).withColumn("kind", F.lit(0))
    links = first.union(work.keep(run(heads, False), f"{label}-2"))

    at = placed(links, "b")
    largest = at.groupBy("k1", "k2", "comp").agg(F.count("*").alias("m")).groupBy("k1", "k2").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    open_ = at.join(small(largest, n_hot), ["k1", "k2"])
    home = open_.withColumn("kind", F.lit(0))
    guests = open_.where("comp <> main").withColumn("block", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("kind", F.lit(1))
    return links.union(work.keep(run(home.unionByName(guests), True), f"{label}-3"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; see the module's text for method and defined results."""
    spark = docs.sparkSession
    work = Workspace(spark, "ngramjoin")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = np.zeros(1 << SKETCH_BITS, np.uint16)
    seen = docs.mapInArrow(_repeats(n), "slot int, n long").groupBy("slot").agg(F.least(F.sum("n"), F.lit(65_535)).cast("int").alias("n")).toArrow()
    counts[seen["slot"].to_numpy()] = seen["n"].to_numpy()
    sketch = spark.sparkContext.broadcast(counts)
    heavy = max(HEAVY, math.ceil(ABOVE_MEAN * float(counts.mean())))
    del seen
    work.release()

    base = work.keep(docs.mapInArrow(_prefixes(n, percent, sketch, heavy), "doc_id long, n long, s1 long, s2 long, pg long, last_count long, last_hash long, rare array<long>, common array<long>, parity binary"), "sets")
    some = base.where("n > 0 and doc_id is not null")
    met = components(_filtered_pairs(some, percent, work), work, "groups")

    # One representative of each set; clusters of one representative need no check.
    sets = some.groupBy("s1", "s2", "n", "pg").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    sets = sets.join(met.select(F.col("node").alias("pg"), "component"), "pg", "left").select("doc_id", "n", "s1", "s2", "copies", F.coalesce("component", "pg").alias("cluster"))
    sets = work.keep(sets, "reps")
    links = _verified(docs, sets, n, percent, work)
    joined = components(links, work, "docs").withColumnRenamed("node", "doc_id")
    found = work.keep(sets.join(joined, "doc_id", "left").select("s1", "s2", "n", "copies", F.coalesce("component", "doc_id").alias("component_id")), "found")
    return _spread(base, found)


def _classes(percent: int) -> Column:
    """The size classes in which a set of n shingles can meet all it can link to: its own and the next."""
    own = F.floor(F.log("n") / F.log(F.lit(100.0 / percent + 1e-4)))
    return F.array(own, own + 1)


def _filtered_pairs(some: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """Pairs of groups (a, b) whose connection holds that of all groups that can hold linked sets."""
    far = F.lit(100.0 / percent + 1e-4)
    by_size = Window.partitionBy("token").orderBy("n", "pg")
    pair = F.struct(F.col("pg").alias("a"), F.col("n").alias("na"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("nb"))
    pairs_of = F.transform(F.filter("before", lambda x: x["n"] * far >= F.col("n")), lambda x: F.struct(x["pg"].alias("a"), x["n"].alias("na"), F.col("pg").alias("b"), F.col("n").alias("nb")))

    def listed(tokens: Column) -> DataFrame:
        lists = some.select(F.explode(tokens).alias("token"), "n", "pg").withColumn("same", F.lag("pg").over(by_size)).where("same is null or same <> pg").drop("same")
        lists = lists.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
        lists = lists.withColumn("before", F.collect_list(F.struct("pg", "n")).over(by_size.rowsBetween(1 - SHORT, -1)))
        return lists.select("token", F.explode(F.when(F.col("df") <= SHORT, pairs_of).otherwise(F.array(pair))).alias("x")).select("token", "x.*")

    # Each pass takes the tokens of one remainder, and its shuffle goes before the next begins.
    passes = math.ceil((some.agg(F.sum(F.size("rare"))).first()[0] or 0) / PASS_TOKENS)
    if passes <= 1:
        lists = work.keep(listed(F.col("rare")), "lists")
    else:
        lists = reduce(DataFrame.union, [work.keep(listed(F.filter("rare", lambda t, k=k: F.pmod(t, F.lit(passes)) == k)), f"lists-{k}") for k in range(passes)])

    # A pair that meets in short lists only has as many shingles in common up to the end of the prefix that ends first.
    pairs = lists.where("b is not null and a <> b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    needed = F.ceil((F.col("na") + F.col("nb")) * F.lit(percent) / F.lit(100 + percent))
    beyond = lambda n: F.ceil(F.col(n) * F.lit(percent) / 100) - 1
    pairs = work.keep(pairs.where(F.col("shared") + F.greatest(beyond("na"), beyond("nb")) >= needed), "pairs")
    ends = some.groupBy("pg").agg(F.min(F.struct("last_count", "last_hash")).alias("end"))
    pairs = pairs.join(ends.select(F.col("pg").alias("a"), F.col("end").alias("ea")), "a").join(ends.select(F.col("pg").alias("b"), F.col("end").alias("eb")), "b")
    first, other = F.when(F.col("ea") <= F.col("eb"), beyond("na")).otherwise(beyond("nb")), F.when(F.col("ea") <= F.col("eb"), F.col("nb")).otherwise(F.col("na"))
    short = pairs.where(F.least(F.col("shared") + first, other) >= needed).select("a", "b")

    # Copies, which every task lists anew, are one node of a list: the work on a list grows with its nodes' square.
    heavy = some.select(F.explode("common").alias("token"), "pg", "n", F.col("parity").alias("payload")).distinct()
    maps = some.where("size(rare) > 0").select("pg", F.col("parity").alias("payload")).distinct()
    long = heavy.unionByName(lists.where("b is null").select("token", F.col("a").alias("pg"), F.col("na").alias("n")).join(maps, "pg"))
    long = work.keep(long.select(F.col("token").alias("k1"), F.explode(_classes(percent)).alias("k2"), F.col("pg").alias("node"), "n", F.concat("payload", F.unhex(F.lpad(F.hex("n"), 16, "0"))).alias("payload")), "long")

    def load(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield from (np.frombuffer(x, ">u8").astype(np.uint64) for x in batch.column(6).to_pylist())

    return short.union(connect(long, lambda rows: rows, near, percent, load, work, "near", BLOCK_GROUPS))


def _verified(docs: DataFrame, sets: DataFrame, n: int, percent: int, work: Workspace) -> DataFrame:
    """Links (a, b) that connect what linked sets connect inside clusters; large clusters are first taken apart by size."""
    crowd = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    whole = sets.groupBy("cluster").agg(F.count("*").alias("m"), crowd.alias("parts")).where("m > 1")
    index = sets.join(whole, "cluster").withColumn("k2", F.explode(F.when(F.col("parts") <= 1, F.array(F.lit(-1).cast("long"))).otherwise(_classes(percent))))
    index = work.keep(index.select(F.col("cluster").alias("k1"), "k2", F.col("doc_id").alias("node"), "n"), "members")

    def attach(rows: DataFrame) -> DataFrame:
        texts = only_ids(docs, id_filter(docs.sparkSession, rows.select(F.col("node").alias("doc_id"))))
        return rows.join(texts.select(F.col("doc_id").alias("node"), F.col("text").alias("payload")), "node")

    def load(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in hashing.slices(batch, "payload"):
            yield from shingle_sets(part, n, "payload")

    return connect(index, attach, overlaps, percent, load, work, "links", BLOCK_DOCS, BLOCK_SHINGLES)


def _spread(base: DataFrame, found: DataFrame) -> DataFrame:
    """Each row's component: of sets with very many copies by a broadcast of at most 10,000 of them, of the rest by a join."""
    key = ["s1", "s2", "n"]
    rows = base.select("doc_id", *key)
    many = max(5_000, rows.count() // 10_000)
    often = found.where(F.col("copies") >= many).select(*key, F.col("component_id").alias("often"))
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rows = rows.where("n > 0").join(F.broadcast(often), key, "left")
    copied = rows.where("often is not null").withColumnRenamed("often", "component_id")
    rest = rows.where("often is null").drop("often").join(found.where(F.col("copies") < many).drop("copies"), key, "left")
    for part in (copied, rest):
        empty = empty.union(part.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))
    return empty
