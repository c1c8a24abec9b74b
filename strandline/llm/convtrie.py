"""Prefix trie of conversations, folded from its leaves by message passing.

Conversations are numbered by turn, spliced where asked, and given rolling prefix hashes (two 64-bit hashes, turns salted by their
place), so that equal prefixes are one node of a trie with counts, found by one aggregation.  Its totals are folded upwards by leaf
peeling: whoever waits for no child sends its subtree's totals to its parent, whose counter falls by the children heard from, until only
the root's finishes.  What peels is not the single node but the path down to the longest conversation: each node belongs to the path of
the longest of its members (the smallest id, if several), which its longest child shares, so a path is a run of depths that ends in a leaf,
and all paths together are the trie.  A path holds a counter of the paths hanging off it and sends one message when that is zero, so a
conversation of a thousand turns takes one round, not a thousand; rounds are as many as paths hang below each other, at most about the
square root of twice the nodes.  Within a path, totals are sums over the depths below, taken in blocks of ``SPAN`` with the sums of later
blocks carried over, as running hashes are along a conversation, so a long one is spread over tasks.

Defined results: rows with a null conv_id belong to no conversation.  Turns are ordered by number (null first), then role and text; null
roles and texts are empty; repeated rows are turns of their own.  A conversation that splicing leaves without turns ends at the root.
An empty table has no node.  Columns but the four named are not read.  Rows with one conv_id and one number (or numbers within
one span of ``SPAN``) are sorted in one task; SHA-256 over the ids that end at a node takes them in order, so it's one task's stream,
of strings that up to ``SPAN`` ids each were joined to beforehand.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.storage import Workspace

#: Turn numbers, depths and ids of a block: 2**10.
BITS = 10
SPAN = 1 << BITS


def _before(df: DataFrame, key: str, block: str, sums: dict[str, Column], later: bool = False) -> DataFrame:
    """For each (key, block) the aggregates over all earlier (or later) blocks of the key; null where there are none."""
    each = df.groupBy(key, block).agg(*[e.alias(k) for k, e in sums.items()])
    rest = Window.partitionBy(key).orderBy(F.desc(block) if later else F.asc(block)).rowsBetween(Window.unboundedPreceding, -1)
    over = {k: (F.bit_xor if k.startswith("x") else F.sum)(k).over(rest) for k in sums}
    return each.select(key, block, *[e.alias(f"{k}_before") for k, e in over.items()])


def numbered(turns: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """conv_id, span, i, h1, h2, chars of each turn, and conv_id, span, offset, own of each span: the place is offset + i."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("span", F.coalesce(F.shiftright("turn", BITS), F.lit(-(2**62))))
    place = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    rows = rows.select("conv_id", "span", place.alias("i"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("turn"), "text", "role").alias("h2"), F.length("text").cast("long").alias("chars"))
    rows = work.keep(rows, "numbered")
    each, whole = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id")
    spans = rows.groupBy("conv_id", "span").agg(F.count("*").alias("n"))
    return rows, work.keep(spans.select("conv_id", "span", F.coalesce(F.sum("n").over(each), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("own")), "spans")


def spliced(turns: DataFrame, work: Workspace, base: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, length, depth from 1, h1, h2, chars) and lengths of all conversations, each starting with the first
    ``shared`` (at most ``most``) turns of conversation ``base`` instead of as many of its own."""
    rows, spans = numbered(turns, work)
    convs = spans.groupBy("conv_id").agg(F.first("own").alias("own")).select("conv_id", "own", base.cast("long").alias("base"), shared.cast("long").alias("shared"))
    places = rows.where(F.col("i") <= most).join(spans.select("conv_id", "span", "offset"), ["conv_id", "span"]).where(F.col("i") + F.col("offset") <= most)
    heads = places.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("i") + F.col("offset")).alias("depth"), "h1", "h2", "chars"))).alias("head"))
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    taken = F.least(F.col("shared"), F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    convs = convs.select("conv_id", "own", "shared", F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), taken.cast("int"))).alias("head"), F.greatest(taken, F.lit(0)).alias("taken"))
    convs = work.keep(convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("shared"), F.lit(0))), "convs")
    start = convs.select("conv_id", "length", F.inline("head"))
    shift = spans.join(convs.select("conv_id", "shared", "taken", "length"), "conv_id").select("conv_id", "span", "offset", "shared", "taken", "length")
    rest = rows.join(shift, ["conv_id", "span"]).where(F.col("i") + F.col("offset") > F.col("shared"))
    rest = rest.select("conv_id", "length", (F.col("i") + F.col("offset") - F.col("shared") + F.col("taken")).alias("depth"), "h1", "h2", "chars")
    return start.select(*rest.columns).union(rest), convs.select("conv_id", "length")


def _nodes(steps: DataFrame, lengths: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """One row per node (key x1, x2; parent's key p1, p2), and the node at which each conversation ends."""
    salted = steps.withColumn("s1", F.xxhash64("depth", "h1", "h2")).withColumn("s2", F.xxhash64("h2", "h1", F.lit("place"), "depth")).withColumn("block", F.shiftright("depth", BITS))
    salted = work.keep(salted.select("conv_id", "length", "depth", "block", "s1", "s2", "chars"), "steps")
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    carried = _before(salted, "conv_id", "block", {"x1": F.bit_xor("s1"), "x2": F.bit_xor("s2")}).where("x1_before is not null")
    walked = salted.withColumn("x1", F.bit_xor("s1").over(so_far)).withColumn("x2", F.bit_xor("s2").over(so_far)).join(carried, ["conv_id", "block"], "left")
    for x in ("x1", "x2"):
        walked = walked.withColumn(x, F.col(x).bitwiseXOR(F.coalesce(f"{x}_before", F.lit(0))))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = lengths.select("conv_id", "length", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), none.alias("p1"), none.alias("p2"), zero.alias("chars"))
    walked = walked.select("conv_id", "length", "depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("s2")).alias("p2"), "chars")
    walked = work.keep(walked.union(roots), "walked")
    work.drop("steps")
    longest = F.max(F.struct("length", F.bitwise_not("conv_id").alias("c")))["c"]
    nodes = walked.groupBy("x1", "x2").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.bitwise_not(longest).alias("path"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("chars").alias("chars"))
    nodes = work.keep(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).drop("chars"), "nodes")
    return nodes, walked.where("depth = length").select("x1", "x2", "conv_id")


def peel(paths: DataFrame, work: Workspace) -> DataFrame:
    """path, up, at, leaves, saved with the totals of whole subtrees, from paths(path, up: the path it hangs off or null, at: the depth
    it hangs off, saved: its own).  Each round, paths that wait for none send their totals up."""
    waiting = paths.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("waiting"))
    state = work.keep(paths.join(waiting, "path", "left").select("path", "up", "at", F.coalesce("waiting", F.lit(0)).alias("waiting"), F.lit(1).cast("long").alias("leaves"), "saved"), "peel-0")
    finished, k = None, 0
    while not state.isEmpty():
        done, k = state.where("waiting = 0"), k + 1
        finished = done if finished is None else finished.union(done)
        sent = done.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("heard"), F.sum("leaves").alias("more"), F.sum("saved").alias("most"))
        rest = state.where("waiting > 0").join(sent, "path", "left")
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        state = work.keep(rest.select("path", "up", "at", (F.col("waiting") - F.coalesce("heard", F.lit(0))).alias("waiting"), plus("leaves", "more"), plus("saved", "most")), f"peel-{k}")
    return (state if finished is None else finished).drop("waiting")


def _digests(batches):
    """SHA-256 of the pieces of each node, joined by commas; pieces come sorted."""
    now, state, out = None, None, []
    rows = lambda: pa.RecordBatch.from_pydict({"x1": pa.array([r[0] for r in out], pa.int64()), "x2": pa.array([r[1] for r in out], pa.int64()), "ends": pa.array([r[2] for r in out], pa.string())})
    for b in batches:
        for x1, x2, ids in zip(b.column("x1").to_pylist(), b.column("x2").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if (x1, x2) != now:
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (x1, x2), hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        yield rows()
        out = []
    if now:
        out.append((*now, state.hexdigest()))
        yield rows()


def conversation_trie(turns: DataFrame, base: Column | None = None, shared: Column | None = None, most: int = 0) -> DataFrame:
    """The nodes of the trie of turns(conv_id, turn, role, text): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (code points that repeats of a prefix would cost again, over the subtree), ends_sha256.

    ``base`` and ``shared``, expressions over conv_id, let conversations start with the first turns of others (``spliced``)."""
    work = Workspace(turns.sparkSession, "trie")
    steps, lengths = spliced(turns, work, F.col("conv_id") if base is None else base, F.lit(0) if shared is None else shared, most)
    nodes, ends = _nodes(steps, lengths, work)
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["x1", "x2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    parents = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("up"))
    linked = work.keep(nodes.where("depth > 0").join(parents, ["p1", "p2"]).select("x1", "x2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "path", "up", "saved").union(nodes.where("depth = 0").select("x1", "x2", "depth", "conv_id", F.lit(None).cast("long"), "n_convs", "n_children", "path", F.lit(None).cast("long"), "saved")), "linked")
    tops = linked.groupBy("path").agg(F.min("depth").alias("top"), F.min(F.when(F.col("up") != F.col("path"), F.col("up"))).alias("up"), F.sum("saved").alias("saved"))
    whole = peel(tops.select("path", "up", (F.col("top") - 1).alias("at"), "saved"), work)
    hung = whole.where("up is not null").groupBy(F.col("up").alias("path"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    linked = linked.join(hung, ["path", "depth"], "left").withColumn("block", F.shiftright("depth", BITS)).withColumn("saved", F.col("saved") + F.coalesce("hung_saved", F.lit(0))).withColumn("leaves", F.coalesce("hung_leaves", F.lit(0)))
    linked = work.keep(linked.drop("up", "hung_leaves", "hung_saved"), "hung")
    below = Window.partitionBy("path", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    carried = _before(linked, "path", "block", {"saved": F.sum("saved"), "leaves": F.sum("leaves")}, later=True).where("saved_before is not null")
    summed = linked.withColumn("saved", F.sum("saved").over(below)).withColumn("leaves", F.sum("leaves").over(below)).join(carried, ["path", "block"], "left")
    ids = ends.groupBy("x1", "x2", F.shiftright("conv_id", BITS).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    digests = ids.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "part").mapInArrow(_digests, "x1 long, x2 long, ends string")
    out = summed.join(digests, ["x1", "x2"], "left")
    plus = lambda a: F.col(a) + F.coalesce(f"{a}_before", F.lit(0))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (plus("leaves") + 1).alias("n_leaves"), plus("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
