"""Chat formatting with cumulative-snapshot collapse.

Logged conversations are often snapshots of longer ones.  Each conversation's turns get rolling prefix hashes (two
64-bit hashes, each turn salted by its place); a conversation whose whole hash is the hash of a proper prefix of another
one goes in an anti-join, and equal conversations leave the one with the smallest id.  The rest are rendered.

Defined results: rows with a null conv_id belong to no conversation and are left out.  Null turns come last, null roles
and texts count as empty.  Repeated rows count once.  Turns with one number are ordered by role, then text.  ``<|`` in a
text is rendered as ``< |``, so that no text can forge a turn.  Columns but the four named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.storage import Workspace

LAST = 9223372036854775807


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations, itself included), rendered: the maximal conversations."""
    work = Workspace(turns.sparkSession, "chat")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = work.keep(rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("ts")), "whole")
    each = whole.select("conv_id", F.size("ts").alias("n"), F.posexplode(F.expr("transform(ts, (t, i) -> struct(xxhash64(i, t.role, t.text) as a, xxhash64('chain', t.text, i, t.role) as b))")).alias("i", "h"))
    chain = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("conv_id", "n", (F.col("i") + 1).alias("len"), F.bit_xor("h.a").over(chain).alias("a"), F.bit_xor("h.b").over(chain).alias("b"))
    each = work.keep(each, "prefixes")
    full = each.where("len = n").groupBy("len", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = each.where("len < n").groupBy("len", "a", "b").agg(F.lit(1).alias("one")).drop("one")
    kept = full.join(inner, ["len", "a", "b"], "left_anti").select("conv_id", "n_copies")
    text = F.expr("array_join(transform(ts, t -> concat('<|im_start|>', replace(t.role, '<|', '< |'), '\n', replace(t.text, '<|', '< |'), '<|im_end|>\n')), '')")
    return whole.join(kept, "conv_id").select("conv_id", F.size("ts").cast("long").alias("n_turns"), "n_copies", text.alias("rendered"))
