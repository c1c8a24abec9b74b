"""Line deduplication by overlapping three-line windows; DataFrame functions only.

A window is ``width`` consecutive lines of one document, known by two 64-bit hashes.  A window that also starts earlier
(smaller id, or same document and earlier line) is a later occurrence, and every line it covers goes; covered positions
are merged to spans, and what lies between the spans stays.

Counts and first places of windows are combined before they are shuffled.  The join that finds later occurrences is an inner
one of single windows, whose hot keys the adaptive planner splits.

Defined results: null text has no lines and stays null; empty text is one empty line; texts shorter than a window stay
whole; very long ones are split whole.  Rows with a null id stay whole, are not shuffled, and remove nothing.  Rows that
repeat an id share positions: of equal windows at one position neither is the later one, and equal rows get equal results.
All other columns are passed through, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.storage import Workspace

#: Bits of the filter over ids of texts to be cut.
FILTER_BITS = 24


def dedup_lines(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with the text cut, and ``n_lines``, ``n_removed`` (replacing columns of these names)."""
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.split(F.col(text_col), "\n", -1).alias("ls"))
    texts = texts.where(F.size("ls") >= width)
    joined = ", ".join(f"element_at(ls, i + {k + 1})" for k in range(width))
    keys = f"transform(sequence(0, size(ls) - {width}), i -> struct(xxhash64({joined}) as h1, xxhash64('w', {joined}) as h2))"
    windows = texts.select("id", F.posexplode(F.expr(keys)).alias("pos", "h")).select("id", "pos", "h.h1", "h.h2")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first")).where("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).where("struct(id, pos) > first").select("id", "pos").distinct()
    of_doc = Window.partitionBy("id").orderBy("pos")
    opens = later.withColumn("opens", F.when(F.col("pos") - F.lag("pos").over(of_doc) <= width, 0).otherwise(1))
    spans = opens.withColumn("span", F.sum("opens").over(of_doc)).groupBy("id", "span").agg(F.min("pos").alias("lo"), (F.max("pos") + width).alias("hi"))
    spans = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("cut"))
    spans = Workspace(docs.sparkSession, "lines").keep(spans, "cuts")

    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("d"), F.col(id_col).alias("key"))
    # Only texts that may be cut are shuffled: a filter of the ids' hashes, at most 2**18 words of 64 bits, tells the others.
    slot = lambda name: F.pmod(F.xxhash64(name), F.lit(1 << FILTER_BITS))
    words = spans.select(F.shiftright(slot("id"), 6).alias("at"), (slot("id") % 64).cast("int").alias("bit"))
    words = words.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    row = row.withColumn("at", F.shiftright(slot("key"), 6)).withColumn("bit", (slot("key") % 64).cast("int"))
    row = row.join(F.broadcast(words), "at", "left")
    maybe = F.coalesce(F.expr("shiftright(bits, bit) & 1L = 1L"), F.lit(False)) & F.col("key").isNotNull()
    touched, whole = row.where(maybe), row.where(~maybe).select("d", F.lit(None).cast(spans.schema["cut"].dataType).alias("cut"))
    row = touched.join(spans, touched["key"] == spans["id"], "left").select("d", "cut").union(whole).withColumn("t", F.col("d").getField(text_col))
    row = row.withColumn("ls", F.when(F.col("t").isNotNull(), F.split("t", "\n", -1)))
    piece = "slice(ls, if(i = 0, 0, cut[i - 1].hi) + 1, if(i = size(cut), size(ls), cut[i].lo) - if(i = 0, 0, cut[i - 1].hi))"
    kept = F.expr(f"array_join(flatten(transform(sequence(0, size(cut)), i -> {piece})), '\n')")
    gone = F.expr("aggregate(cut, 0L, (a, x) -> a + x.hi - x.lo)")
    out = [(F.when(F.col("cut").isNull(), F.col("t")).otherwise(kept) if c == text_col else F.col("d").getField(c)).alias(c) for c in names]
    return row.select(*out, F.coalesce(F.size("ls"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"))
