"""Arrays inside JSON documents of any size, read in splits.

Spark's text source cuts a file at commas, by ranges of bytes, wherever the file is stored.  A cut can fall anywhere, so a first
scan says of each split what it does to the state of a JSON reader, for both states of "inside a string" that it may start
in; a window over these few rows gives every split its true start.  Backslashes never stand before a comma outside of
a pair, so no escape crosses a cut."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.lineage import cut

#: Up to as many splits (about 100 bytes each) the table of their starts is broadcast; beyond that the text is shuffled to it.
BROADCAST_SPLITS = 100_000


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of quotes that aren't escaped; positions and bytes of brackets and commas; quotes before each of those."""
    b = np.frombuffer(text, np.uint8)
    quotes = np.flatnonzero(b == 0x22)
    if len(quotes) and (b == 0x5C).any():
        plain = np.maximum.accumulate(np.where(b != 0x5C, np.arange(len(b)), -1))
        run = quotes - 1 - np.where(quotes > 0, plain[quotes - 1], -1)
        quotes = quotes[run % 2 == 0]
    at = np.flatnonzero(np.isin(b, np.frombuffer(b"[]{},", np.uint8)))
    return quotes, at, b[at], np.searchsorted(quotes, at)


def _named(text: bytes, quotes: np.ndarray, at: int, before: int, key: str | None) -> bool:
    """Is the bracket at ``at``, behind ``before`` quotes, the array under that key?  Without a key: an array at all."""
    if text[at] != 0x5B:
        return False
    if key is None:
        return True
    if before < 2 or text[quotes[before - 1] + 1 : at].strip() != b":":
        return False
    try:
        return json.loads(text[quotes[before - 2] : quotes[before - 1] + 1]) == key
    except ValueError:
        return False


def _splits(batches: Iterator[pd.DataFrame], extra: list[str]) -> Iterator[tuple[tuple, bytes | None]]:
    """(split, text) of each run of rows of one split, then (split, None) behind its last; pieces are joined by the commas they
    were cut at."""
    now, fresh = None, True
    for pdf in batches:
        ids = pdf[["path", "block", *extra]]
        edges = np.flatnonzero((ids["path"] != ids["path"].shift()) | (ids["block"] != ids["block"].shift()))
        for lo, hi in zip(edges, [*edges[1:], len(pdf)], strict=True):
            split = tuple(ids.iloc[lo])
            if now is not None and split[:2] != now[:2]:
                yield now, None
                fresh = True
            now, joined = split, ",".join(pdf["value"].iloc[lo:hi])
            yield now, (joined if fresh and split[1] == 0 else "," + joined).encode()
            fresh = False
    if now is not None:
        yield now, None


def _summaries(key: str | None, level: int):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips, depth, opened = 0, [0, 0], [{}, {}]
        for split, text in _splits(batches, []):
            if text is None:
                yield pd.DataFrame([(*split, flips % 2, *depth, *opened)], columns=["path", "block", "flips", "net0", "net1", "opened0", "opened1"])
                flips, depth, opened = 0, [0, 0], [{}, {}]
                continue
            quotes, at, kind, before = _marks(text)
            for h in (0, 1):
                real = ((flips + before + h) % 2 == 0) & (kind != 0x2C)
                turns = np.where((kind[real] == 0x5B) | (kind[real] == 0x7B), 1, -1)
                depths = depth[h] + np.cumsum(turns)
                places = np.flatnonzero(real)[(turns > 0) & (depths <= level)]
                last = dict(zip(depths[(turns > 0) & (depths <= level)].tolist(), places.tolist(), strict=True))
                opened[h] |= {d: _named(text, quotes, int(at[i]), int(before[i]), key) for d, i in last.items()}
                depth[h] += int(turns.sum())
            flips += len(quotes)

    return task


def _elements(key: str | None, level: int, edges: bool):
    """Whole elements, or (``edges``) the parts of those that a cut between splits divides."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held, fresh = [], [], True
        flips = depth = n = 0
        hit = begun = False

        def put(split: tuple, whole: bool) -> None:
            nonlocal n
            text = b"".join(held).decode()
            if edges and not whole:
                out.append((split[0], split[1], n, begun, text))
            elif not edges and whole and text.strip():
                out.append((split[0], split[1], n, begun, text.strip()))
            n += 1
            held.clear()

        for split, text in _splits(batches, ["inside", "depth", "hit"]):
            if fresh:
                flips, depth, hit, n, begun, fresh = int(split[2]), int(split[3]), bool(split[4]) and split[3] >= level, 0, False, False
            if text is None:
                if hit:
                    put(split, False)
                held.clear()
                fresh = True
            else:
                quotes, at, kind, before = _marks(text)
                real = (flips + before) % 2 == 0
                at, kind, before = at[real], kind[real], before[real]
                turns = np.where(kind == 0x2C, 0, np.where((kind == 0x5B) | (kind == 0x7B), 1, -1))
                depths, start = depth + np.cumsum(turns), 0
                for i in np.flatnonzero((depths == level) & (turns >= 0) & ((turns > 0) | (kind == 0x2C)) | (depths == level - 1) & (turns < 0)):
                    if hit:
                        held.append(text[start : at[i]])
                        put(split, begun)
                    if turns[i]:
                        hit = turns[i] > 0 and _named(text, quotes, int(at[i]), int(before[i]), key)
                    begun, start = True, int(at[i]) + 1
                if hit:
                    held.append(text[start:])
                flips, depth = flips + len(quotes), int(depths[-1]) if len(depths) else depth
            if len(out) >= 1_000 or text is None and out:
                yield pd.DataFrame(out, columns=["path", "block", "n", "begun", "item"])
                out = []

    return task


def array_texts(spark: SparkSession, path: str, key: str | None, broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """path, block, n, item: the text of each element, in the order of (block, n) within its file, of the arrays under ``key`` of
    the files' top objects (any number of objects a file), or of top arrays where ``key`` is None.

    Splits are as large as ``spark.sql.files.maxPartitionBytes``; a task holds a batch of text and the element it is in.  Three
    scans, no shuffle of the text.  Documents that end inside a string or a bracket are an error; files without such an
    array give no rows.  UTF-8 only."""
    if key is not None and "," in key:
        raise ValueError("a key with a comma could be cut")
    level = 1 if key is None else 2
    pieces = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    at = Window.partitionBy("path").orderBy("block")
    before, whole = at.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    s = cut(pieces.mapInPandas(_summaries(key, level), "path string, block long, flips int, net0 long, net1 long, opened0 map<long,boolean>, opened1 map<long,boolean>"))
    s = s.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    picked = lambda n: F.when(F.col("inside") == 1, F.col(f"{n}1")).otherwise(F.col(f"{n}0"))
    s = s.withColumns({"net": picked("net"), "opened": picked("opened")}).withColumn("depth", F.coalesce(F.sum("net").over(before), F.lit(0)))
    last = F.try_element_at("opened", F.lit(level) - F.col("depth"))
    s = s.withColumn("hit", F.coalesce(F.last(last, ignorenulls=True).over(before), F.lit(False)))
    ends = (F.sum("flips").over(whole) % 2 == 0) & (F.sum("net").over(whole) == 0)
    starts = cut(s.select("path", "block", "inside", F.when(ends, F.col("depth")).otherwise(F.raise_error(F.concat(F.lit("a document doesn't end: "), "path")).cast("long")).alias("depth"), "hit"))
    if starts.count() <= broadcast_splits:
        known = pieces.join(F.broadcast(starts), ["path", "block"])
    else:
        known = pieces.withColumn("seq", F.monotonically_increasing_id()).join(starts.hint("merge"), ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "seq").drop("seq")
    schema = "path string, block long, n long, begun boolean, item string"
    parts = cut(known.mapInPandas(_elements(key, level, True), schema))
    w = Window.partitionBy("path").orderBy("block", "n")
    joined = parts.withColumn("element", F.sum(F.col("begun").cast("int")).over(w)).groupBy("path", "element")
    order = F.array_sort(F.collect_list(F.struct("block", "n", "item")))
    joined = joined.agg(order.alias("p")).select("path", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["n"].alias("n"), F.btrim(F.array_join(F.col("p.item"), ""), F.lit(" \t\r\n")).alias("item"))
    return known.mapInPandas(_elements(key, level, False), schema).drop("begun").unionByName(joined.where("item <> ''"))


def array_items(spark: SparkSession, path: str, key: str | None, item_schema: str) -> DataFrame:
    """The objects of such arrays as rows; what is no such object is an error."""
    items = array_texts(spark, path, key).select(F.from_json("item", item_schema, {"mode": "FAILFAST"}).alias("item"))
    return items.select("item.*")
