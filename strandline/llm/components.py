"""Connected components of link tables, by alternating star contractions."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.storage import Workspace


#: Links that one task may settle: about 100 MB of them.
ONE_TASK = 500_000


class Forest:
    """Union-find whose root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def _contract(batches):
    """Each task's links as stars around their smallest member; at most as many links come out as went in."""
    forest = Forest()
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            forest.join(a, b)
    rows = [(forest.root(x), x) for x in list(forest.up)]
    pairs = np.array([r for r in rows if r[0] != r[1]], np.int64).reshape(-1, 2)
    for at in range(0, len(pairs), 50_000):
        yield pd.DataFrame({"a": pairs[at : at + 50_000, 0], "b": pairs[at : at + 50_000, 1]})


def components(links: DataFrame, work: Workspace, label: str = "cc") -> DataFrame:
    """links(a, b: long) to (node, component): the smallest node reachable; nodes without links are absent.

    Empty links give an empty table; loops and repeated links change nothing; rows with a null end are left out.
    Every round contracts within tasks, then lets each node's neighbours meet at the smallest one (a large star and a
    small star), writes the links to the shared folder and stops when they no longer change, or when they are few enough for
    one task; both ways give the same components.
    """
    kind = "a long, b long"
    named = lambda df: df.select(F.col("b").alias("node"), F.col("a").alias("component"))
    links = links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = work.keep(links.mapInPandas(_contract, kind).distinct(), f"{label}-0")
    mark = None
    for k in count(1):
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (found[0], found[1]) == mark or not found[0]:
            break
        if found[0] <= ONE_TASK:  # one task's forest settles so few at once
            now = work.keep(now.repartition(1).mapInPandas(_contract, kind), f"{label}-last")
            break
        mark = (found[0], found[1])
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        first = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(first.withColumnRenamed("b", "u"), F.col("b") == F.col("u")).select(F.col("m").alias("x"), F.col("a").alias("y")).where("x <> y")
        small = small.union(first.select(F.col("m").alias("x"), F.col("b").alias("y")))
        small = small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        now = work.keep(small.mapInPandas(_contract, kind).distinct(), f"{label}-{k}")
        work.drop(f"{label}-{k - 1}")
    # Settled links are stars around the smallest node, so each other node has one.
    return named(now).union(named(now.select("a", F.col("a").alias("b")).distinct()))
