"""Removal of repeated passages by suffix automata of reference shards.

Words are runs outside ``[\\x20\\x09-\\x0D]``, unchanged.  A window is ``width`` consecutive words of one document; each
word covered by a window whose sequence also starts earlier (smaller doc_id, or same document and earlier start) goes.

1. Every window has an anchor, the least of its ``gram``-word hashes (leftmost of equal ones), so equal windows have equal
   anchors.  Anchors that occur at least twice are kept with the first document that has them.
2. The text around anchors in their first document is the reference.  It is cut into shards of bounded size, each shard
   becomes a suffix automaton whose states know where their strings end first, and it is handed to as many tasks as the
   documents that share its anchors need.
3. These documents stream through it.  Where the matching statistic reaches ``width`` and the matched string ends earlier
   elsewhere, the window is removed; consecutive windows make maximal spans.
4. Windows with a repeated anchor that no reference explains (an anchor whose first context differs) are few; an
   exact count of their hashes settles them.

Defined results: null or empty text has no words; texts shorter than a window stay whole; very long ones are cut whole, and
one that is the first home of very many repeated anchors makes an automaton as large as itself.  Rows with a null id are
kept whole and remove nothing.  Repeated rows share id and positions, neither starts earlier, so they get equal results.
Other columns are not read, so clashing names do no harm.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import hashing
from strandline.llm.ngramjoin import id_filter, only_ids
from strandline.llm.storage import Workspace

#: Repeated anchors of a reference shard: about 60,000 words, 40 MB as an automaton.
SHARD_ANCHORS = 6_000
#: Anchors of the documents that one task streams through a shard.
PART_ANCHORS = 60_000


def window_anchors(words: np.ndarray, rows: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the position of each one's anchor, and the gram hash at every position."""
    h = hashing.grams(words, gram)
    span = width - gram + 1
    if len(words) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h
    value, at, have = h, np.arange(len(h)), 1
    while have < span:
        step = min(have, span - have)
        a, b = value[: len(value) - step], value[step:]
        right = b < a
        at = np.where(right, at[step:], at[: len(at) - step])
        value = np.where(right, b, a)
        have += step
    ok = np.ones(len(value), bool)
    size = np.diff(rows)
    for_row = np.repeat(rows[1:], size)[: len(value)]
    ok = np.arange(len(value)) + width <= for_row
    starts = np.flatnonzero(ok)
    return starts, at[starts], h


def _tokens(part: pa.RecordBatch, column: str = "text"):
    data, offsets = hashing.raw(part.column(part.schema.get_field_index(column)))
    starts, ends, rows = hashing.bounds(data, offsets)
    return data, starts, ends, rows, hashing.word_hashes(data, starts, ends)


def _anchors(width: int, gram: int, distinct: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch):
                *_, rows, words = _tokens(part)
                _, at, h = window_anchors(words, rows, width, gram)
                at = np.unique(at)
                owner = np.searchsorted(rows, at, "right") - 1
                value = h[at]
                if distinct and len(at):
                    order = np.lexsort((value, owner))
                    value, owner = value[order], owner[order]
                    new = np.ones(len(at), bool)
                    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
                    value, owner = value[new], owner[new]
                ids = part.column(0).cast(pa.int64()).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([pa.array(hashing.signed(value)), ids], ["anchor", "doc_id"])

    return task


def _runs(places: np.ndarray) -> bytes:
    """Rising numbers as pairs (first, how many in a row)."""
    step = np.flatnonzero(np.diff(places, prepend=places[0] - 2) > 1) if len(places) else np.zeros(0, np.int64)
    return np.stack([places[step], np.diff(np.append(step, len(places)))], 1).astype(np.int32).tobytes()


def _marked(runs: bytes, n: int) -> np.ndarray:
    """The numbers of ``_runs`` as flags."""
    out = np.zeros(n, bool)
    for a, m in np.frombuffer(runs, np.int32).reshape(-1, 2).tolist():
        out[a : a + m] = True
    return out


def _segments(width: int, gram: int):
    """Runs of words that windows with a shard's anchors cover, for each document and shard, as reference and as stream;
    with the windows among them, and those whose anchor has this document as its home."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "kind", "doc_id", "pos", "words", "runs", "homes"]
        for batch in batches:
            for part in hashing.slices(batch):
                data, starts, ends, rows, words = _tokens(part)
                first, at, h = window_anchors(words, rows, width, gram)
                cut = np.searchsorted(first, rows)
                out: list[list] = [[], [], [], [], [], [], []]
                column = {x: part.column(part.schema.get_field_index(x)) for x in ("doc_id", "found")}
                for k in range(part.num_rows):
                    found = column["found"][k].values
                    anchor, shard, ref = (np.asarray(found.field(i)) for i in range(3))
                    order = np.argsort(anchor, kind="stable")
                    anchor, shard, ref = anchor[order], shard[order], ref[order].astype(bool)
                    mine = slice(cut[k], cut[k + 1])
                    own, start = h[at[mine]].view(np.int64), first[mine]
                    where = np.minimum(np.searchsorted(anchor, own), len(anchor) - 1)
                    known = anchor[where] == own
                    start, to, is_ref = start[known], shard[where[known]], ref[where[known]]
                    for s in np.unique(to):
                        for kind in (0, 1):
                            use = start[(to == s) & is_ref] if kind == 0 else start[to == s]
                            if not len(use):
                                continue
                            new = np.flatnonzero(np.diff(use, prepend=use[0] - width - 1) > width)
                            for a, b in zip(new, [*new[1:], len(use)], strict=True):
                                run = use[a:b]
                                lo, hi = int(run[0]), int(run[-1]) + width
                                at_home = start[(to == s) & is_ref]
                                at_home = at_home[(at_home >= run[0]) & (at_home <= run[-1])]
                                for x, v in zip(out, (int(s), kind, column["doc_id"][k].as_py(), lo - int(rows[k]), data[starts[lo] : ends[hi - 1]].tobytes(), _runs(run - lo), _runs(at_home - lo)), strict=True):
                                    x.append(v)
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    return task


class SuffixAutomaton:
    """Over integer symbols; strings are added in rising order of (document, position)."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.doc, self.end = [-1], [0], [-1], [-1]

    def _state(self, moves: dict, length: int, link: int, doc: int, end: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.doc.append(doc)
        self.end.append(end)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        moves, link = self.next, self.link
        twin = self._state(dict(moves[q]), self.length[p] + 1, link[q], self.doc[q], self.end[q])
        link[q] = twin
        while p >= 0 and moves[p].get(c) == q:
            moves[p][c] = twin
            p = link[p]
        return twin

    def add(self, symbols: list[int], doc: int, pos: int) -> None:
        moves, link, length = self.next, self.link, self.length
        last = 0
        for end, c in enumerate(symbols, pos):
            q = moves[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            new = self._state({}, length[last] + 1, 0, doc, end)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def match(self, symbols: list[int], width: int) -> list[int]:
        """For each position the state of the last ``width`` symbols, or -1 where the matching statistic is less."""
        moves, link, length = self.next, self.link, self.length
        v = size = 0
        out = []
        for c in symbols:
            nxt = moves[v].get(c)
            while nxt is None and v:
                v = link[v]
                size = length[v]
                nxt = moves[v].get(c)
            if nxt is None:
                out.append(-1)
                continue
            v, size = nxt, size + 1
            if size >= width:
                size = width
                while length[link[v]] >= width:
                    v = link[v]
                out.append(v)
            else:
                out.append(-1)
        return out


def _stream(width: int):
    """Rows sorted by shard, part, kind, document, position: builds each shard's automaton, then streams documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton = None, SuffixAutomaton()
        for batch in batches:
            for part in hashing.slices(batch, "words"):
                docs, lo, hi, open_docs, hashes, open_at = [], [], [], [], [], []
                *_, rows, words = _tokens(part, "words")
                symbols = words.tolist()
                where = words_grams = None
                shard, piece, kind, ids, pos, runs, homes = (part.column(part.schema.get_field_index(x)).to_pylist() for x in ("shard", "part", "kind", "doc_id", "pos", "runs", "homes"))
                for k in range(part.num_rows):
                    if (shard[k], piece[k]) != now:
                        now, automaton = (shard[k], piece[k]), SuffixAutomaton()
                    mine = symbols[rows[k] : rows[k + 1]]
                    if kind[k] == 0:
                        automaton.add(mine, ids[k], pos[k])
                        continue
                    doc, at = ids[k], pos[k]
                    state = np.array(automaton.match(mine, width), np.int64)[width - 1 :]
                    if words_grams is None:
                        words_grams = hashing.grams(words, width)
                    hit = np.flatnonzero(state >= 0)
                    gone, own = np.zeros(len(state), bool), np.zeros(len(state), bool)
                    for i in hit.tolist():
                        v = state[i]
                        d, e = automaton.doc[v], automaton.end[v]
                        here = at + i + width - 1
                        if d < doc or d == doc and e < here:
                            gone[i] = True
                        elif d == doc and e == here:
                            own[i] = True
                    where = np.flatnonzero(gone)
                    if len(where):
                        new = np.flatnonzero(np.diff(where, prepend=where[0] - width - 1) > width)
                        docs += [doc] * len(new)
                        lo += (where[new] + at).tolist()
                        hi += (where[np.append(new[1:], len(where)) - 1] + at + width).tolist()
                    # Known first from here settles a window only where its anchor is at home: else others may lie open too.
                    left = np.flatnonzero(_marked(runs[k], len(state)) & ~gone & ~(own & _marked(homes[k], len(state))))
                    if len(left):
                        open_docs += [doc] * len(left)
                        hashes.append(words_grams[rows[k] + left])
                        open_at += (left + at).tolist()
                if docs or open_docs:
                    value = np.concatenate([np.zeros(len(docs), np.uint64), *hashes]).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs + open_docs, pa.int64()), pa.array(lo + open_at, pa.int32()), pa.array(hi + [-1] * len(open_at), pa.int32()), pa.array(value)],
                        ["doc_id", "lo", "hi", "value"],
                    )

    return task


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the spans (pairs of word positions, may overlap) from each text."""
    for batch in batches:
        has = batch.schema.get_field_index("spans")
        for part in hashing.slices(batch):
            total, removed, kept, spans = [], [], [], []
            texts = part.column(part.schema.get_field_index("text"))
            cuts = part.column(has).to_pylist() if has >= 0 else [None] * part.num_rows
            for text, cut in zip(texts, cuts, strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                total.append(len(words))
                merged: list[list[int]] = []
                for a, b in sorted((x["lo"], x["hi"]) for x in cut or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                left, at = [], 0
                for a, b in merged:
                    left += words[at:a]
                    at = b
                left += words[at:]
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
                spans.append(merged)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                ["doc_id", "text", "n_words", "n_removed", "spans"],
            )


def remove_repeats(docs: DataFrame, width: int = 20, gram: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (kept words joined by spaces), n_words, n_removed, spans (word positions [from, to)) of every row."""
    spark = docs.sparkSession
    work = Workspace(spark, "substring")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    some = docs.where("doc_id is not null and text is not null")
    kind = "anchor long, doc_id long"
    again = some.mapInArrow(_anchors(width, gram, False), kind).groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("home")).where("n > 1").select("anchor", "home", "n")
    again = work.keep(again, "anchors")
    shards = max(1, -(-again.count() // SHARD_ANCHORS))
    owners = again.select("anchor", "home", F.pmod(F.xxhash64("home"), F.lit(shards)).cast("int").alias("shard"))
    seen = some.mapInArrow(_anchors(width, gram, True), kind).join(owners, "anchor")
    seen = seen.groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "shard", (F.col("home") == F.col("doc_id")).alias("ref"))).alias("found"))
    seen = work.keep(seen, "found")

    texts = only_ids(some, id_filter(spark, seen)).join(seen, "doc_id")
    pieces = work.keep(texts.mapInArrow(_segments(width, gram), "shard int, kind int, doc_id long, pos int, words binary, runs binary, homes binary"), "pieces")
    work.drop("found")
    load = pieces.where("kind = 1").groupBy("shard").agg(F.greatest(F.ceil(F.sum(F.length("words")) / F.lit(PART_ANCHORS * 50)), F.lit(1)).cast("int").alias("parts"))
    pieces = pieces.join(F.broadcast(load) if shards <= 50_000 else load, "shard")
    streams = pieces.where("kind = 1").withColumn("part", F.expr("cast(pmod(xxhash64(doc_id), parts) as int)"))
    copies = pieces.where("kind = 0").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    names = ["shard", "part", "kind", "doc_id", "pos", "words", "runs", "homes"]
    dealt = streams.select(names).union(copies.select(names)).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", "doc_id", "pos")
    found = work.keep(dealt.mapInArrow(_stream(width), "doc_id long, lo int, hi int, value long"), "matches")
    work.drop("pieces")

    spans = found.where("hi >= 0").select("doc_id", "lo", "hi")
    rest = found.where("hi < 0").select("doc_id", F.col("lo").alias("pos"), "value")
    twice = rest.groupBy("value").agg(F.count("*").alias("n"), F.min("doc_id").alias("d")).where("n > 1").select("value", "d")
    later = rest.join(twice, "value")
    inside = later.where("doc_id = d").groupBy("value", "doc_id").agg(F.min("pos").alias("p")).select("value", F.col("doc_id").alias("d2"), "p")
    later = later.join(inside, (inside["value"] == later["value"]) & (inside["d2"] == later["doc_id"]), "left").where("doc_id > d or pos > p")
    spans = spans.union(later.select("doc_id", F.col("pos").alias("lo"), (F.col("pos") + width).cast("int").alias("hi")))
    spans = work.keep(spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")

    out = "doc_id long, text string, n_words long, n_removed long, spans array<array<int>>"
    touched = id_filter(spark, spans)
    return only_ids(docs, touched).join(spans, "doc_id", "left").mapInArrow(_cut, out).union(only_ids(docs, touched, inverse=True).mapInArrow(_cut, out))
