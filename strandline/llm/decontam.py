"""Benchmark decontamination by template canonicalisation.

Words become typed placeholders where they are numbers, names (capitals inside a sentence) or units (after a number);
others are stripped of outer punctuation and lower-cased.  Windows of ``width`` template words of each benchmark item are
hashed, and beside them windows of the plain words, without placeholders; whole documents are scanned for both.  Hits of
one item on one diagonal (document place minus item place) form a match; its slots must fill consistently, one document
value for one item value and the other way round, so re-parameterised questions count and chance meetings of placeholders
do not.  A document is contaminated when a match covers at least ``share`` of an item's words, or ``run`` words without a
break.  Where slots are inconsistent, ``run`` equal words in a row still count.

The hash join's build side is the benchmark, in blocks of a bounded number of items, each broadcast to a step of its own;
rows of documents pass all steps in one scan, so the number of blocks changes neither rows nor results.

Defined results: null and empty texts are clean, and very long ones are scanned whole; items without words match nothing;
items shorter than a window are one window, from ``least`` words on, and shorter ones match nothing.  Template windows with
fewer than half of literal words are not used; plain ones all are.  Repeated items with other ids are items of their own,
items with a null id are left out.  Every row of documents, also of null or repeated id, is judged by its own text.  Items
that tie are all listed, by id; coverage and run are the largest.  An empty benchmark leaves all clean, an empty table gives
an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import hashing
from strandline.llm.storage import small_batches

WIDTH, LEAST, SHARE, RUN = 8, 5, 0.5, 13
#: Items of the benchmark that are broadcast at once.
BLOCK_ITEMS = 20_000
#: Units that may follow a number.
UNITS = tuple("% mm cm m km in ft mi g kg mg lb oz t s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years l ml cl usd eur dollar dollars euro euros cent cents mph kmh km/h °c °f c f k pa kpa bar v w kw kwh a hz khz mhz ghz b kb mb gb tb meter meters metre metres mile miles gram grams kilogram kilograms litre litres liter liters".split())
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?:"]] = True
_OUTER = np.ones(256, bool)
_OUTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("%"), ord("$")]] = False
_NUMERIC = np.zeros(256, bool)
_NUMERIC[[*range(48, 58), *(ord(c) for c in ".,-+%$/")]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
NUM, NAME, UNIT = (np.uint64(x) for x in (0xA5A5A5A501, 0xA5A5A5A502, 0xA5A5A5A503))


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hashing.word_hashes(data, np.array([0]), np.array([len(data)]), lower=True)[0])


_UNIT_HASHES = np.array(sorted(_hash_of(u) for u in UNITS), np.uint64)


def templates(data: np.ndarray, offsets: np.ndarray):
    """starts, ends (outer punctuation left out), row offsets, plain hash, template hash and literal flag of every word."""
    starts, ends, rows = hashing.bounds(data, offsets)
    n = len(starts)
    if not n:
        return starts, ends, rows, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    inner = np.flatnonzero(~_OUTER[data])
    a = np.searchsorted(inner, starts)
    b = np.searchsorted(inner, ends) - 1
    kept = b >= a
    if len(inner):
        first = np.where(kept, inner[np.minimum(a, len(inner) - 1)], starts)
        last = np.where(kept, inner[np.maximum(b, 0)] + 1, ends)
    else:
        first, last = starts, ends
    plain = hashing.word_hashes(data, first, last, lower=True)
    h = plain.copy()
    digits, numeric = (np.concatenate([[0], np.cumsum(t[data])]) for t in (_DIGIT, _NUMERIC))
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    number = (digits[last] > digits[first]) & (numeric[last] - numeric[first] == last - first)
    opens = np.zeros(n, bool)
    opens[1:] = _SENTENCE_END[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    opens[rows[:-1][rows[:-1] < n]] = True
    lead = data[first]
    upper = (lead >= 65) & (lead <= 90) | (lead == 0xC3) & (data[np.minimum(first + 1, len(data) - 1)] >= 0x80) & (data[np.minimum(first + 1, len(data) - 1)] <= 0x9E)
    name = upper & ~opens & ~number
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1] & np.isin(h[1:], _UNIT_HASHES)
    for mark, value in ((name, NAME), (number, NUM), (unit, UNIT)):
        h[mark] = value
    return first, last, rows, plain, h, ~(name | number | unit)


def windows(rows: np.ndarray, h: np.ndarray, literal: np.ndarray | None, width: int):
    """Starts and hashes of the windows inside rows that have enough literal words; of all windows where literal is None."""
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = hashing.grams(h, width)
    inside = np.arange(len(g)) + width <= np.repeat(rows[1:], np.diff(rows))[: len(g)]
    if literal is None:
        on = np.flatnonzero(inside)
        return on, g[on]
    sums = np.concatenate([[0], np.cumsum(literal)])
    on = np.flatnonzero(inside & (2 * (sums[width:] - sums[:-width]) >= width))
    return on, g[on]


class Index:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH, least: int = LEAST):
        self.width = width
        self.words, self.hashes, self.literal = [], [], []
        self.ids, places = [i for i, _ in items], defaultdict(lambda: defaultdict(list))
        for number, (_, text) in enumerate(items):
            raw = (text or "").encode()
            data = np.frombuffer(raw, np.uint8)
            first, last, rows, plain, h, literal = templates(data, np.array([0, len(data)]))
            self.words.append([raw[a:b].lower() for a, b in zip(first.tolist(), last.tolist(), strict=True)])
            self.hashes.append(h)
            self.literal.append(literal)
            size = width if len(h) >= width else len(h)
            if size >= least:
                for exact, (at, g) in ((False, windows(rows, h, literal, size)), (True, windows(rows, plain, None, size))):
                    for p, x in zip(at.tolist(), g.tolist(), strict=True):
                        places[size, exact][x].append((number, p))
        self.places = {k: dict(v) for k, v in places.items()}
        self.sorted = {k: np.array(sorted(v), np.uint64) for k, v in self.places.items()}

    def hits(self, rows: np.ndarray, plain: np.ndarray, h: np.ndarray, literal: np.ndarray) -> dict[int, dict[tuple[int, int], list[tuple[int, int, bool]]]]:
        """row: (item number, diagonal): (document place, window size, whether of plain words)"""
        out: dict = defaultdict(lambda: defaultdict(list))
        for (size, exact), wanted in self.sorted.items():
            at, g = windows(rows, plain, None, size) if exact else windows(rows, h, literal, size)
            where = np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)
            on = np.flatnonzero(wanted[where] == g)
            owner = np.searchsorted(rows, at[on], "right") - 1
            for p, x, k in zip(at[on].tolist(), g[on].tolist(), owner.tolist(), strict=True):
                for number, place in self.places[size, exact][x]:
                    out[k][number, p - place].append((p, size, exact))
        return out

    def match(self, number: int, diagonal: int, found: list[tuple[int, int, bool]], word) -> tuple[float, int, int, bool] | None:
        """The match of template windows, with plain ones where they fill the slots alike; where the template ones are
        inconsistent, what agrees word for word."""
        template = [x for x in found if not x[2]]
        alone = self._judge(number, diagonal, template, word) if template else None
        if template and alone is None:
            return self._verbatim(number, diagonal, found, word)
        if template and len(template) == len(found):
            return alone
        return self._judge(number, diagonal, found, word) or alone or self._verbatim(number, diagonal, found, word)

    def _verbatim(self, number: int, diagonal: int, found: list[tuple[int, int, bool]], word) -> tuple[float, int, int, bool]:
        """The longest run of equal words; nothing is said of a share, as the item isn't there as a whole."""
        same = [i for i in sorted({i for p, size, _ in found for i in range(p, p + size)}) if word(i) == self.words[number][i - diagonal]]
        return 0.0, _longest(same), len(same), False

    def _judge(self, number: int, diagonal: int, found: list[tuple[int, int, bool]], word) -> tuple[float, int, int, bool] | None:
        """Share of the item's words covered, longest run, words covered, and whether slots differ; None if inconsistent."""
        covered = sorted({i for p, size, _ in found for i in range(p, p + size)})
        there, back, differs = {}, {}, False
        for i in covered:
            if self.literal[number][i - diagonal]:
                continue
            a, b = self.words[number][i - diagonal], word(i)
            kind = int(self.hashes[number][i - diagonal])
            if there.setdefault((kind, a), b) != b or back.setdefault((kind, b), a) != a:
                return None
            differs |= a != b
        return len(covered) / len(self.words[number]), _longest(covered), len(covered), differs


def _longest(places: list[int]) -> int:
    """Length of the longest run of consecutive numbers."""
    best = run = min(1, len(places))
    for x, y in zip(places, places[1:], strict=False):
        run = run + 1 if y == x + 1 else 1
        best = max(best, run)
    return best


#: What a scan says of a row, as columns.
FOUND = "items array<long>, coverage double, longest_run long, reparameterised boolean, contaminated boolean"


def _scan(index, share: float, run: int, text_at: int):
    """Adds what the block's items say of each row to the last five columns."""
    kinds = [pa.list_(pa.int64()), pa.float64(), pa.int64(), pa.bool_(), pa.bool_()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Index = index.value
        for batch in batches:
            for part in hashing.slices(batch, batch.schema.names[text_at]):
                data, offsets = hashing.raw(part.column(text_at))
                first, last, rows, plain, h, literal = templates(data, offsets)
                found = held.hits(rows, plain, h, literal)
                before = [part.column(part.num_columns - 5 + i).to_pylist() for i in range(5)]
                out: list[list] = [[], [], [], [], []]
                for k in range(part.num_rows):
                    rest: dict[int, tuple[float, int, bool]] = {}
                    for (number, diagonal), places in found.get(k, {}).items():
                        got = held.match(number, diagonal, places, lambda i: data[first[i] : last[i]].tobytes().lower())
                        if got and (got[0] >= share or got[1] >= run):
                            old = rest.get(number)
                            rest[number] = max(old, (got[0], got[1], got[3])) if old else (got[0], got[1], got[3])
                    mine = (sorted({*before[0][k], *(held.ids[n] for n in rest)}), max([before[1][k], *(v[0] for v in rest.values())]), max([before[2][k], *(v[1] for v in rest.values())]), before[3][k] or any(v[2] for v in rest.values()), before[4][k] or bool(rest))
                    for x, v in zip(out, mine, strict=True):
                        x.append(v)
                kept = [part.column(i) for i in range(part.num_columns - 5)]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(x, t) for x, t in zip(out, kinds, strict=True)], part.schema.names)

    return task


def flag_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE, run: int = RUN, block: int = BLOCK_ITEMS, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with items (benchmark ids), coverage, longest_run, reparameterised, contaminated
    (replacing columns of these names).  One scan of ``docs``, through one step for each block of the benchmark."""
    spark = small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in {x.split()[0] for x in FOUND.split(", ")}]
    none = [F.array().cast("array<long>").alias("items"), F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("longest_run"), F.lit(False).alias("reparameterised"), F.lit(False).alias("contaminated")]
    out = docs.select(*[F.col(f"`{c}`") for c in names], *none)
    kind = ", ".join(f"`{c}` {t}" for c, t in out.dtypes[:-5]) + ", " + FOUND
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n = max(1, -(-items.count() // block))
    for k in range(n):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text")
        index = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in mine.collect()], width))  # a block of about ``block`` items
        out = out.mapInArrow(_scan(index, share, run, names.index(text_col)), kind)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE, run: int = RUN, block: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, items, coverage, longest_run, reparameterised, contaminated of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return flag_contamination(docs, benchmark, width, share, run, block).drop("text")
