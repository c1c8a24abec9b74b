"""Toxicity scores from a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned: stems (word beginnings) that labelled toxic documents have and clean ones lack.  Each word whose
bytes could be within one edit of a stem (one half of the stem stands unchanged, at most two bytes displaced) is run as a
Levenshtein automaton against the trie of stems; a stem is found when some beginning of the word is within the distance.
Stems shorter than five characters must match exactly, and words that clean labelled documents contain are no
misspellings.  A window of words around each hit and the quote marks open on its line tell quotation from abuse; the window
also measures density.  A logistic model over these hits, fitted on the same bounded sample, gives the score: what quoted
and unquoted hits weigh is learned.

Defined results: null and empty texts have no hits and get the score of a text without hits; very long ones are read whole,
slice by slice.  Rows with a null or repeated id are scored like all others; of rows that repeat an id one is learned from,
and of repeated labels the largest counts.  Of stems that tie the longest is named.  Without labels of both kinds the lexicon
is empty and every score 0.  Columns other than id and text are not read, so clashing names do no harm.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import hashing
from strandline.llm.learning import fit_logistic, labelled_sample
from strandline.llm.storage import Workspace, small_batches

#: Labelled documents that the model is learned from, at most.  Lexicon and clean words are whatever these yield.
TRAIN_LIMIT = 8_000
AROUND = 5
REPORTING = frozenset("said says wrote writes quoted quote quoting called replied reported sagte schrieb dit écrit dijo escribió".split())
_PARTS = np.zeros(256, bool)
_PARTS[list(range(0x21)) + [ord(c) for c in ".,;:!?()[]{}\"#%&*|<>=/\\`~^+"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals made small, bytes in place."""
    out = _LOWER[data]
    if len(out) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][latin] += 0x20
    return out


class Trie:
    def __init__(self, stems: Iterable[str]):
        self.root: dict = {}
        for stem in stems:
            node = self.root
            for c in stem:
                node = node.setdefault(c, {})
            node[""] = stem

    def matches(self, word: str, edits: int = 1, exact_below: int = 5) -> tuple[str, int] | None:
        """The stem with fewest edits (then longest) that a beginning of the word comes to, walking trie and automaton together.

        A state of the word's automaton is the row of edits spent for each number of its characters read."""
        best: tuple[int, int, str] | None = None
        stack = [(self.root, tuple(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            for c, below in node.items():
                if c == "":
                    spent = min(row)
                    allowed = 0 if len(below) < exact_below else edits
                    if spent <= allowed and (best is None or (spent, -len(below)) < best[:2]):
                        best = (spent, -len(below), below)
                    continue
                new = [row[0] + 1]
                for i, w in enumerate(word, 1):
                    new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (w != c)))
                if min(new) <= edits:
                    stack.append((below, tuple(new)))
        return None if best is None else (best[2], best[0])


class Screen:
    """Which words may be near a stem: hashes of the stems' halves, then, where the word begins in ASCII, the bytes around the
    first difference.  Never misses a word within an edit of a stem."""

    def __init__(self, stems: Iterable[str]):
        found: dict[tuple[int, int], dict[int, set[bytes]]] = {}
        self.exact: set[bytes] = set()
        for stem in stems:
            raw = stem.encode()
            cut = len(raw) if len(stem) < 5 else len(raw) // 2
            if cut == len(raw):
                self.exact.add(raw)
            for offset, piece in [(0, raw[:cut])] + [(cut + shift, raw[cut:]) for shift in range(-2, 3) if cut < len(raw) and cut + shift >= 0]:
                found.setdefault((offset, len(piece)), {}).setdefault(self._one(piece), set()).add(raw)
        self.checks = {k: (np.array(sorted(v), np.uint64), [sorted(v[h]) for h in sorted(v)]) for k, v in found.items()}

    @staticmethod
    def _one(raw: bytes) -> int:
        data = np.frombuffer(raw, np.uint8)
        return int((hashing._BYTE[data] * hashing._POW[: len(data)]).sum(dtype=np.uint64))

    def _near(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, stem: bytes) -> np.ndarray:
        """Of words known by start and size: begins within an edit of the stem, or has other than ASCII there."""
        if stem in self.exact:
            return np.ones(len(start), bool)
        s, n = np.frombuffer(stem, np.uint8), len(stem)
        place = np.arange(n + 1)
        w = np.where(place < size[:, None], data[np.minimum(start[:, None] + place, len(data) - 1)], 0)
        ends_well = lambda same: np.hstack([np.logical_and.accumulate(same[:, ::-1], axis=1)[:, ::-1], np.ones((len(same), 1), bool)])
        same = w[:, :n] == s
        first = np.where(same.all(1), n, same.argmin(1))
        row = np.arange(len(w))
        kept, more, less = ends_well(same), ends_well(w[:, 1:] == s), ends_well(w[:, : n - 1] == s[1:])
        after = np.minimum(first + 1, n)
        return (w >= 0x80).any(1) | (first >= n - 1) | kept[row, after] | more[row, np.minimum(first, n)] | less[row, np.minimum(first, n - 1)]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the words that may match."""
        out = np.zeros(len(starts), bool)
        at = 0
        while at < len(starts):
            lo = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, lo + hashing.PIECE, "right")))
            hi = min(int(ends[to - 1]), lo + len(hashing._POW))
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(hashing._BYTE[data[lo:hi]] * hashing._POW[: hi - lo], out=sums[1:])
            s, size = starts[at:to] - lo, np.minimum(ends[at:to], hi) - starts[at:to]
            for (offset, length), (wanted, stems) in self.checks.items():
                on = np.flatnonzero(size >= offset + length)
                a = s[on] + offset
                h = (sums[a + length] - sums[a]) * hashing._INV[a]
                where = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                hit = wanted[where] == h
                on, where = on[hit], where[hit]
                for k in np.unique(where):
                    mine = on[where == k]
                    for stem in stems[k]:
                        out[at + mine[self._near(data, starts[at + mine], size[mine], stem)]] = True
            at = to
        return np.flatnonzero(out)


def _words(part: pa.RecordBatch):
    data, offsets = hashing.raw(part.column(part.schema.get_field_index("text")))
    low = lowered(data)
    starts, ends, rows = hashing.bounds(low, offsets, _PARTS)
    return data, low, offsets, starts, ends, rows


class Quotes:
    """Whether a place lies in quotation: an odd number of straight marks, or more opening than closing ones, since the line began."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.counts = data, offsets, None

    def _marks(self, mark: bytes) -> np.ndarray:
        """How many marks end before each place."""
        hit = np.ones(max(0, len(self.data) - len(mark) + 1), bool)
        for i, b in enumerate(mark):
            hit &= self.data[i : len(hit) + i] == b
        return np.concatenate([np.zeros(len(mark), np.int32), np.cumsum(hit, dtype=np.int32)])

    def __call__(self, row: int, at: int) -> bool:
        if self.counts is None:  # only where a slice has hits
            self.counts = [self._marks(m.encode()) for m in ('"', "“", "”", "«", "»")]
            self.lines = np.flatnonzero(self.data == 10)
        k = int(np.searchsorted(self.lines, at))
        begin = max(int(self.offsets[row]), int(self.lines[k - 1]) + 1 if k else 0)
        plain, a, b, c, d = (int(x[at] - x[begin]) for x in self.counts)
        return plain % 2 == 1 or a > b or c > d


def hit_features(part: pa.RecordBatch, trie: Trie, screen: Screen, clean: frozenset[str], worths: dict[str, float], memo: dict) -> tuple[np.ndarray, list[list]]:
    """For each row: log hits outside and inside quotation, largest density of a window; and the hits themselves."""
    data, low, offsets, starts, ends, rows = _words(part)
    out, hits = np.zeros((part.num_rows, 3)), [[] for _ in range(part.num_rows)]
    if not len(starts) or not trie.root:
        return out, hits
    quotes = Quotes(data, offsets)
    if len(memo) > 500_000:
        memo.clear()
    for i in screen(low, starts, ends).tolist():
        raw = low[starts[i] : min(ends[i], starts[i] + 64)].tobytes()
        if raw not in memo:
            word = raw.decode(errors="ignore")
            found = trie.matches(word)
            memo[raw] = None if found and found[1] and word in clean else found
        if (found := memo[raw]) is None:
            continue
        row = int(np.searchsorted(rows, i, "right")) - 1
        a, b = max(rows[row], i - AROUND), min(rows[row + 1], i + AROUND + 1)
        text = data[max(starts[a], int(offsets[row])) : ends[b - 1]].tobytes()
        quoted = quotes(row, int(starts[i])) or bool(REPORTING & {low[starts[j] : ends[j]].tobytes().decode(errors="ignore") for j in range(a, b)})
        hits[row].append((i, found[0], found[1], quoted, len(text)))
    for row, mine in enumerate(hits):
        if mine:
            worth = np.array([worths[x[1]] * (1.0 if x[2] == 0 else 0.7) for x in mine])
            quoted = np.array([x[3] for x in mine])
            at = np.array([x[0] for x in mine])
            near = np.searchsorted(at, at + AROUND, "right") - np.searchsorted(at, at - AROUND)
            out[row] = np.log1p(worth[~quoted].sum()), np.log1p(worth[quoted].sum()), near.max() / (2 * AROUND + 1)
    return out, hits


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a word with a given beginning (3 to 12 characters)."""
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        y = batch.column(batch.schema.get_field_index("y")).to_pylist()
        at = 0
        for part in hashing.slices(batch):
            _, low, _, starts, ends, rows = _words(part)
            for k in range(part.num_rows):
                mine = {low[a:b].tobytes() for a, b in zip(starts[rows[k] : rows[k + 1]].tolist(), np.minimum(ends, starts + 48)[rows[k] : rows[k + 1]].tolist(), strict=True)}
                stems = set()
                for word in mine:
                    text = word.decode(errors="ignore")
                    stems.update(text[:n] for n in range(3, min(len(text), 12) + 1))
                counts[1 if y[at + k] else 0].update(stems)
            at += part.num_rows
        keys = list(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["stem", "toxic", "clean"])
        rest = [k for k in counts[0] if k not in counts[1]]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([counts[0][k] for k in rest], pa.int64())], ["stem", "toxic", "clean"])


def choose_stems(counts: pd.DataFrame, n_toxic: int, n_clean: int, least: float, ratio: float = 12.0) -> dict[str, float]:
    """Telling beginnings: neither so short that a longer one tells more, nor so long that a shorter one keeps the documents.

    Each has its worth, the log of how much oftener toxic documents have it than clean ones can, in units of log 300."""
    toxic, clean = (dict(zip(counts["stem"], counts[c], strict=True)) for c in ("toxic", "clean"))
    below: dict[str, list[str]] = {}
    for s in toxic:
        below.setdefault(s[:-1], []).append(s)
    odds = lambda s: toxic[s] / max(1, n_toxic) * max(1, n_clean) / (clean[s] + 3)  # noqa: E731  3: what none seen leaves possible
    tells = lambda s: toxic[s] >= least and odds(s) >= ratio
    value = lambda s: toxic[s] * np.log(max(1.0, odds(s)))
    out, stack = [], [s for s in toxic if len(s) == 3]
    while stack:
        s = stack.pop()
        if tells(s) and all(value(x) <= value(s) for x in below.get(s, ())):
            while longer := [x for x in below.get(s, ()) if toxic[x] >= 0.95 * toxic[s]]:
                s = max(longer, key=lambda x: (toxic[x], x))
            out.append(s)
        else:
            stack += below.get(s, ())
    return {s: float(np.log(odds(s)) / np.log(300)) for s in sorted(set(out))}


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, limit: int = TRAIN_LIMIT) -> dict:
    """The lexicon, the clean words near it and the weights, from labelled documents outside the held-out fold."""
    sample = Workspace(docs.sparkSession, "toxicity").keep(labelled_sample(docs, labels, "toxic", folds, held, limit), "sample")
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = {"stems": {}, "clean": frozenset(), "weights": np.array([0.0, 0.0, 0.0, -40.0])}
    if not size.get(0) or not size.get(1):
        return model
    # Common stems first; then those of toxic documents without any, so that copies of covered ones lend no words.
    stems: dict[str, float] = {}
    for share in (0.05, 0.015):
        rest, least = sample, max(4, share * size[1])
        if stems:
            rest = score_features(sample.withColumn("t", F.col("text")), model | {"stems": stems}).where("y = 0 or size(filter(hits, h -> h.edits = 0)) = 0").select(F.col("t").alias("text"), "y")
        counts = rest.select("text", "y").mapInArrow(_beginnings, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        counts = counts.where(F.col("toxic") >= least)  # a bounded number for each word of a toxic document
        stems |= choose_stems(counts.toPandas(), size[1], size[0], least)
    trie, screen = Trie(stems), Screen(stems)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[str] = set()
            y = batch.column(batch.schema.get_field_index("y")).to_pylist()
            at = 0
            for part in hashing.slices(batch):
                _, low, _, starts, ends, rows = _words(part)
                for i in screen(low, starts, ends).tolist():
                    if not y[at + int(np.searchsorted(rows, i, "right")) - 1]:
                        word = low[starts[i] : min(ends[i], starts[i] + 64)].tobytes().decode(errors="ignore")
                        if word not in found and (m := trie.matches(word)) and m[1]:
                            found.add(word)
                at += part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    model |= {"stems": stems}
    if stems:
        model["clean"] = frozenset(r[0] for r in sample.mapInArrow(near, "word string").distinct().collect())  # of the sample
        rows = score_features(sample, model).select("f", "y").toPandas()
        x = np.array(rows["f"].tolist(), float).reshape(-1, 3)
        model["weights"] = fit_logistic(x, rows["y"].to_numpy(float), 0.05)
    return model


def score_features(docs: DataFrame, model: dict) -> DataFrame:
    """The rows with f (features) and hits (stem, edits, quoted); all columns are kept."""
    small_batches(docs.sparkSession)
    stems, clean = model["stems"], model["clean"]
    kind = pa.list_(pa.struct([("stem", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, screen, memo = Trie(stems), Screen(stems), {}
        for batch in batches:
            for part in hashing.slices(batch):
                f, hits = hit_features(part, trie, screen, clean, stems, memo)
                rest = [i for i, c in enumerate(part.schema.names) if c != "text"]
                found = [[{"stem": s, "edits": e, "quoted": q} for _, s, e, q, _ in row] for row in hits]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in rest] + [pa.array(f.tolist(), pa.list_(pa.float64())), pa.array(found, kind)], [part.schema.names[i] for i in rest] + ["f", "hits"])

    kept = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")
    return docs.mapInArrow(task, f"{kept}, f array<double>, hits array<struct<stem:string,edits:int,quoted:boolean>>")


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, hits of every row."""
    w = [float(x) for x in model["weights"]]
    z = F.col("f")[0] * w[0] + F.col("f")[1] * w[1] + F.col("f")[2] * w[2] + w[3]
    return score_features(docs.select("doc_id", "text"), model).select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), "hits")
