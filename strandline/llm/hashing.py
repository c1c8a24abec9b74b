"""Vectorised tokenising and hashing of whole texts inside Arrow tasks.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 keeps those bytes out of longer code points, so
byte-level splitting equals splitting of characters.  A word's hash is 64 bits, made from prefix sums modulo 2**64, so
that no Python loop runs over words; texts are worked through in pieces, which bounds memory whatever their length.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 2**64))
        have += more
    return out


_POW, _INV = _powers(_BASE, 2 * PIECE), _powers(_BASE_INV, 2 * PIECE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``limit`` text bytes, or of one row."""
    _, offsets = raw(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release_memory()


def release_memory() -> None:
    """Hands freed memory back, which workers that wait for their next task would keep."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off is not None else np.zeros(len(column) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's offset into them; between: which bytes part words."""
    space = between[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    if len(data):
        filled = offsets[:-1] < offsets[1:]
        begin, end = offsets[:-1][filled], offsets[1:][filled] - 1
        first[begin], last[end] = ~space[begin], ~space[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    table = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        hi = int(ends[to - 1])
        if hi - lo > len(_POW):
            word = data[lo:hi].tobytes()
            word = word.translate(_ASCII_LOWER) if lower else word
            out[at] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            at += 1
            continue
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * _POW[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * _INV[s] + (e - s).astype(np.uint64) * _STEP)
        at = to
    return out


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
_ASCII_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions are left out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    have, width, out, done = words * _STEP, 1, None, 0
    left = n
    while True:
        if left & 1:
            part = have[done : done + len(words) - n + 1]
            out = part.copy() if out is None else out * np.uint64(pow(_BASE, width, 2**64)) + part
            done += width
        left >>= 1
        if not left:
            return mix(out)
        have = have[: len(have) - width] * np.uint64(pow(_BASE, width, 2**64)) + have[width:]
        width *= 2


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    """An Arrow list column from joined values and row lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
