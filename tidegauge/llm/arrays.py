"""Texts of an Arrow batch as numpy arrays: case-folded bytes, word positions, word hashes, word shingles.

A word is a run of ASCII letters, ASCII digits and non-ASCII bytes; letters count alike in either case (ASCII and Latin-1,
whose folding keeps every byte position).  Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes hashed at once; words are never cut
BATCH_BYTES = 1 << 19  # texts handled at once (one longer text is handled alone); what numpy works on stays in the cache

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES = {"n": 0}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _TABLES["n"] < n:
        size = max(n, SLICE + 4096)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _TABLES[name] = np.multiply.accumulate(steps)
        _TABLES["n"] = size
    return _TABLES["up"], _TABLES["down"]


def _word_bytes() -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[128:] = True
    for low, high in ((48, 58), (65, 91), (97, 123)):
        flags[low:high] = True
    return flags


WORD = _word_bytes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix generator: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets of the rows) of runs of rows of about ``limit`` bytes; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case, byte for byte: ASCII, and capital letters of Latin-1 (two bytes, the first is C3)."""
    out = LOWER[data]
    if len(out) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


class Words:
    """Words of consecutive rows: ``start``/``end`` byte positions, ``hash`` of each, ``row`` offsets into them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashes: bool = True):
        flags = np.zeros(len(data) + 2, np.int8)
        flags[1:-1] = WORD[data]
        change = np.diff(flags)
        start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        # a word ends where its row ends
        inner = offsets[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(data))])
        if len(inner):
            inner = inner[(flags[inner] == 1) & (flags[inner + 1] == 1)]
            start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
        self.start, self.end = start, end
        self.row = np.searchsorted(start, offsets)
        self.hash = self._hashes(fold(data)) if hashes else None

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.start), np.uint64)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(self.start):
                at = self.start[i]
                j = max(i + 1, int(np.searchsorted(self.end, at + SLICE, "right")))
                up, down = _tables(int(self.end[j - 1] - at))
                s, e = self.start[i:j] - at, self.end[i:j] - at
                sums = np.zeros(int(e[-1]) + 1, np.uint64)
                np.cumsum((data[at:at + e[-1]].astype(np.uint64) + np.uint64(1)) * up[:e[-1]], out=sums[1:])
                out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                i = j
        return mix(out)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside a row, and row offsets into them.

        A row of fewer than k words (but at least one) has one shingle, all its words."""
        rows, h = self.row, self.hash
        counts = np.diff(rows)
        n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
        offsets = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(rows[:-1] - offsets[:-1], n) + np.arange(offsets[-1])
        length = np.minimum(np.repeat(counts, n), k)
        out = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for step in range(k):
                live = length > step
                term = h[np.minimum(at + step, max(0, len(h) - 1))] if len(h) else out
                out = np.where(live, out * np.uint64(0x9FB21C651E98DF25) + mix(term + np.uint64(step + 1)), out)
        return mix(out), offsets


def distinct_per_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their row offsets."""
    if not len(values):
        return values, np.zeros(len(offsets), np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(np.bincount(rows[keep], minlength=len(offsets) - 1))])


def reduce_rows(op: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """``op`` over each row's values; rows without values get ``empty``."""
    n = np.diff(offsets)
    out = np.full(len(n), empty, values.dtype)
    full = n > 0
    if full.any():
        out[full] = op.reduceat(values, offsets[:-1][full])
    return out
