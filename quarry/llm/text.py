"""Vectorised primitives over Arrow string columns: bytes, words, 64-bit hashes.

All functions work on whole texts.  ``slices`` cuts a batch into runs of documents of about
``STEP`` bytes so that temporary arrays stay small; a longer document is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, STEP + (STEP >> 2))
        _pow = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE)]))
        _inv = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE_INV)]))
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of about ``step`` bytes each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + step, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums S of hashed bytes by position, so that S[e] - S[s], divided by the base's power s, hashes [s, e)."""
    pw, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * pw[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(sums))
    length = (end - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * inv[start] + length * MULT[63])


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^ \\t-\\r]+ of all documents, and the n + 1 offsets of each document's words."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1] | cut[1:-1]
    last = solid
    last = last.copy()
    last[:-1] &= space[1:] | cut[1:-1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def window_hash(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values; len(values) - width + 1 of them."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += values[k : k + n] * MULT[k]
    return mix(out)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles of lower-cased words, as ascending hashes, and the n + 1 offsets of the sets.

    A document of fewer words than ``width`` has its whole sequence as the one shingle; one without words has none.
    """
    n = len(off) - 1
    data = LOWER[data]
    start, end, wo = words(data, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = span_hash(prefix_hash(data), start, end)
    count = np.diff(wo)
    doc = np.repeat(np.arange(n), count)
    full = window_hash(word, width)
    at = np.flatnonzero(wo[doc[: len(full)] + 1] - np.arange(len(full)) >= width) if len(full) else np.zeros(0, np.int64)
    hashes, owner = full[at], doc[at]
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        own = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            has = count[few] > k
            own[has] += word[wo[few[has]] + k] * MULT[32 + k]
        hashes = np.concatenate([hashes, mix(own + count[few].astype(np.uint64) * MULT[62])])
        owner = np.concatenate([owner, few])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def grouped_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over [off[i], off[i + 1]); empty runs give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "u" else np.int64), np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]
