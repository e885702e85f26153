"""Vectorised UTF-8 text primitives shared by the Arrow operators.

Texts arrive as Arrow string columns; everything here works on the raw UTF-8 bytes with numpy.  Words
are maximal runs of bytes outside a separator class; the default class is ``[\\x20\\x09-\\x0D]``, all
single bytes in UTF-8, so byte runs and character runs agree.  Span hashes are polynomial prefix
hashes modulo 2**64 followed by a finaliser; they are evaluated in segments so that memory follows
the segment size and the number of words, not eight times the length of the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xA0761D6478BD642F)
_GRAM_INV = np.uint64(pow(int(_GRAM), -1, 1 << 64))

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
NON_LETTERS = np.ones(256, bool)
NON_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
PLAIN = np.arange(256, dtype=np.uint8)
LOWER = PLAIN.copy()
LOWER[0x41:0x5B] += 32
CHAR_START = (PLAIN & 0xC0) != 0x80


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, SEGMENT + 1), _powers(_BASE_INV, SEGMENT + 1)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``limit`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; a word never crosses two texts."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inner = offsets[(offsets > 0) & (offsets < n)]
    starts, ends = [], []
    for a in range(0, n, SEGMENT):
        b = min(a + SEGMENT, n)
        here = ~separators[data[max(a - 1, 0) : min(b + 1, n)]]
        if a == 0:
            here = np.concatenate([[False], here])
        if b == n:
            here = np.concatenate([here, [False]])
        mid = here[1:-1]
        before, after = here[:-2].copy(), here[2:].copy()
        lo, hi = np.searchsorted(inner, [a, b])
        before[inner[lo:hi] - a] = False
        lo, hi = np.searchsorted(inner, [a + 1, b + 1])
        after[inner[lo:hi] - 1 - a] = False
        starts.append(np.flatnonzero(mid & ~before) + a)
        ends.append(np.flatnonzero(mid & ~after) + a + 1)
    first, last = np.concatenate(starts), np.concatenate(ends)
    return first, last, np.searchsorted(offsets, first, "right") - 1


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, fold: np.ndarray = PLAIN) -> np.ndarray:
    """Hash of every span ``data[first:last]``; spans are sorted and do not overlap."""
    table = _BYTE[fold]
    n, carry = len(data), np.uint64(0)
    low, high, inverse = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64), np.ones(len(first), np.uint64)
    scale, unscale = np.uint64(1), np.uint64(1)
    sums = np.empty(SEGMENT + 1, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, max(n, 1), SEGMENT):
            b = min(a + SEGMENT, n)
            sums[0] = carry
            np.cumsum(table[data[a:b]] * _POW[: b - a], out=sums[1 : b - a + 1])
            sums[1 : b - a + 1] *= scale
            sums[1 : b - a + 1] += carry
            i, j = np.searchsorted(first, [a, b]) if b < n else (np.searchsorted(first, a), len(first))
            at = first[i:j] - a
            low[i:j], inverse[i:j] = sums[at], _INV[at] * unscale
            i, j = np.searchsorted(last, [a + 1, b + 1])
            high[i:j] = sums[last[i:j] - a]
            if a == 0:
                i, j = 0, np.searchsorted(last, 1)
                high[i:j] = sums[0]
            carry = sums[b - a]
            scale, unscale = scale * _POW[SEGMENT], unscale * _INV[SEGMENT]
        return mix((high - low) * inverse + (last - first).astype(np.uint64) * _ODD)


def prefix_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, sizes: tuple[int, ...], fold: np.ndarray = PLAIN) -> list[np.ndarray]:
    """Hashes of the first ``size`` bytes of every span, for each size; shorter spans count whole."""
    return [span_hashes(data, first, np.minimum(last, first + k), fold) for k in sizes]


def char_counts(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Code points of every span; spans are sorted and do not overlap."""
    rest = np.flatnonzero(~CHAR_START[data])
    if not len(rest):
        return last - first
    return (last - first) - (np.searchsorted(rest, last) - np.searchsorted(rest, first))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every window of ``n`` consecutive words (windows may cross texts: mask them)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m] * np.uint64(n)
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = out * _GRAM + hashes[k : k + m]
    return mix(out)


def windows(doc: np.ndarray, n: int) -> np.ndarray:
    """Which windows of ``n`` words lie in one text."""
    m = len(doc) - n + 1
    return doc[:m] == doc[n - 1 :] if m > 0 else np.zeros(0, bool)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        hit = np.zeros(len(keys), bool)
        hit[1:] = same
        hit[:-1] |= same
        out[order] = hit
    return out


def earlier(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier key."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def within(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that agree only for equal hashes of one text."""
    with np.errstate(over="ignore"):
        return mix(hashes + mix(doc.astype(np.uint64) * _ODD + np.uint64(1)))


def per_text(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of integer weights (or a count) of each text, exactly."""
    if weights is None:
        return np.bincount(doc, minlength=n).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
    edge = np.searchsorted(doc, np.arange(n + 1))
    return sums[edge[1:]] - sums[edge[:-1]]


def text_slice(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts ``i`` to ``j``."""
    return data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def release() -> None:
    """Give memory that is no longer used back to the system; a worker that waits then holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
