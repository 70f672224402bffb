"""Vectorised word hashes and 5-word shingle sets over Arrow text columns."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LONG = 1 << 16
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  not in every C library
except (OSError, AttributeError):
    _LIBC = None
_CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * U(pow(base, k, 1 << 64))
        k *= 2
    return out


_POW, _INV = _powers(_BASE, _CHUNK + _LONG), _powers(_INVERSE, _CHUNK + _LONG)
#: One odd multiplier for each place in a shingle.
_PLACE = mix(np.arange(1, WORDS + 1, dtype=U)) | U(1)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each text (n + 1 numbers)."""
    inside = ~_SPACE[raw]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[at] = True
    begins = inside & fresh[:-1]
    begins[1:] |= inside[1:] & ~inside[:-1]
    ends = inside & fresh[1:]
    ends[:-1] |= inside[:-1] & ~inside[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, from polynomial prefix sums over pieces of about a megabyte."""
    out = np.empty(len(starts), U)
    i, n = 0, len(starts)
    while i < n:
        if ends[i] - starts[i] > _LONG:
            word = raw[starts[i] : ends[i]]
            out[i] = int.from_bytes(hashlib.blake2b((_LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        long = np.flatnonzero(ends[i:j] - starts[i:j] > _LONG)
        j = i + int(long[0]) if len(long) else j
        base, stop = starts[i], ends[j - 1]
        c = (_LOWER[raw[base:stop]] if lower else raw[base:stop]).astype(U)
        c += U(1)
        c *= _POW[: len(c)]
        p = np.zeros(len(c) + 1, U)
        np.cumsum(c, out=p[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((p[e] - p[s]) * _INV[s] + (e - s).astype(U))
        i = j
    return out


def shingle_sets(column) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its 5-word shingles, words with A-Z lower-cased.

    A text of one to four words has its whole sequence as the one shingle; a text without words has none."""
    raw, at = utf8(column)
    starts, ends, first = word_bounds(raw, at)
    w = word_hashes(raw, starts, ends)
    n = max(0, len(w) - WORDS + 1)
    s = np.zeros(n, U)
    for k in range(WORDS):
        s += w[k : k + n] * _PLACE[k]
    s = mix(s)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= WORDS:
            yield np.unique(s[a : b - WORDS + 1])
        elif b > a:
            yield mix(np.asarray([(w[a:b] * _PLACE[: b - a]).sum(dtype=U) + U(b - a)], U))
        else:
            yield np.zeros(0, U)


def _give_back() -> None:
    """Return freed memory to the system: workers are used again by later stages, beside each other."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, *texts: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about `limit` bytes of text, so that a kernel's memory does not follow the batch."""
    if batch.num_rows == 0:
        return
    size = np.zeros(batch.num_rows, np.int64)
    for t in texts:
        size += np.diff(utf8(batch.column(t))[1])
    group = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
    _give_back()
