"""Array kernels over the UTF-8 buffers of Arrow string columns: words, hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, start: int) -> np.ndarray:
    """``n`` odd 64-bit numbers derived from ``start``."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(start)) | _U(1)


_BYTE = seeds(256, 11)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(n, base, dtype=_U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(raw: np.ndarray, at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of whole texts of about ``size`` bytes."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each row) of all words ``[^\\x20\\x09-\\x0D]+``; no word crosses a row's border."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with ``lower``, A-Z count as a-z."""
    if not len(start):
        return np.empty(0, _U)
    size = 1 << max(20, (len(raw) - 1).bit_length())
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, dtype=_U)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * power[: len(raw)], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U))


def shingles(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all ``k``-word shingles row by row, shingles before each row).

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    count = np.diff(first)
    each = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    before = np.concatenate([[0], np.cumsum(each)])
    row = np.repeat(np.arange(len(count)), each)
    begin = first[:-1][row] + (np.arange(before[-1]) - before[:-1][row])
    length = np.minimum(count, k)[row]
    factor = seeds(k, 77)
    with np.errstate(over="ignore"):
        total = length.astype(_U) * _U(0xD6E8FEB86659FD93)
        for j in range(k):
            full = length > j
            if full.all():
                total += word[begin + j] * factor[j]
            else:
                total[full] += word[begin[full] + j] * factor[j]
        return mix(total), before


def shingle_sets(column: pa.Array | pa.ChunkedArray, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, its and the next rows' sorted distinct shingle hashes) for runs of rows."""
    raw, at = strings(column)
    for i, _, part, ends in chunks(raw, at):
        start, end, first = words(part, ends)
        found, before = shingles(word_hashes(part, start, end), first, k)
        yield i, [np.unique(found[a:b]) for a, b in zip(before[:-1], before[1:], strict=True)]
