"""Words and word shingles of whole Arrow columns, as numpy arrays.

A word is a run of bytes other than the six ASCII white-space bytes, with A-Z lower-cased: on valid UTF-8 the
same as ``[^\\x20\\x09-\\x0D]+`` over code points. Words and shingles are represented by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    if len(column) == 0 or buffers[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(buffers[2], np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each; a longer row is a range by itself."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one chunk: each word's hash, its row, and its start and end in ``data``."""
    first, last = int(offsets[0]), int(offsets[-1])
    part, bounds = data[first:last], offsets - first
    n = len(part)
    if n == 0:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    word = ~_SPACE[part]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    powers, inverses = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts])
    return hashes, np.searchsorted(bounds, starts, "right") - 1, starts + first, ends + first


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Chunk by chunk the first row's number and each row's sorted distinct shingles of ``k`` words. A row with
    fewer words, but some, has its whole sequence as one shingle; a row without words has none."""
    data, offsets = string_buffers(column)
    odd = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    for i, j in chunks(offsets):
        hashes, rows, _, _ = word_hashes(data, offsets[i : j + 1])
        counts = np.bincount(rows, minlength=j - i)
        begin = np.concatenate(([0], np.cumsum(counts)))
        n = max(0, len(hashes) - k + 1)
        joined = np.zeros(n, np.uint64)
        for w in range(k):
            joined += mix(hashes[w : w + n] * odd[w])
        joined = mix(joined)
        sets = []
        for r in range(j - i):
            m = int(counts[r])
            if m >= k:
                own = np.sort(joined[begin[r] : begin[r] + m - k + 1])
                sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif m:
                short = sum((int(x) * int(c) for x, c in zip(hashes[begin[r] : begin[r] + m], odd)), m)
                sets.append(mix(np.array([short % (1 << 64)], np.uint64)))
            else:
                sets.append(np.empty(0, np.uint64))
        yield i, sets
