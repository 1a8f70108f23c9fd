"""Word shingles of Arrow batches, as 64-bit hashes made with numpy.

Words are runs of characters other than the six ASCII spaces, with A-Z in lower
case. A text's set holds its distinct shingles of ``n`` words; a text of fewer
words has its whole sequence as its one shingle, a text without words none.
Shingles are told apart by a 64-bit hash of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P, _PI = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 2**64))
CHUNK = 1 << 19

_lower = np.arange(256, dtype=np.uint64)
_lower[65:91] += U(32)
_lower += U(1)
_space = np.zeros(256, dtype=bool)
_space[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, p in enumerate((_P, _PI)):
            steps = np.full(size, p, dtype=np.uint64)
            steps[0] = U(1)
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes together, at least one text each."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word; one entry more at the end)."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    solid = ~_space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1] | edge[1:-1])))
    ends = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True])) | edge[1:])) + 1
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_lower[data] * powers[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    data, offsets = text_buffers(column)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) * _P) | U(1)
    for a, b in chunks(offsets):
        words, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        whole = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
        for j in range(n):
            whole += words[j : j + len(whole)] * factors[j]
        whole = mix(whole)
        for k in range(b - a):
            s, e = int(first[k]), int(first[k + 1])
            if e - s >= n:
                own = np.sort(whole[s : e - n + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif e > s:
                yield mix((words[s:e] * factors[: e - s]).sum(keepdims=True) + U(e - s))
            else:
                yield np.zeros(0, dtype=np.uint64)
