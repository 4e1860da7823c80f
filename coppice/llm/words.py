"""Vectorised word and shingle hashing of Arrow string batches, used inside tasks only.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are 64-bit: a polynomial over the word's
bytes modulo 2**64 (the base is odd, so that a prefix difference can be shifted back exactly), then a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text handled at once; one longer document is handled alone.
CHUNK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers["up"]) < n:
        size = max(n, CHUNK + 4096)
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[key] = np.multiply.accumulate(full)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of runs of rows of about CHUNK bytes."""
    at, data = string_buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, side="right")) - 1)
        yield row, end, at[row : end + 1] - at[row], data[at[row] : at[end]]
        row = end


def spans(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each run of ``inside``; a run also ends where a document starts."""
    edge = np.empty(len(inside) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[starts] = True
    cuts = np.flatnonzero(edge)
    first, end = cuts[:-1], cuts[1:]
    keep = inside[first]
    return first[keep], end[keep]


def hash_spans(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[first]) * down[first])


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document (row of the chunk) of each word; A-Z count as a-z."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first, end = spans(~SPACE[data], at[:-1][at[:-1] < len(data)])
    return hash_spans(LOWER[data], first, end), np.searchsorted(at, first, side="right") - 1


def shingles(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its shingle hashes with repeats); fewer than k words make one shingle, none make none."""
    weights = mix(np.arange(1, k + 1, dtype=np.uint64) * BASE) | np.uint64(1)
    for row, end, at, data in chunks(column):
        hashes, doc = words(data, at)
        cut = np.searchsorted(doc, np.arange(end - row + 1))
        rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for i in range(k):
            rolled += hashes[i : i + len(rolled)] * weights[i]
        rolled = mix(rolled)
        for i in range(end - row):
            a, b = cut[i], cut[i + 1]
            if b - a >= k:
                yield row + i, rolled[a : b - k + 1]
            elif b > a:
                short = (hashes[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield row + i, mix(np.array([short], np.uint64))
            else:
                yield row + i, rolled[:0]
