"""Words and word shingles of whole texts as 64-bit numbers, for Arrow batches.

Words are runs of bytes other than space and 0x09-0x0D; only A-Z are lower-cased.
A set of shingles is the distinct runs of ``k`` words; a text with fewer words is
one shingle, a text without words has none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: Bytes of text turned into arrays at once: what is held is a small multiple of it.
CHUNK = 1 << 20


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j modulo 2**64 for j up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 2)
        for i, base in enumerate((BASE, INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each value; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes; a longer document stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, for functions that hold several copies of a batch."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and for each document where its words begin (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    solid = ~SPACE[low]
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    after[inner[inner > 0] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


def shingles_of(words: np.ndarray, begin: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its shingles."""
    factors = odd_numbers(k, 5)
    runs = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        runs += words[j : j + len(runs)] * factors[j]
    runs = mix(runs)
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif n:
            out.append(mix((words[a:b] * factors[:n]).sum(keepdims=True) + np.uint64(n * int(BASE) % 2**64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(column: pa.Array | pa.ChunkedArray, k: int = 5) -> Iterator[np.ndarray]:
    """The shingle set of each text of a column, in order."""
    data, offsets = utf8(column)
    for a, b in chunks(offsets):
        own = offsets[a : b + 1]
        yield from shingles_of(*words_of(data[own[0] : own[-1]], own - own[0]), k)
