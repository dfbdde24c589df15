"""Word hashes of whole Arrow columns, in numpy.

A word is a run of bytes other than ASCII white space in the lower-cased text. Texts are taken in
slices of a few megabytes, so that memory does not follow the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS = 2 << 20, 1 << 14
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
VALUES[SPACE] = 0
LOW48 = np.uint64((1 << 48) - 1)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts, and the offsets of the rows in them; null is the empty text."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of at most SLICE_ROWS rows and `most` bytes, or of one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n, row + SLICE_ROWS)
        yield row, end
        row = end


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive rows, and the first word of each row (and, at last, the number of words)."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    begins = np.empty(len(data), bool)
    begins[0] = True
    begins[1:] = space[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins &= ~space
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    at = np.arange(len(data)) - np.repeat(np.concatenate(([0], starts)), np.concatenate(([starts[0]], lengths)))
    powers = np.multiply.accumulate(np.full(int(at.max()) + 1, BASE, np.uint64))
    hashes = mix(np.add.reduceat(VALUES[data] * powers[at], starts))
    return hashes, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of `k` words; a row of fewer words has one shingle of all, a row of none has none."""
    counts = np.diff(firsts)
    rows = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    place = np.arange(n) - firsts[:-1][rows]
    for j in range(k):
        # Words beyond the end of a short row count as nothing.
        inside = np.zeros(n, np.uint64)
        inside[: n - j] = words[j:] if j else words
        if j:
            inside[place + j >= counts[rows]] = 0
        out = mix(out + inside * BASE + np.uint64(j + 1))
    full = (place + k <= counts[rows]) | ((place == 0) & (counts[rows] < k))
    return out[full], rows[full]


def counted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row) with multiplicities, ordered by row; hashes are cut to 48 bits, so rows must be fewer than 2**16."""
    if not len(hashes):
        return hashes, rows, np.zeros(0, np.int64)
    key = np.sort((rows.astype(np.uint64) << np.uint64(48)) | (hashes & LOW48))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first] & LOW48, (key[first] >> np.uint64(48)).astype(np.int64), np.diff(np.append(first, len(key)))
