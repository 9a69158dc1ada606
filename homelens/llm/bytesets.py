"""Vectorised work on Arrow text columns inside tasks: bytes, words and their 64-bit hashes.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
A word's hash is a polynomial in a fixed odd base over random byte values, taken from prefix sums, so
hashing costs a few passes over the bytes whatever the number of words. Polynomials modulo 2^64 have systematic
collisions among long words, so words over ``LONG`` bytes are hashed one by one with XXH3.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_RNG = np.random.default_rng(20240131)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LONG = 256
PIECE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, int(base)
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        step = step * step % 2**64
        done += more
    return out[:n]


@functools.lru_cache(maxsize=2)
def _short_powers(base: np.uint64) -> np.ndarray:
    return powers(base, PIECE)


def known_powers(base: np.uint64, n: int) -> np.ndarray:
    """``powers``, kept for the length of a piece."""
    return _short_powers(base)[:n] if n <= PIECE else powers(base, n)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows of about ``most`` bytes of text: (rows, bytes, offsets). One row is never cut."""
    if not batch.num_rows:
        return
    data, offsets = text_buffers(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, index of the first word of each row with the total last)."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    start[cut] |= inside[cut]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = cut[cut > 0] - 1
    stop[last] |= inside[last]
    first, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[LOWER[data] if lower else data] * known_powers(BASE, len(data)), out=sums[1:])
    back = known_powers(INVERSE, len(data))
    hashes = mix((sums[end] - sums[first]) * back[first])
    for k in np.flatnonzero(end - first > LONG).tolist():
        word = data[first[k] : end[k]]
        hashes[k] = xxhash.xxh3_64_intdigest((LOWER[word] if lower else word).tobytes())
    return hashes, np.searchsorted(first, offsets)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and their bounds; a row of fewer words is one shingle."""
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(ends[-1]) - ends[:-1][row] + bounds[:-1][row]
    out = np.full(len(at), 7, np.uint64)
    limit = bounds[1:][row]
    for k in range(width):
        here = at + k < limit
        nxt = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else np.zeros(0, np.uint64)
        out = np.where(here, mix(out * BASE + nxt), out)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[keep], row[keep]
    return out, np.searchsorted(row, np.arange(len(n) + 1))
