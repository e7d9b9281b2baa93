"""Whitespace words of whole text columns as 64-bit hashes, on Arrow buffers.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Both rules work on single bytes
of UTF-8, so a batch of texts is handled as one byte array without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at once, which bounds a worker's memory; a longer single text is still taken whole.
CHUNK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII bytes but letters and digits.
NO_LETTER = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_CODES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64)
_CODES[65:91] = _CODES[97:123]
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


class Words(NamedTuple):
    """Words of consecutive rows. Byte positions count from the first byte of ``data``."""

    data: np.ndarray  # uint8
    starts: np.ndarray  # of each word
    ends: np.ndarray
    hashes: np.ndarray  # uint64
    bounds: np.ndarray  # words of row r: bounds[r] to bounds[r + 1]
    rows: np.ndarray  # byte bounds of the rows
    sums: np.ndarray  # running hash of the bytes, for parts of words


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
        up[0] = down[0] = 1
        made = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n > 2 * CHUNK_BYTES:
            return made
        _powers = made
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and row bounds of groups of rows of about ``limit`` bytes."""
    data, at = text_buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def split_words(
    data: np.ndarray, rows: np.ndarray, breaks: tuple[np.ndarray, np.ndarray] | None = None, gaps: np.ndarray = SPACE
) -> Words:
    """Words of one chunk, parted by the bytes of class ``gaps``.

    ``breaks``: byte classes (a, b); a word also ends between a and b.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(rows), np.int64), rows, np.zeros(1, np.uint64))
    word = ~gaps[data]
    first = np.empty(n + 1, bool)
    first[0] = first[n] = True
    first[1:n] = ~word[:-1]
    first[rows] = True
    if breaks is not None:
        first[1:n] |= breaks[0][data[:-1]] & breaks[1][data[1:]]
    last = word.copy()
    last[:-1] &= first[1:n] | ~word[1:]
    starts = np.flatnonzero(word & first[:n])
    ends = np.flatnonzero(last) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Words(data, starts, ends, hashes, np.searchsorted(starts, rows), rows, sums)


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and their bounds per row.

    Row r has max(0, words - width + 1) of them, in order of position.
    """
    counts = np.maximum(np.diff(words.bounds) - width + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    total = len(words.hashes) - width + 1
    if total <= 0:
        return np.zeros(0, np.uint64), at
    joined = words.hashes[:total].copy()
    for k in range(1, width):
        joined = joined * _BASE + words.hashes[k : total + k]
    inside = np.repeat(words.bounds[:-1] - at[:-1], counts) + np.arange(at[-1])
    return mix(joined[inside]), at


def prefix_hashes(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Words longer than ``length`` bytes, by index, and the hashes of their first ``length`` bytes."""
    longer = np.flatnonzero(words.ends - words.starts > length)
    starts = words.starts[longer]
    down = _power_tables(len(words.data) + 1)[1]
    return longer, mix((words.sums[starts + length] - words.sums[starts]) * down[starts] + np.uint64(length))


def run_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of word hashes."""
    value = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            value = value * _BASE + h
    return mix(np.array([value], np.uint64))[0]
