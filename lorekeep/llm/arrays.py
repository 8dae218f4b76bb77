"""NumPy views of Arrow text columns: words and their 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


_powers = np.ones(1, U)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        m = 1 << int(n - 1).bit_length()
        _powers = np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(m - 1, _BASE, U))))
    return _powers


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word `[^\\x20\\x09-\\x0D]+`, and the number of each row's first word (n + 1 of them).

    A row ends a word. Bytes are read in blocks that end where a word does, so memory follows the
    longest word and the number of words.
    """
    found, firsts, at = [], [], 0
    n = len(data)
    row_start = offsets[:-1]
    while at < n:
        end = min(n, at + block)
        while end < n and not (SPACE[data[end]] or row_start[np.searchsorted(row_start, end)] == end if np.searchsorted(row_start, end) < len(row_start) else SPACE[data[end]]):
            stop = min(n, end + block)
            blank = np.flatnonzero(SPACE[data[end:stop]])
            k = np.searchsorted(row_start, end)
            cut = int(row_start[k]) if k < len(row_start) else n
            end = min(end + int(blank[0]) if len(blank) else stop, cut)
        part = data[at:end]
        ink = ~SPACE[part]
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        inner = row_start[(row_start > at) & (row_start < end)] - at
        first[inner] = ink[inner]
        starts = np.flatnonzero(first)
        if len(starts):
            where = np.arange(starts[0], len(part))
            length = np.diff(np.append(starts, len(part)))
            where -= np.repeat(starts, length)
            value = _VALUE[LOWER[part[starts[0] :]] if lower else part[starts[0] :]]
            value *= _power(int(length.max()) + 1)[where]
            value[~ink[starts[0] :]] = 0
            found.append(mix(np.add.reduceat(value, starts - starts[0])))
            firsts.append(starts + at)
        at = end
    if not found:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    where = np.concatenate(firsts)
    return np.concatenate(found), np.searchsorted(where, offsets)
