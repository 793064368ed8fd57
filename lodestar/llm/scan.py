"""Vectorised scans of Arrow text columns: bytes, words and hashes without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: True for the bytes that separate words: space, \t, \n, \v, \f, \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, off, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most `most` text bytes each; one longer row makes a run of its own."""
    _, off = text_bytes(batch.column(column))
    n, i = batch.num_rows, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 offsets of the rows' words."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, off)


def packed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words of the spans, which cover all of data but separators, as a binary array."""
    size = ends - starts
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    body = data[np.cumsum(inside[:-1], dtype=np.int8) > 0] if len(starts) else data[:0]
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(body))])


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word: equal ones for equal bytes and for no others."""
    return packed_words(data, starts, ends).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def run_numbers(words: np.ndarray, window: int) -> np.ndarray:
    """A number for the `window` words from each place: equal ones for equal runs and for no others.

    Numbers of runs of 1, 2, 4, ... words are paired and numbered anew, so nothing is hashed.
    """
    own, width = words, 1
    while width < window and len(own):
        step = min(width, window - width)
        if len(own) <= step:
            return own[:0]
        _, own = np.unique(own[:-step] * (int(own.max()) + 1) + own[step:], return_inverse=True)
        width += step
    return own


def powers(n: int, base: np.uint64, key: int) -> np.ndarray:
    p = _powers.get(key)
    if p is None or len(p) < n:
        p = np.full(max(n, 1 << 20), base, np.uint64)
        p[0] = 1
        _powers[key] = p = np.multiply.accumulate(p)
    return p[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, from prefix sums of a polynomial.

    Unequal words may share one, so it deals words out and decides no equality.
    """
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n + 1, _ODD, 0)[:n], out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * powers(n + 1, _INVERSE, 1)[starts] + (ends - starts).astype(np.uint64))
