"""Vectorised helpers over Arrow string columns, used inside Spark tasks.

Everything works on the UTF-8 bytes of a whole batch at once: words, lines and
shingles are never Python strings.  Words are ``[^\\x20\\x09-\\x0D]+`` throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: keeps the first n bytes of a little-endian 8-byte load
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: odd multipliers (fractional bits of the golden ratio and of square roots)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBB67AE8584CAA73B)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2 << 20, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of each slice hold about ``limit`` bytes (one row at least) in ``rows`` rows at most."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, at + rows)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; changes ``x`` in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each span, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    factor = np.uint64(MULTIPLIERS[seed])
    length = end - start
    h = length.astype(np.uint64) * factor + np.uint64(seed)
    rows, at, left = slice(None), start, length
    while len(at):
        x = loads[at] & KEEP[np.minimum(left, 8)]
        x = (h[rows] ^ x) * factor
        h[rows] = x ^ (x >> np.uint64(29))
        more = np.flatnonzero(left > 8)
        rows = more if isinstance(rows, slice) else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return mix(h)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    solid = ~SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = solid[heads]
    end = solid
    end[:-1] &= ~solid[1:] | start[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes."""
    n = max(0, len(h) - size + 1)
    out = h[:n].copy()
    for i in range(1, size):
        out *= np.uint64(MULTIPLIERS[0])
        out += h[i : n + i]
        out ^= out >> np.uint64(32)
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, whole_if_short: bool = True) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each row.

    A row with fewer words has its whole word sequence as its only shingle, or none
    without ``whole_if_short``; a row without words has none.
    """
    s, e, first = words(data, offsets)
    h = span_hashes(data, s, e)
    full = rolled(h, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(full[a : b - size + 1])
        elif b > a and whole_if_short:
            yield rolled(h[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
