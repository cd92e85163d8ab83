"""Whole texts as flat byte buffers: the NumPy layer below the Arrow operators.

Texts of an Arrow batch are handled in blocks of about ``BLOCK_BYTES``, so memory follows the block
or the longest single text, never the batch or the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000
_RNG = np.random.default_rng(20240607)
#: A random odd multiplier and a random value for each byte: the digest of a string is a polynomial in them.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def release_memory() -> None:
    """Give freed memory of this worker back, so that idle workers hold little beside the next task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def released(run: Callable) -> Callable:
    """A function on Arrow batches that gives memory back at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        made = np.full(max(n, BLOCK_BYTES), _BASE if kind == "base" else _INVERSE, np.uint64)
        made[0] = 1
        _powers[kind] = np.multiply.accumulate(made)
    return _powers[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one byte buffer and row offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, at


def fixed_rows(column: pa.Array, kind: type) -> np.ndarray:
    """A binary column whose rows have equal sizes as a matrix."""
    flat, at = column_bytes(column)
    return np.ascontiguousarray(flat[at[0] : at[-1]]).view(kind).reshape(len(at) - 1, -1)


def blocks(at: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that cover all rows, each of at most ``most`` bytes or a single row."""
    row, n = 0, len(at) - 1
    while row < n:
        end = int(np.searchsorted(at, at[row] + most, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


def lower(flat: np.ndarray) -> np.ndarray:
    return _LOWER[flat]


def spans(flat: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a class, within rows: starts, ends, and for each row the first run (n+1 values)."""
    on = np.zeros(len(flat) + 1, np.int8)
    on[:-1] = inside[flat]
    edge = np.diff(on, prepend=np.int8(0))
    starts, ends = edge == 1, edge == -1
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(flat))]
    cuts = cuts[(on[cuts] == 1) & (on[cuts - 1] == 1)]
    starts[cuts] = True
    ends[cuts] = True
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    return s, e, np.searchsorted(s, at)


def prefix_digests(flat: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``range_digests`` takes the digest of any byte range."""
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * _power("base", len(flat))[: len(flat)], out=sums[1:])
    return sums


def range_digests(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of byte ranges: equal strings, equal digests, wherever they stand."""
    inverse = _power("inverse", len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def words(flat: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests, starts and ends of the A-Z lower-cased words, and for each row its first word (n+1 values)."""
    flat = lower(flat)
    s, e, first = spans(flat, at, inside)
    return range_digests(prefix_digests(flat), s, e), s, e, first


def shingles(digests: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all runs of ``width`` words within rows, and for each row the first (n+1 values).

    A row of fewer words, but one at least, has its whole sequence as its only shingle.
    """
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out_first = np.concatenate(([0], np.cumsum(made)))
    row = np.repeat(np.arange(len(counts)), made)
    at = first[:-1][row] + np.arange(out_first[-1]) - out_first[:-1][row]
    size = np.minimum(counts, width)[row]
    acc = size.astype(np.uint64)
    for k in range(width):
        full = k < size
        step = digests[np.where(full, at + k, 0)] if len(digests) else np.zeros(0, np.uint64)
        acc = np.where(full, mix(acc * _BASE + step), acc)
    return acc, out_first


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments; an empty segment has 0."""
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return sums[first[1:]] - sums[first[:-1]]
