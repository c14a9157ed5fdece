"""Words and word hashes of many texts at once, over Arrow's own bytes.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, which in UTF-8 is the same as `[^\\x20\\x09-\\x0D]+`.
Its hash is a polynomial over its bytes modulo 2^64, mixed; equal words have equal hashes.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240611))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
BASE = int(_rng.integers(1 << 32, 1 << 62)) * 8 + 3
BASE_INVERSE = pow(BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def lean(work):
    """A task's generator of batches that gives the worker's freed memory back to the system when it ends; workers are used again and share their executor's memory."""

    @functools.wraps(work)
    def run(*args):
        try:
            yield from work(*args)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i up to n; kept, and made longer only for a longer text."""
    if len(_powers["up"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base & (2**64 - 1), U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits (splitmix64's finish)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each text starts (one more entry: the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if column.type == pa.large_string() else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `size` bytes; a longer text is a run."""
    data, at = raw(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        end = min(end, n)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


@dataclass
class Words:
    """Words of consecutive texts: where each begins and ends, its hash, and how many each text has."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    counts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Number of words before each text; one more entry: all."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end)."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U), np.zeros(len(at) - 1, np.int64))
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < n)]
    begins[cut] |= inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, span_hashes(data, start, end), np.diff(np.searchsorted(start, at)))


def shingles(words_: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words inside one text, and the text of each; texts with fewer words have none."""
    h, doc = words_.hash, words_.doc
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(n, U)
    for j in range(width):
        total = total * U(0x9FB21C651E98DF25) + h[j : j + n]
    inside = doc[:n] == doc[width - 1 :]
    return mix(total[inside]), doc[:n][inside]


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each character."""
    return (data & 0xC0) != 0x80


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]], also where a segment is empty."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]
