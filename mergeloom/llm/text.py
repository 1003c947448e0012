"""Words of whole texts in numpy, straight from Arrow's string buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def trim() -> None:
    """Give freed memory back to the system, where the C library can: workers live on after a task, the driver after a model."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable) -> Callable:
    """A function over a task's batches that gives its memory back at the end."""

    def to_the_end(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return to_the_end


#: White space that ends a word: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MULT
        return h ^ (h >> np.uint64(29))


class RollingHash:
    """Hashes of any byte ranges of one buffer, after a single pass."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[: len(data)])))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


class Texts:
    """Some whole texts: their bytes, where each begins, and their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        word = ~space[data]
        before = np.concatenate((np.zeros(1, bool), word[:-1])) & ~edge[:-1] if len(data) else word
        after = np.concatenate((word[1:], np.zeros(1, bool))) & ~edge[1:] if len(data) else word
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        #: words of text i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, offsets)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, an occurrence) of each distinct word, and which of them each word is."""
        hashes = RollingHash(self.data)(self.start, self.end)
        return np.unique(hashes, return_index=True, return_inverse=True)

    def __len__(self) -> int:
        return len(self.offsets) - 1


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: bytes = b"", after: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of data one after another, each between before and after; and where each begins."""
    length = end - start + len(before) + len(after)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
    if not len(start):
        return np.zeros(0, np.uint8), offsets
    at = np.repeat(start - len(before) - offsets[:-1], length) + np.arange(offsets[-1])
    out = data[np.clip(at, 0, len(data) - 1)]
    for i, b in enumerate(before):
        out[offsets[:-1] + i] = b
    for i, b in enumerate(after[::-1]):
        out[offsets[1:] - 1 - i] = b
    return out, offsets


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def chunks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of whole texts, of about most_bytes or one text."""
    offsets, data = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
