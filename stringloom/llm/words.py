"""Words of whole texts as numpy arrays: positions, 64-bit hashes and hashes of word windows.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. All functions work on one Arrow batch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NOT_LETTERS = np.zeros(256, dtype=bool)
_NOT_LETTERS[[c for c in range(128) if not chr(c).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.default_rng(20240607)
_TABLE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PIECE = 1 << 21
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown as needed."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        size = max(1024, 1 << int(n).bit_length())
        known = np.ones(size, dtype=np.uint64)
        known[1:] = base
        known = np.multiply.accumulate(known)
        _powers[int(base)] = known
    return known[:n]


class Words:
    """Word positions of a string column. Word ``i`` is ``data[starts[i]:ends[i]]``; row ``r`` has words ``first[r]:first[r + 1]``."""

    def __init__(self, column: pa.Array, lower: bool = False, letters_only: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        if column.offset:
            column = pa.concat_arrays([column])
        _, offsets, data = column.buffers()
        n = len(column)
        self.offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
        begin, end = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(data, dtype=np.uint8)[begin:end] if end > begin else np.zeros(0, np.uint8)
        self.offsets = self.offsets - begin
        if lower:
            self.data = LOWER[self.data]
        inside = ~(_NOT_LETTERS if letters_only else _SPACES)[self.data]
        previous = np.empty_like(inside)
        following = np.empty_like(inside)
        if len(inside):
            previous[0], previous[1:] = False, inside[:-1]
            following[-1], following[:-1] = False, inside[1:]
            edges = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
            previous[edges] = False
            following[edges - 1] = False
        self.starts = np.flatnonzero(inside & ~previous)
        self.ends = np.flatnonzero(inside & ~following) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.rows = n

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def character(self, at: np.ndarray, rows: list[int] | np.ndarray) -> list[int]:
        """Code-point positions within their rows of byte positions ``at``."""
        begin = self.offsets[np.asarray(rows, dtype=np.int64)]
        return [int(((self.data[a:b] & 0xC0) != 0x80).sum()) for a, b in zip(begin, at)]

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word; equal words have equal hashes in every batch and task."""
        out = np.empty(len(self), dtype=np.uint64)
        total = np.cumsum(self.ends - self.starts)
        begin = 0
        while begin < len(self):
            done = total[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(total, done + _PIECE, side="right")))
            out[begin:stop] = _span_hashes(self.data, self.starts[begin:stop], self.ends[begin:stop])
            begin = stop
        return out


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = _TABLE[data[place + np.repeat(starts, sizes)]]
    values *= powers(_BASE, int(sizes.max()))[place]
    return mixed(np.add.reduceat(values, first) + sizes.astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on; windows that cross rows are the caller's to leave out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(_BASE, len(words)), out=sums[1:])
    out = (sums[width:] - sums[:n]) * powers(_INVERSE, n)
    return mixed(out + np.uint64(width))


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence; differs from a window hash of another width."""
    total = (words * powers(_BASE, len(words))).sum(dtype=np.uint64)
    return mixed(np.array([total + np.uint64(len(words))], dtype=np.uint64))[0]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
