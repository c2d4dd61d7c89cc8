"""Words of many texts at once, found and hashed with numpy on the Arrow buffer.

Words are ``[^\\x20\\x09-\\x0D]+``. A text's word hash depends on its bytes alone, so it is
the same in every task and every run. Null texts have no words, like empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit; changes ``h`` in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = (_powers(_MULTIPLIER, CHUNK_BYTES + 1), _powers(_INVERSE, CHUNK_BYTES + 1))


class Texts:
    """Some consecutive texts: bytes ``data``, text ``i`` at ``offsets[i]:offsets[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = solid[:-1]
            after[:-1] = solid[1:]
        #: First byte of each word, and the byte after its last one.
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.solid = solid
        #: Words of text i are first[i]:first[i + 1].
        self.first = np.searchsorted(self.starts, offsets)
        self._sums: dict[bool, np.ndarray] = {}

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def _powers(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data) + 1
        return _POWERS if n <= len(_POWERS[0]) else (_powers(_MULTIPLIER, n), _powers(_INVERSE, n))

    def spans(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the bytes in each span; ``lower`` folds A-Z."""
        up, down = self._powers()
        if lower not in self._sums:
            sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum((_LOWER if lower else _BYTES)[self.data] * up[: len(self.data)], out=sums[1:])
            self._sums[lower] = sums
        sums = self._sums[lower]
        return mix((sums[ends] - sums[starts]) * down[starts])

    def hashes(self, lower: bool = False) -> np.ndarray:
        return self.spans(self.starts, self.ends, lower)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``size`` words inside one text."""
        if len(hashes) < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        last = np.repeat(self.first[1:], self.counts)
        at = np.flatnonzero(np.arange(len(hashes)) + size <= last)
        out = hashes[at].copy()
        for j in range(1, size):
            out *= np.uint64(_MULTIPLIER)
            out += hashes[at + j]
            out ^= out >> np.uint64(31)
        return at, mix(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and text offsets; a null text gets no bytes."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)), offsets


def texts(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """The column in runs of at most ``chunk_bytes`` bytes, or of one longer text.

    Yields the first row, the row after the last one, and their texts.
    """
    data, offsets = buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1
        end = min(rows, max(end, row + 1))
        own = offsets[row : end + 1]
        yield row, end, Texts(data[own[0] : own[-1]], own - own[0])
        row = end


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets; 0 where there is nothing."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
