"""Distinct strings of a column, and lists of ids that a task keeps by number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def distinct(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Which of the distinct values each one is, and these."""
    coded = values.dictionary_encode()
    names = coded.dictionary
    offsets = np.frombuffer(names.buffers()[1], dtype=np.int64)[names.offset : names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    if len(names) == 0 or (data == 0).any():
        return coded.indices.to_numpy(), names.to_pylist()
    # No value holds a zero: put between them, it lets all be decoded at once.
    whole = np.zeros(len(data) + len(names) - 1, dtype=np.uint8)
    held = np.ones(len(whole), dtype=bool)
    held[offsets[1:-1] - offsets[0] + np.arange(len(names) - 1)] = False
    whole[held] = data
    return coded.indices.to_numpy(), whole.tobytes().decode().split("\0")


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.held, self.size = np.zeros(1 << 12, dtype=dtype), 0

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(end, len(self.held)), dtype=self.held.dtype)])
        self.held[self.size : end] = values
        self.size = end


class IdLists:
    """Lists of ids, numbered as they are added."""

    def __init__(self, dtype):
        self.ids, self.first, self.count = Grown(dtype), Grown(np.int64), Grown(np.int64)

    def __len__(self) -> int:
        return self.first.size

    def add(self, ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The numbers of the lists that begin at ``first`` and have ``count`` of these ids."""
        numbers = len(self) + np.arange(len(first))
        self.first.add(self.ids.size + first)
        self.count.add(count)
        self.ids.add(ids)
        return numbers

    def add_each(self, lists: list[np.ndarray]) -> np.ndarray:
        count = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return self.add(np.concatenate(lists), np.cumsum(count) - count, count)

    def state(self) -> tuple[int, int]:
        return len(self), self.ids.size

    def back_to(self, state: tuple[int, int]) -> None:
        """Forgets what was added since this state."""
        self.first.size = self.count.size = state[0]
        self.ids.size = state[1]

    def given(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists' ids one after the other, and how many there are before each and in all."""
        count = self.count.held[numbers]
        ends = np.append(0, np.cumsum(count))
        at = np.arange(ends[-1]) + np.repeat(self.first.held[numbers] - ends[:-1], count)
        return self.ids.held[at], ends
