"""Minimal perfect hashing of 128-bit names with numpy.

A name is a pair of 64-bit lanes.  Level by level, names that are alone at
their hashed place keep it and the others go on; a name's slot is the number
of kept places before its own, so n names fill the slots 0 to n - 1 and no
name needs to be stored to find its slot.  The lanes are kept beside the slots
all the same: :meth:`Slots.find` compares them, so a name that was not among
the n is told apart (slot -1) instead of sharing a slot with another.
"""

from __future__ import annotations

import numpy as np

from lendlens.llm.blocks import mix

ROOM = 1.5  # places per name of a level


class Slots:
    def __init__(self, a: np.ndarray, b: np.ndarray):
        """``a`` and ``b``: the lanes of distinct names."""
        a, b = a.view(np.uint64), b.view(np.uint64)
        self.seed = 0
        while len(np.unique(self._key(a, b))) < len(a):  # two names look alike under this seed
            self.seed += 1
            if self.seed > 8:
                raise ValueError("the names are not distinct")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, done = self._key(a, b), 0
        while len(rest):
            at = self._place(rest, len(self.levels), max(1, int(len(rest) * ROOM)))
            alone = np.bincount(at, minlength=max(1, int(len(rest) * ROOM))) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + done))
            done += int(alone.sum())
            rest = rest[~alone[at]]
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        slot = self._slot(a, b)
        self.a[slot], self.b[slot] = a, b
        if not (np.array_equal(self.a[slot], a) and np.array_equal(self.b[slot], b)):
            raise ValueError("two names share a slot")

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(mix(a + np.uint64(self.seed)) + b)

    @staticmethod
    def _place(key: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(key + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key, slot, todo = self._key(a, b), np.full(len(a), -1), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(key[todo], level, len(alone))
            mine = alone[at]
            slot[todo[mine]] = rank[at[mine]]
            todo = todo[~mine]
        return slot

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each name, -1 for one that has none."""
        a, b = a.view(np.uint64), b.view(np.uint64)
        slot = self._slot(a, b)
        if not len(self.a):
            return slot
        return np.where((slot >= 0) & (self.a[slot] == a) & (self.b[slot] == b), slot, -1)
