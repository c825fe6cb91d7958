"""Minimal perfect hashing of 64-bit keys, in numpy."""

from __future__ import annotations

import numpy as np

from cloudmill.llm.common import mixed

_STEP = 0xA0761D6478BD642F
_LEVELS = 64  # distinct keys part in far fewer


class PerfectHash:
    """Gives each of n distinct keys a slot of its own among 0 to n-1.

    Keys are thrown into a bit array twice as large as they are many; a bit stands where exactly
    one key fell, and the others go on to the next, smaller array with another hash. A key's slot
    is the number of bits before its own, over all arrays: about 3.3 bits a key. A key that was
    not among the n may get any slot, or -1: store something of the key to tell them apart.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        self._before = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(words), out=self._before[1:], dtype=np.int64)

    def __len__(self) -> int:
        return int(self._before[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left = np.asarray(keys, dtype=np.uint64)
        sizes, parts = [], []
        while len(left):
            if len(sizes) == _LEVELS:
                raise ValueError("the keys are not distinct")
            size = -(-2 * len(left) // 64) * 64
            at = _places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        words = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        return cls(np.array(sizes, dtype=np.int64), words)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, dtype=np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _places(keys[left], level, size)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            held = self.words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self._before[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
            base += size >> 6
        return out

    def to_bytes(self) -> bytes:
        head = np.concatenate(([len(self.sizes)], self.sizes)).astype("<i8")
        return head.tobytes() + self.words.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        levels = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", levels, 8)
        return cls(sizes, np.frombuffer(data, "<u8", offset=8 * (levels + 1)))


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((level + 1) * _STEP % 2**64)
    return (mixed(keys + step) % np.uint64(size)).astype(np.int64)
