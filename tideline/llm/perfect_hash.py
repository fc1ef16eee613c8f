"""A minimal perfect hash of 64-bit keys, after Limasset et al. (2017): levels of bit
arrays, each with the keys that met no other there; a key's number is the rank of its bit."""

from __future__ import annotations

import numpy as np

from tideline.llm.shared import mix

GAMMA = 2
LEVELS = 40
SALT = 0x9E3779B97F4A7C15


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64(SALT * (level + 1) % (1 << 64))
    return (mix(keys + salt) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        """``bits``: all levels' bits as bytes; ``rest``: sorted keys left after the last level."""
        self.sizes, self.bits, self.rest = sizes, bits, rest
        flags = np.unpackbits(bits)
        self.flags = flags[: sum(sizes)]
        self.rank = np.concatenate([[0], np.cumsum(self.flags, dtype=np.int64)])
        self.base = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys of a perfect hash are distinct")
        left, sizes, levels = keys, [], []
        while len(left) and len(sizes) < LEVELS:
            size = max(64, GAMMA * len(left))
            slot = _slot(left, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = left[~alone[slot]]
        flags = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(sizes, np.packbits(flags), np.sort(left))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The key's number from 0 on. A key that wasn't built in gets -1 or any
        number, which is why its owner stores fingerprints."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.base[level] + _slot(keys[open_], level, size)
            hit = self.flags[at] == 1
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.rank[-1] + at[hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), len(self.bits), len(self.rest), *self.sizes], np.int64)
        return head.tobytes() + self.bits.tobytes() + self.rest.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[PerfectHash, int]:
        levels, bits, rest = np.frombuffer(data[:24], np.int64).tolist()
        a = 24 + 8 * levels
        sizes = np.frombuffer(data[24:a], np.int64).tolist()
        b = a + bits
        return cls(sizes, np.frombuffer(data[a:b], np.uint8), np.frombuffer(data[b : b + 8 * rest], np.uint64)), b + 8 * rest
