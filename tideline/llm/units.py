"""Texts cut into units that tokenizers encode by themselves, each unit encoded once.

Byte-level splitting always ends a piece before ASCII white space that follows another
character, and before ASCII punctuation that follows a letter or digit, so the ids of a
text are those of its units behind one another. Punctuation that special strings contain
is left alone, as are their other characters: they hold no white space. Units are found, hashed and looked up for millions of bytes at a time; what was encoded before is
kept in sorted arrays of 128-bit hashes, a few dozen bytes a unit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tideline.llm import shared

KNOWN_UNITS = 1_000_000  # a bound on a worker's memory; forgotten units are encoded again
_CUT = np.zeros(256, bool)
_CUT[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_WIDE = np.zeros(256, bool)
_WIDE[0x80:] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True


def punctuation(special: str) -> np.ndarray:
    """Flags of the ASCII punctuation that isn't in ``special``."""
    flags = _PLAIN & ~_ALNUM
    flags[[ord(c) for c in special if ord(c) < 128]] = False
    return flags


def unit_starts(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray | None) -> np.ndarray:
    """Where units begin: at rows, and where cutting is safe. After a character of more
    bytes that is, or might be, Unicode white space, nothing is cut. ``marks``: the
    punctuation before which texts may be cut, None where they mustn't be cut at all."""
    mark = np.zeros(len(data) + 1, bool)
    if marks is not None and len(data) > 1:
        before = data[:-1]
        blank = np.flatnonzero(_CUT[data]) if not _CUT[data[0]] else np.flatnonzero(_CUT[data])[1:]
        last = data[blank - 1]
        mark[blank[_PLAIN[last] | _WIDE[last]]] = True
        point = np.flatnonzero(marks[data[1:]])
        mark[point[_ALNUM[before[point]]] + 1] = True
        wide = blank[_WIDE[last]]
        wide = wide[wide >= 2]
        two = data[wide - 2]
        three = np.where(wide >= 3, data[np.maximum(wide - 3, 0)], 0)
        last = data[wide - 1]
        blank = ((two == 0xC2) & ((last == 0xA0) | (last == 0x85))) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80)) | ((three == 0xE1) & ((two == 0x9A) | (two == 0xA0)))
        mark[wide[blank]] = False
    mark[offsets] = True
    return np.flatnonzero(mark[: len(data)])


class Units:
    """``encode`` gives the ids of each of a list of texts; ``marks`` as above."""

    def __init__(self, encode: Callable[[list[str]], list], kind: np.dtype, marks: np.ndarray | None):
        self.encode, self.kind, self.marks = encode, np.dtype(kind), marks
        self.forget()

    def forget(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def _keep(self, ids: list) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for one in ids for x in one), self.kind, int(sizes.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.kind)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        return at, sizes

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows behind one another, and each row's number of ids."""
        starts = unit_starts(data, offsets, self.marks)
        ids, lengths = self.each(data, starts)
        rows = np.searchsorted(offsets, starts, "right") - 1
        return ids, np.bincount(rows, lengths, minlength=len(offsets) - 1).astype(np.int64)

    def each(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units that begin at ``starts``, and each unit's number of ids."""
        if len(self.keys) > KNOWN_UNITS:
            self.forget()
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = shared.span_hash(data, starts, ends)
        order = np.argsort(hashes)
        step = np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]])
        one, which = order[step], np.empty(len(order), np.int64)
        which[order] = np.cumsum(step) - 1
        keys = hashes[one]
        a, z = starts[one], ends[one]
        checks = shared.span_hash(data, a, z, seed=1)
        at, sizes = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        place = np.searchsorted(self.keys, keys)
        there = place < len(self.keys)
        there[there] = (self.keys[place[there]] == keys[there]) & (self.checks[place[there]] == checks[there])
        at[there], sizes[there] = self.at[place[there]], self.sizes[place[there]]
        new = np.flatnonzero(~there)
        if len(new):
            raw = data.tobytes()
            at[new], sizes[new] = self._keep(self.encode([raw[x:y].decode("utf-8") for x, y in zip(a[new].tolist(), z[new].tolist())]))
            every = np.concatenate([self.keys, keys[new]])
            order = np.argsort(every, kind="stable")
            fresh = np.ones(len(order), bool)
            fresh[1:] = every[order[1:]] != every[order[:-1]]
            order = order[fresh]
            self.keys = every[order]
            self.checks = np.concatenate([self.checks, checks[new]])[order]
            self.at, self.sizes = np.concatenate([self.at, at[new]])[order], np.concatenate([self.sizes, sizes[new]])[order]
        lengths = sizes[which]
        first = at[which] - (np.cumsum(lengths) - lengths)
        return self.pool[np.repeat(first, lengths) + np.arange(int(lengths.sum()))], lengths
