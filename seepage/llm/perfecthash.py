"""Minimal perfect hashes over byte strings: a bijection from n stored keys to 0 .. n - 1.

Levels of bit arrays, as in the literature on minimal perfect hashing by fingerprint collisions: at
each level a key whose place nobody else has sets its bit and is done; the rest go on to the next,
smaller level. A key's number is the rank of its bit over all levels. The few keys that are
left after ``LEVELS`` (equal 64-bit hashes among them) are held in a list. Any other string gets
some number too, so the stored keys are kept in the order of their numbers, and ``find``
compares the bytes: an answer is a proof.
"""

from __future__ import annotations

import numpy as np

from seepage.llm.common import Packed, mix, span_hashes

LEVELS = 24
ROOM = 2  # places at a level for each key that reaches it


def key_hashes(keys: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(k) for k in keys]) if keys else np.zeros(0, np.int64)
    return span_hashes(b"".join(keys), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if keys else np.zeros(0, np.uint64)


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))) % np.uint64(size)


class PerfectHash(Packed):
    """Of distinct keys. ``blob`` has them in the order of their numbers, key i at offsets[i]:offsets[i + 1]."""

    def __init__(self, keys: list[bytes]):
        h = key_hashes(keys)
        left = np.arange(len(keys))
        sizes, bits, number, done = [], [], np.zeros(len(keys), np.int64), 0
        while len(left) and len(sizes) < LEVELS:
            size = ROOM * len(left)
            at = _place(h[left], len(sizes), size)
            n = np.bincount(at.astype(np.int64), minlength=size)
            alone = n[at] == 1
            own = np.zeros(size, bool)
            own[at[alone]] = True
            number[left[alone]] = done + np.cumsum(own)[at[alone]] - 1
            done += int(alone.sum())
            sizes.append(size)
            bits.append(own)
            left = left[~alone]
        number[left] = done + np.arange(len(left))
        self.n, self.sizes = len(keys), sizes
        self.bits = np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8)
        self.rest = {keys[i]: int(number[i]) for i in left}
        order = np.argsort(number)
        self.blob = b"".join(keys[i] for i in order)
        self.offsets = np.concatenate([[0], np.cumsum([len(keys[i]) for i in order])]).astype(np.int64)
        self._rank = None

    def __getstate__(self) -> dict:
        return super().__getstate__() | {"_rank": None}

    def _ranked(self) -> np.ndarray:
        """Set bits before each byte of the bit array."""
        if self._rank is None:
            self._rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])
        return self._rank

    def key(self, i: int) -> bytes:
        return self.blob[self.offsets[i]:self.offsets[i + 1]]

    def find(self, keys: list[bytes], hashes: np.ndarray | None = None) -> np.ndarray:
        """Each key's number, or -1 if it is not stored."""
        h = key_hashes(keys) if hashes is None else hashes
        out = np.full(len(keys), -1, np.int64)
        rank, todo, base = self._ranked(), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = _place(h[todo], level, size).astype(np.int64) + base
            byte, bit = at >> 3, at & 7
            hit = (self.bits[byte] >> (7 - bit)) & 1 == 1
            b, k = byte[hit], bit[hit]
            out[todo[hit]] = rank[b] + np.bitwise_count(self.bits[b] & (0xFF00 >> k).astype(np.uint8))
            todo = todo[~hit]
            base += size
        for i in todo:
            out[i] = self.rest.get(keys[i], -1)
        for i in np.flatnonzero(out >= 0):
            if self.key(out[i]) != keys[i]:
                out[i] = self.rest.get(keys[i], -1)
        return out

    def size(self) -> int:
        """Bytes it takes, about."""
        return len(self.blob) + self.offsets.nbytes + len(self.bits) * 9 + 200 * len(self.rest)
