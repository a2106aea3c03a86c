"""A compressed FM-index over word ids: k-ordered suffixes, the Burrows-Wheeler
transform in a wavelet matrix of packed bits, and backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


def ordered_suffixes(seq: np.ndarray, k: int) -> np.ndarray:
    """Suffix offsets sorted by at least their first k symbols, by doubling of ranks."""
    n = len(seq)
    rank, have = np.asarray(seq, np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:max(0, n - have)] = rank[have:] + 1
        key = rank * (np.int64(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        fresh = np.r_[False, in_order[1:] != in_order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        have *= 2
        if have >= k or rank[order[-1]] == n - 1:
            return order


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        raw = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(raw)] = raw
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int32, out=self.before[1:])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class FMIndex:
    """Index of a sequence of ids >= 0. ``depth``: longest pattern that is searched. Inside,
    ids are one higher and a 0 ends the sequence."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.seq = np.append(np.asarray(seq, np.int64) + 1, 0)
        self.size = len(seq)
        symbols = int(self.seq.max(initial=0)) + 1
        self.suffixes = ordered_suffixes(self.seq, depth + 1)
        self.first = np.zeros(symbols + 1, np.int64)  # suffixes that begin with a smaller symbol
        np.cumsum(np.bincount(self.seq, minlength=symbols), out=self.first[1:])
        left = self.seq[self.suffixes - 1]  # the symbol before each suffix; before offset 0 the final 0
        self.levels: list[Bits] = []
        top = max(1, (symbols - 1).bit_length())
        self.shifts = list(range(top - 1, -1, -1))
        start = np.zeros(symbols, np.int64)
        every = np.arange(symbols)
        for shift in self.shifts:
            bit = ((left >> shift) & 1).astype(bool)
            level = Bits(bit)
            self.levels.append(level)
            ones = level.ones(start)
            start = np.where((every >> shift) & 1, level.zeros + ones, start - ones)
            left = np.concatenate([left[~bit], left[bit]])
        self.start = start  # where a symbol's run begins below the last level

    def before(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol among the first i symbols of the transform."""
        base = self.start[symbol]
        for shift, level in zip(self.shifts, self.levels):
            ones = level.ones(i)
            i = np.where((symbol >> shift) & 1, level.zeros + ones, i - ones)
        return i - base

    def repeated(self, at: np.ndarray, length: int, batch: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search for the windows seq[a:a + length], a in at. Returns, for
        those that occur more than once, their place in ``at`` and the suffix interval
        [lo, hi). A window is given up as soon as its suffix occurs only once, where its
        matching statistic (the longest match of a suffix elsewhere) ends."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in range(0, len(at), batch):
            which = np.arange(b, min(b + batch, len(at)))
            a = at[which]
            c = self.seq[a + length - 1]
            lo, hi = self.first[c], self.first[c + 1]
            for step in range(length - 2, -1, -1):
                go = hi - lo > 1
                which, a, lo, hi = which[go], a[go], lo[go], hi[go]
                if not len(which):
                    break
                c = self.seq[a + step]
                both = self.before(np.concatenate([c, c]), np.concatenate([lo, hi]))
                lo, hi = self.first[c] + both[:len(c)], self.first[c] + both[len(c):]
            go = hi - lo > 1
            out.append((which[go], lo[go], hi[go]))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]

    def least(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of values (one for each offset) over each suffix interval; the
        intervals of windows of one length are equal or apart."""
        starts, first, back = np.unique(lo, return_index=True, return_inverse=True)
        cuts = np.stack([starts, hi[first]], axis=1).reshape(-1)
        most = np.iinfo(np.int64).max
        by_suffix = np.append(np.append(values, most)[self.suffixes], most)
        return np.minimum.reduceat(by_suffix, cuts)[::2][back] if len(cuts) else np.zeros(0, np.int64)
