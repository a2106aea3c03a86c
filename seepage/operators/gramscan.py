"""One reading of the contents, whatever the number of values they are matched against.

What decides which places of a content deserve a row is a filter of fixed size, not the
values: a blocked Bloom filter of 64-bit anchor grams (exact matching: one 8-byte gram of each
value) and a bitmap of all 2^24 trigrams (fuzzy matching). Both are built by Spark in chunks,
broadcast once, and tested by numpy on every byte position of an Arrow batch, before any row
exists. What passes are thin rows (content hash, positions, grams); a content that a task
meets again passes once.

Rows of rare trigrams grow with contents times values. While the values' prefix trigrams fit a bound (Index), they
are therefore met where the content is scanned, and only the windows that hold two of a value leave
the task; beyond the bound the thin rows meet them in a join.

The scan is vectorised: eight strided views of the buffer give all its 8-byte grams without a
copy, and a test costs a few nanoseconds a byte; the same test as built-in functions is a
lambda over an array of positions (about a hundred times that), and as a join a row for every
byte.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANCHOR = 8  # bytes of an anchor gram: the shortest value that is matched
EXACT, FUZZY = 0, 1
#: A window range of a value, found by the scan itself.
FOUND = 2
#: Words of a chunk in which filters are built (64 KiB).
_CHUNK = 1 << 13
#: Bits of the Bloom filter for an anchor, and its largest size in words (128 MiB): past 32 million
#: anchors more positions pass, which costs rows of the join after it, not matches.
_BITS, _MAX_WORDS = 32, 1 << 24
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes tested at a time, and content hashes a task remembers.
_SEGMENT, _REMEMBER = 1 << 22, 200_000
#: Hits of the index that are looked at together: with more, the values are halved.
_HITS = 1 << 20

_TRI_WORDS = 1 << 18


def filter_words(anchors: int) -> int:
    """A power of two, for so many anchors."""
    return min(_MAX_WORDS, max(1 << 12, 1 << (max(1, anchors * _BITS // 64) - 1).bit_length()))


def _word_and_mask(key: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    h = key * _ODD
    h ^= h >> np.uint64(32)
    h *= _ODD
    mask = np.zeros(len(h), np.uint64)
    for s in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((h >> np.uint64(s)) & np.uint64(63))
    return (h >> np.uint64(64 - (words.bit_length() - 1))).astype(np.int64), mask


def encode_anchors(anchors: DataFrame) -> DataFrame:
    """(vid, off, vlen, key) from (vid, off, vlen, g): the gram as a 64-bit number."""
    def encode(batches):
        for t in batches:
            key = np.frombuffer(b"".join(t["g"].to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([t["vid"], t["off"], t["vlen"], pa.array(key, pa.int64())], ["vid", "off", "vlen", "key"])
    return anchors.select("vid", F.col("off").cast("int"), F.col("vlen").cast("int"), "g").mapInArrow(encode, "vid binary, off int, vlen int, key bigint")


def build_filters(probe: DataFrame, words: int) -> tuple[bytes, bytes]:
    """(Bloom filter of the exact keys, bitmap of the fuzzy keys) of probe (kind, key), as
    little-endian words. Chunks of 64 KiB are made by the executors; the driver gets at most
    words / 8192 + 32 of them."""
    def bits(batches):
        for t in batches:
            kind, key = np.asarray(t["kind"]), np.asarray(t["key"]).view(np.uint64)
            exact = kind == EXACT
            word, mask = (key >> np.uint64(6)).astype(np.int64), np.uint64(1) << (key & np.uint64(63))
            word[exact], mask[exact] = _word_and_mask(key[exact], words)
            yield pa.RecordBatch.from_arrays([t["kind"], pa.array((word // _CHUNK).astype(np.int32)), pa.array((word % _CHUNK).astype(np.int32)), pa.array(mask.view(np.int64))], ["kind", "chunk", "word", "mask"])

    def chunk(t: pa.Table) -> pa.Table:
        own = np.zeros(_CHUNK, np.uint64)
        np.bitwise_or.at(own, np.asarray(t["word"]), np.asarray(t["mask"]).view(np.uint64))
        return pa.table({"kind": t["kind"][:1], "chunk": t["chunk"][:1], "bits": pa.array([own.astype("<u8").tobytes()], pa.binary())})

    marks = probe.select("kind", "key").mapInArrow(bits, "kind int, chunk int, word int, mask bigint")
    marks = marks.groupBy("kind", "chunk", "word").agg(F.bit_or("mask").alias("mask"))
    made = marks.groupBy("kind", "chunk").applyInArrow(chunk, "kind int, chunk int, bits binary").collect()
    out = []
    for kind, size in ((EXACT, words), (FUZZY, _TRI_WORDS)):
        whole = bytearray(size * 8)
        for r in made:
            if r.kind == kind:
                at = r.chunk * _CHUNK * 8
                whole[at:at + len(r.bits)] = r.bits[:size * 8 - at]
        out.append(bytes(whole))
    return out[0], out[1]


@dataclass
class Index:
    """The values' prefix trigrams, sorted by trigram and value: place = trigram * number of values + value,
    idx the trigram's number in its value; of each value its id, length and how many numbers a match needs."""
    place: np.ndarray
    idx: np.ndarray
    vids: pa.Array
    vlen: np.ndarray
    need: np.ndarray

    def windows(self, pos: np.ndarray, key: np.ndarray, own: np.ndarray, sizes: np.ndarray):
        """Ranges (content, value, lo, hi) of window starts, of hits sorted by content and position: a window
        with two numbers of a value has two hits next to each other (among that value's) that differ."""
        todo, values = [(0, len(self.vids))], len(self.vids)
        base = key * values
        while todo:
            a, z = todo.pop()
            first, last = np.searchsorted(self.place, base + a), np.searchsorted(self.place, base + z)
            count = last - first
            total = int(count.sum())
            if total > _HITS and z - a > 1:
                todo += [(a, (a + z) // 2), ((a + z) // 2, z)]
                continue
            if not total:
                continue
            at = np.repeat(np.arange(len(pos)), count)
            entry = np.arange(total) - np.repeat(np.cumsum(count) - count - first, count)
            group = own[at] * values + self.place[entry] - base[at]
            order = np.argsort(group, kind="stable")
            group, p, idx = group[order], pos[at[order]], self.idx[entry[order]]
            value, content = group % values, group // values
            size, n = self.vlen[value], sizes[content]
            alone = self.need[value] <= 1
            end = np.where(alone, p, np.append(p[1:], 0))
            near = np.append((group[1:] == group[:-1]) & (idx[1:] != idx[:-1]), False) & (end - p <= size - 3)
            top = np.maximum(n - size, 0)
            lo, hi = np.maximum(end + 3 - size, 0), np.minimum(p, top)
            keep = np.flatnonzero((alone | near) & (lo <= top))
            if not len(keep):
                continue
            group, value, content, size, lo, hi = (x[keep] for x in (group, value, content, size, lo, hi))
            part = lo // size  # ranges that begin in one stretch of the value's length are one
            begin = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (part[1:] != part[:-1])))
            yield content[begin], value[begin], lo[begin], np.maximum.reduceat(hi, begin)


def build_index(probe: DataFrame) -> tuple:
    """The fields of an Index (as tasks have no import path to its class), of fuzzy probe rows (key, vid, vlen, idx,
    need) that were found to fit the bound."""
    t = probe.select("key", "vid", "vlen", "idx", "need").toArrow()
    own = t["vid"].combine_chunks().dictionary_encode()
    value = np.asarray(own.indices).astype(np.int64)
    vlen, need = np.ones(len(own.dictionary), np.int64), np.ones(len(own.dictionary), np.int64)
    vlen[value], need[value] = np.asarray(t["vlen"]), np.asarray(t["need"])
    place = np.asarray(t["key"]).astype(np.int64) * max(1, len(own.dictionary)) + value
    order = np.argsort(place)
    return place[order], np.asarray(t["idx"]).astype(np.int32)[order], own.dictionary, vlen, need


class Scan:
    """Contents (_ch, content_bin) to rows (_ch, n, kind, pos, key) of the places that pass; with an index
    the fuzzy ones are window ranges (_ch, n, FOUND, pos, key, hi, vlen, vid)."""

    def __init__(self, filters, kinds: tuple[int, ...], index=None):
        self.filters, self.kinds, self.index = filters, kinds, index

    def _exact(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bloom = np.frombuffer(self.filters.value[0], "<u8")
        shift = np.uint64(64 - (len(bloom).bit_length() - 1))
        pos, keys = [], []
        for r in range(min(8, max(0, len(buf) - ANCHOR + 1))):
            v = buf[r:r + (len(buf) - r) // 8 * 8].view("<u8")
            h = v * _ODD
            h ^= h >> np.uint64(32)
            h *= _ODD
            word = bloom[(h >> shift).astype(np.int64)]
            at = np.flatnonzero((word >> (h & np.uint64(63))) & np.uint64(1))
            h, word = h[at], word[at]
            every = np.ones(len(at), bool)
            for s in (6, 12, 18):
                every &= (word >> ((h >> np.uint64(s)) & np.uint64(63))) & np.uint64(1) == 1
            at = at[every]
            pos.append(at * 8 + r)
            keys.append(v[at])
        if not pos:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos, keys = np.concatenate(pos), np.concatenate(keys)
        order = np.argsort(pos)
        return pos[order], keys[order].view(np.int64)

    def _fuzzy(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(buf) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bitmap = np.frombuffer(self.filters.value[1], np.uint8)
        t = buf[:-2].astype(np.int32) << 16
        t |= buf[1:-1].astype(np.int32) << 8
        t |= buf[2:]
        at = np.flatnonzero(bitmap[t >> 3] >> (t & 7).astype(np.uint8) & 1)
        return at, t[at].astype(np.int64)

    def _rows(self, hashes: list[bytes], sizes: list[int], first: list[int], buf: bytes, reps: pa.Array | None = None):
        """Of contents (or one segment of a long one, from position first on) that follow each other in buf."""
        data = np.frombuffer(buf, np.uint8)
        ends = np.cumsum([len(buf)] if len(hashes) == 1 else sizes)
        starts = np.concatenate([[0], ends[:-1]])
        for kind in self.kinds:
            pos, key = self._exact(data) if kind == EXACT else self._fuzzy(data)
            own = np.searchsorted(ends, pos, "right")
            inside = pos + (ANCHOR if kind == EXACT else 3) <= ends[own] if len(pos) else np.zeros(0, bool)
            pos, key, own = pos[inside], key[inside], own[inside]
            place = pos - starts[own] + np.array(first, np.int64)[own]
            if kind == FUZZY and self.index is not None:
                index = Index(*self.index.value)
                for at, value, lo, hi in index.windows(place, key, own, np.array(sizes, np.int64)):
                    yield from self._batch(hashes, sizes, reps, FOUND, at, lo, value, hi, index.vlen[value], index.vids.take(pa.array(value)))
            else:
                yield from self._batch(hashes, sizes, reps, kind, own, place, key)

    @staticmethod
    def _batch(hashes, sizes, reps, kind, own, pos, key, hi=None, vlen=None, vid=None):
        which, begin = np.unique(own, return_index=True)
        if not len(which):
            return
        offsets = pa.array(np.concatenate([begin, [len(own)]]).astype(np.int32))
        none = pa.array(np.zeros(len(which) + 1, np.int32))
        of = lambda x, t: pa.ListArray.from_arrays(none, pa.array([], t)) if x is None else pa.ListArray.from_arrays(offsets, x if isinstance(x, pa.Array) else pa.array(x.astype(t.to_pandas_dtype())))
        rep = pa.nulls(len(which), pa.int64()) if reps is None else reps.take(pa.array(which))
        yield pa.RecordBatch.from_arrays([pa.array([hashes[i] for i in which], pa.binary()), rep, pa.array([sizes[i] for i in which], pa.int32()), pa.array([kind] * len(which), pa.int32()),
                                          of(pos, pa.int32()), of(key, pa.int64()), of(hi, pa.int32()), of(vlen, pa.int32()), of(vid, pa.binary())], ["_ch", "_rep", "n", "kind", "pos", "key", "hi", "vlen", "vid"])

    def _overlap(self) -> int:
        """Bytes that a segment shares with the next: an anchor, or a window of the longest value."""
        return max(ANCHOR - 1, int(Index(*self.index.value).vlen.max(initial=0)) if self.index is not None else 0)

    def __call__(self, batches):
        met: set[bytes] = set()
        for t in batches:
            hashes, sizes, parts, rows, held = [], [], [], [], 0
            for i, (ch, content) in enumerate(zip(t["_ch"].to_pylist(), t["content_bin"])):
                if ch is None or ch in met:
                    continue
                if len(met) >= _REMEMBER:
                    met.clear()
                met.add(ch)
                content = content.as_buffer()
                if content.size > _SEGMENT:
                    for a in range(0, content.size, _SEGMENT):
                        yield from self._rows([ch], [content.size], [a], content.slice(a, min(_SEGMENT + self._overlap(), content.size - a)).to_pybytes(), t["_rep"].take(pa.array([i])))
                    continue
                hashes.append(ch)
                sizes.append(content.size)
                parts.append(content.to_pybytes())
                rows.append(i)
                held += content.size
                if held > _SEGMENT:
                    yield from self._rows(hashes, sizes, [0] * len(hashes), b"".join(parts), t["_rep"].take(pa.array(rows)))
                    hashes, sizes, parts, rows, held = [], [], [], [], 0
            if hashes:
                yield from self._rows(hashes, sizes, [0] * len(hashes), b"".join(parts), t["_rep"].take(pa.array(rows)))


def scan(contents: DataFrame, filters, kinds: tuple[int, ...], index=None) -> DataFrame:
    """(_ch, _rep, n, kind, pos, key, hi, vlen, vid): a row for each place of contents (_ch, _rep, content_bin) that
    passes a filter, _rep as of one of the content's copies; the last three only of what the index found."""
    rep = dict(contents.dtypes)["_rep"]
    got = contents.select("_ch", "_rep", "content_bin").mapInArrow(
        Scan(filters, kinds, index), f"_ch binary, _rep {rep}, n int, kind int, pos array<int>, key array<bigint>, hi array<int>, vlen array<int>, vid array<binary>")
    got = got.select("_ch", "_rep", "n", "kind", F.explode(F.arrays_zip("pos", "key", "hi", "vlen", "vid")).alias("_x"))
    return got.select("_ch", "_rep", "n", "kind", "_x.pos", "_x.key", "_x.hi", "_x.vlen", "_x.vid")


# Ship this module's code with the tasks, so workers need no import path to it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
