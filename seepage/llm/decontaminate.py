"""Operator 7, benchmark decontamination by q-gram lemma filtering.

Texts are compared as UTF-8 bytes with A-Z lower-cased and white-space runs as one
space. Each benchmark item has a segment of ``segment`` bytes at every ``stride`` bytes, and one
that ends with it (a shorter item is one segment). A document leaks an item if some region of
it is within k = ``budget``% of the segment's length in edits. So a verbatim quote of an item is
found for sure from segment - 2 k + stride - 1 bytes on but no fewer than segment - k: 73 by default.

Filter: with k edits a region shares at least m + 1 - q * (k + 1) of the segment's m + 1 - q
q-grams, all on k + 1 neighbouring diagonals (document offset - item offset). Shared
q-grams fall into bins of k + 1 diagonals; two neighbouring bins form a band, so every
run of k + 1 diagonals lies within one. A stretch of a band that reaches the bound within a segment's length
retains the segments around it; those (after the same bound for grams of 4 bytes) are verified by an edit
distance banded around their diagonals. The filter loses no region, the alignment admits no other. ``q`` is
lowered for items for which the bound would not be positive.

Items are indexed once, whatever the stride. The benchmark is broadcast in blocks of about ``block_bytes`` of
text (20 bytes of index for each), one scan of the documents for each block; its size is summed first, and no block grows with the documents.
The scan is map-only: no document is shuffled, whatever many leak one item.

Defined results: null and empty texts leak nothing; null and empty items are found
nowhere; items without an item_id are searched and reported as one item with a null id (``null`` in
the query's list); repeated rows each get their own result; repeated items count once for each
item_id; a null doc_id keeps its row; empty documents or benchmark: nothing leaks; further
columns stay, whatever their names. Long texts go in pieces that overlap by more than a region.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm.common import Packed, fresh, table, text_bytes, written

MAX_BROADCAST_ROWS = 1_000_000
_PIECE = 1 << 20
_SHORT = 4
#: Hits of a text's grams that are held at a time; a piece of text with more is halved.
_HITS = 4_000_000


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def gram_codes(buf: bytes, q: int) -> np.ndarray:
    """The q bytes at every offset as one integer, q <= 8."""
    a = np.frombuffer(buf, np.uint8).astype(np.uint64)
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    two = a[:-1] | a[1:] << np.uint64(8) if q > 1 else a
    out = two[:n].copy()
    for at in range(2, q - 1, 2):
        out |= two[at:at + n] << np.uint64(8 * at)
    if q % 2 and q > 1:
        out |= a[q - 1:q - 1 + n] << np.uint64(8 * (q - 1))
    return out


def region_distance(segment: bytes, text: bytes, lo: int, hi: int, k: int) -> int:
    """Least edits between segment and any region of text starting on diagonals lo..hi, if at most k; else k + 1."""
    left, right = max(0, lo - k), min(len(text), hi + len(segment) + k)
    part = text[left:right]
    if segment in part:
        return 0
    far = k + 1
    last = [0] * (len(part) + 1)  # a region may start anywhere
    for i, ch in enumerate(segment, 1):
        a, b = max(1, lo - left + i - k), min(len(part), hi - left + i + k)
        row = [far] * (len(part) + 1)
        row[0] = i if a == 1 else far
        best = far
        for j in range(a, b + 1):
            v = last[j - 1] + (part[j - 1] != ch)
            if last[j] + 1 < v:
                v = last[j] + 1
            if row[j - 1] + 1 < v:
                v = row[j - 1] + 1
            row[j] = v
            if v < best:
                best = v
        if min(best, row[0]) > k:
            return far
        last = row
    return min(min(last), far)


class Index(Packed):
    """The grams of a block of items at every offset, 20 bytes of arrays for each byte of their texts."""

    def __init__(self, items: list[tuple[int | None, bytes]], segment: int, budget: int, q: int, stride: int):
        self.segment, self.stride = segment, stride
        self.ids, self.texts, widths, needs, longs = [], [], [], [], []
        grams: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            text = normal(text)
            if not text:
                continue
            m = min(segment, len(text))
            k = m * budget // 100
            own = q
            while own > 1 and m + 1 - own * (k + 1) < 1:
                own -= 1
            own = min(own, m)
            grams.setdefault(own, []).append((gram_codes(text, own), len(self.ids)))
            self.ids.append(item)
            self.texts.append(text)
            widths.append(k + 1)
            needs.append(max(1, m + 1 - own * (k + 1)))
            longs.append(m)
        self.tables = []
        for own, found in sorted(grams.items()):
            code = np.concatenate([c for c, _ in found])
            by = np.argsort(code, kind="stable")
            item = np.concatenate([np.full(len(c), i, np.int32) for c, i in found])[by]
            off = np.concatenate([np.arange(len(c), dtype=np.int32) for c, _ in found])[by]
            keys, first = np.unique(code[by], return_index=True)
            maybe = np.zeros(1 << 20, bool)
            maybe[self._slot(keys)] = True
            self.tables.append((own, keys, np.r_[first, len(code)].astype(np.int32), item, off, maybe))
        self.width, self.need, self.long = (np.array(x, np.int64) for x in (widths, needs, longs))
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.longest = max((m + w for m, w in zip(longs, widths)), default=0)

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def regions(self, text: bytes) -> dict[int | None, int]:
        """Items that the text leaks, with their number of verified segments."""
        found: set[tuple[int, int]] = set()
        text = normal(text)
        for at in range(0, max(1, len(text)), _PIECE):
            self._piece(text[at:at + _PIECE + 2 * self.longest], found)
        out: dict[int | None, int] = {}
        for i, _ in found:
            out[self.ids[i]] = out.get(self.ids[i], 0) + 1
        return out

    def _piece(self, text: bytes, found: set[tuple[int, int]]) -> None:
        for table in self.tables:
            self._bands(text, table, found)

    def _bands(self, text: bytes, table: tuple, found: set[tuple[int, int]]) -> None:
        q, keys, first, items, offs, maybe = table
        codes = gram_codes(text, q)
        pos = np.flatnonzero(maybe[self._slot(codes)])
        if not len(pos):
            return
        codes = codes[pos]
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        hit = keys[at] == codes
        pos, at = pos[hit], at[hit]
        if not len(pos):
            return
        n = (first[at + 1] - first[at]).astype(np.int64)
        ends = np.cumsum(n)
        if ends[-1] > _HITS and len(text) > 8 * self.longest:  # repetitive: in halves that overlap by more than a region
            half = len(text) // 2
            self._bands(text[:half + 2 * self.longest], table, found)
            self._bands(text[half:], table, found)
            return
        of = np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1])
        i, off = items[of].astype(np.int64), offs[of].astype(np.int64)
        big = np.int64(1) << 32
        # band b has the bins b and b + 1 of diagonals, so a hit lies in two bands
        band = i * big + ((np.repeat(pos, n) - off) // self.width[i] + (big >> 1))
        own, place, shared = np.unique(band, return_inverse=True, return_counts=True)
        after = np.zeros(len(own) + 2, np.int64)
        beside = own[1:] == own[:-1] + 1
        after[1:-2] = shared[1:] * beside
        before = np.r_[0, shared[:-1] * beside]
        need = self.need[own // big]
        upper, lower = (shared + after[1:-1] >= need)[place], (shared + before >= need)[place]
        band, off = np.r_[band[upper], band[lower] - 1], np.r_[off[upper], off[lower]]
        if not len(band):
            return
        by = np.lexsort((off, band))
        band, off = band[by], off[by]
        # stretches of an item with enough hits for a segment, and the segments that hold them
        i = band // big
        last = np.arange(len(band)) + self.need[i] - 1
        inside = last < len(band)
        end = np.minimum(last, len(band) - 1)
        good = np.flatnonzero(inside & (band[end] == band) & (off[end] - off <= self.long[i] - q))
        if not len(good):
            return
        band, i, lo, hi = band[good], i[good], off[good], off[end[good]] + q
        m, tail = self.long[i], self.size[i] - self.long[i]
        least, most = -(-np.maximum(0, hi - m) // self.stride), np.minimum(lo, tail) // self.stride
        ends_item = (hi - m <= tail) & (tail <= lo)
        rows = np.stack([band, least, most, ends_item])[:, (least <= most) | ends_item]
        rows = rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)][:rows.shape[1]]]
        held: dict[int, set[int]] = {}
        for key, x, y, z in rows.T.tolist():
            starts = held.setdefault(key, set())
            starts.update(range(x * self.stride, y * self.stride + 1, self.stride))
            if z:
                starts.add(int(self.size[key >> 32] - self.long[key >> 32]))
        for key, starts in held.items():
            self._verify(key >> 32, (key & 0xFFFFFFFF) - (1 << 31), starts, text, found)

    def _verify(self, item: int, b: int, starts: set[int], text: bytes, found: set[tuple[int, int]]) -> None:
        """Adds the segments of the item at ``starts`` that have a region in band b."""
        m, k = int(self.long[item]), int(self.width[item]) - 1
        lo, hi = b * (k + 1), (b + 2) * (k + 1) - 1
        own = self.texts[item]
        # the same lemma with short grams, anywhere in the stretch of all and then of each: cheap, and most bands end here
        need = m + 1 - _SHORT * (k + 1)
        grams = lambda a, e: {text[x:x + _SHORT] for x in range(max(0, a), min(e, len(text)) - _SHORT + 1)}
        if need > 0:
            first, end = min(starts), max(starts) + m
            have = grams(lo + first - k, hi + end + k)
            known = [0, *accumulate(own[x:x + _SHORT] in have for x in range(first, end - _SHORT + 1))]
            starts = {s for s in starts if known[s - first + m - _SHORT + 1] - known[s - first] >= need}
        for s in sorted(starts):
            if (item, s) not in found:
                part = own[s:s + m]
                if need > 0:
                    have = grams(lo + s - k, hi + s + m + k)
                    if sum(part[x:x + _SHORT] in have for x in range(m - _SHORT + 1)) < need:
                        continue
                if region_distance(part, text, lo + s, hi + s, k) <= k:
                    found.add((item, s))


def leaks(docs: DataFrame, benchmark: DataFrame, segment: int = 80, budget: int = 10, q: int = 8,
          block_bytes: int = 8 << 20, stride: int = 10) -> DataFrame:
    """(doc_id, text_hash, item_id, regions): what leaks, one row per document row and item."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // block_bytes))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    schema = "doc_id bigint, text_hash bigint, item_id bigint, regions bigint"

    def scan(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in batches:
                got: list[tuple] = []
                for doc_id, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                    got += [(doc_id, h, item, n) for item, n in ix.regions(text_bytes(t.as_py())).items()]
                cols = list(zip(*got)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "text_hash", "item_id", "regions"])
        return d.mapInArrow(run, schema)

    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        block_items = sorted({(r.item_id, text_bytes(r.text)) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        part = scan(spark.sparkContext.broadcast(Index(block_items, segment, budget, q, stride))).distinct()
        out = part if out is None else out.unionByName(part)
    return written(out, "leaks").groupBy("doc_id", "text_hash", "item_id").agg(F.sum("regions").alias("regions"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those that leak a benchmark item."""
    name, leak_id, leak_hash = (fresh(docs, x) for x in ("text_hash_of_row", "leak_id", "leak_hash"))
    bad = written(leaks(docs, benchmark, **how).select(F.col("doc_id").alias(leak_id), F.col("text_hash").alias(leak_hash)).distinct(), "leaking")
    if bad.count() <= MAX_BROADCAST_ROWS:
        bad = F.broadcast(bad)
    d = docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = d["doc_id"].cast("bigint").eqNullSafe(bad[leak_id]) & (d[name] == bad[leak_hash])
    return d.join(bad, same, "left_anti").drop(name)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_items, n_regions and the leaked items as a comma-joined string."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    found = found.groupBy(F.col("doc_id").alias("f"), F.col("text_hash").alias("fh")).agg(F.sort_array(F.collect_set(F.struct("item_id"))).alias("items"), F.sum("regions").alias("regions"))
    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    j = d.join(found, d["doc_id"].eqNullSafe(found["f"]) & (d["h"] == found["fh"]), "left")
    return j.select("doc_id", F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("regions", F.lit(0)).cast("bigint").alias("n_regions"),
                    F.coalesce(F.array_join(F.transform("items", lambda x: F.coalesce(x["item_id"].cast("string"), F.lit("null"))), ","), F.lit("")).alias("item_ids"))
