"""Operator 4, language-model scoring by prediction by partial matching.

Model. A byte-context trie of order ``order``: counts of the byte after each context of up
to that many bytes, over all training texts (A-Z lower-cased, a start byte before and an
end byte after the text). Escapes are method C: a context seen T times with D different next
bytes gives byte b count(b) / (T + D), and escape D / (T + D). After an escape the shorter
context predicts with the bytes excluded that the longer one has seen; as every byte seen
after a context was seen after its suffix, the exclusions are those of the last context alone, so
a context's escape and denominator under exclusion are two numbers computed once. Below the
empty context all bytes not seen are equally likely. A text's score is the sum of log10 of these
probabilities over its bytes and the end byte (its code length, negated).

Training. Each task counts the (order + 1)-grams of its batches; Spark adds them up, and the counts
of shorter grams are sums over the longer ones. All grams are kept, as a table of rows (bytes of
context, key, count) whose key has the context's bytes from last to first, then the next byte: what
shares a context's end is a range of keys on every level.

Scoring. The table is cut into ranges of contexts of measured size: at most ``max_nodes`` grams of
a length (or those of the contexts that share order - 1 bytes, at most 65,536), so what a task holds
does not grow with the corpus. A slice has all that its contexts' probabilities need, also the
shorter contexts. The documents are read once for each slice (once in all if the grams fit one); a
task looks up its batch's distinct grams, and a text's score is the sum over the slices.

Base. Words are counted without a common dictionary and without shuffling texts: each batch of
documents writes its list of distinct words (64-bit hashes, with training counts) and its
documents as places in that list. The lists' words meet by word, get the corpus count and
return to their batch, where each document adds up its own.

Defined results: null and empty texts have the end token only; a null doc_id counts as training
(crc32 of the empty string); without training rows N and V are 0 and the trie predicts all bytes
alike; repeated rows count as often as they occur; empty table: no rows; further columns
are ignored. A long text is scored in pieces.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seepage.llm.common import Packed, clean_docs, table, text_bytes, word_hashes, written

START, END = 0xFE, 0xFF  # bytes that UTF-8 never has
SYMBOLS = 255  # what may follow: all bytes but START
_PIECE = 1 << 18
#: A list of distinct words covers about so many words of documents.
_LIST_WORDS = 1_000_000


def framed(text: bytes, order: int) -> np.ndarray:
    return np.frombuffer(bytes([START]) * order + text.lower() + bytes([END]), np.uint8)


def gram_keys(seq: np.ndarray, order: int) -> np.ndarray:
    """Each window of order + 1 bytes as one integer: the context from its last byte to its first,
    then the byte after it."""
    a = seq.astype(np.uint64)
    n = len(a) - order
    out = np.zeros(n, np.uint64)
    for j in (*range(order - 1, -1, -1), order):
        out = out << np.uint64(8) | a[j:j + n]
    return out


def shorter(keys: np.ndarray, drop: int) -> np.ndarray:
    """The keys without the first ``drop`` bytes of their contexts."""
    return keys >> np.uint64(8 * drop + 8) << np.uint64(8) | keys & np.uint64(255)


class Slice(Packed):
    """grams: for each context length 0..order the (keys, counts) of whole contexts; lo, hi: the
    keys it answers for, lo <= context < hi."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], lo: int = 0, hi: int | None = None):
        self.order = len(grams) - 1
        self.lo, self.hi = lo, 1 << 8 * self.order if hi is None else hi
        self.keys: list[np.ndarray] = []
        self.log: list[np.ndarray] = []  # log10 of a gram's count
        self.contexts: list[np.ndarray] = []
        self.own: list[np.ndarray] = []  # log10 of total + distinct
        self.escape: list[np.ndarray] = []  # log10 of escaping from the context, nothing excluded
        self.under: list[np.ndarray] = []  # log10 of the suffix's denominator, the context's bytes excluded
        self.pass_: list[np.ndarray] = []  # log10 of escaping from the suffix, the context's bytes excluded
        last = None
        for d, (keys, counts) in enumerate(grams):
            by = np.argsort(keys)
            keys, counts = keys[by].astype(np.uint64), counts[by].astype(np.float64)
            names, first = np.unique(keys >> np.uint64(8), return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            kinds = np.diff(np.r_[first, len(keys)]).astype(np.float64)
            with np.errstate(divide="ignore"):
                self.own.append(np.log10(total + kinds))
                self.escape.append(np.log10(kinds / (total + kinds)))
                if last is None:
                    self.under.append(np.log10(np.maximum(SYMBOLS - kinds, 1)))  # below the empty context
                    self.pass_.append(np.zeros(len(names)))
                else:
                    gone = last[1][np.searchsorted(last[0], shorter(keys, 1))]
                    up = np.searchsorted(last[2], names >> np.uint64(8))
                    left = last[3][up] - (np.add.reduceat(gone, first) if len(first) else 0.0)
                    new = last[4][up] - kinds
                    # left + new is 0 if the suffix has seen nothing more: then nothing is read there
                    self.under.append(np.log10(np.maximum(left + new, 1e-30)))
                    self.pass_.append(np.where(new > 0, np.log10(np.maximum(new, 1e-30) / np.maximum(left + new, 1e-30)), 0.0))
            self.keys.append(keys)
            self.log.append(np.log10(counts))
            self.contexts.append(names)
            last = keys, counts, names, total, kinds

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after its context; 0 for the grams of
        other slices."""
        out = np.zeros(len(keys))
        context = keys >> np.uint64(8)
        mine = np.flatnonzero((context >= np.uint64(self.lo)) & (context < np.uint64(self.hi)))
        mine = mine[np.argsort(keys[mine])]  # neighbours are looked up near each other
        keys = keys[mine]
        got = np.zeros(len(keys))
        open_ = np.arange(len(keys))  # not yet predicted
        above = np.full(len(keys), -1)  # the context escaped from last, one byte longer; -1: none
        for d in range(self.order, -1, -1):
            if not len(self.keys[d]):
                continue
            key = shorter(keys[open_], self.order - d)
            at = _find(self.contexts[d], key >> np.uint64(8))
            place = _find(self.keys[d], key)
            known, hit, ab = at >= 0, place >= 0, above[open_]
            fresh = ab < 0
            den, esc = self.own[d][at], self.escape[d][at]
            if d < self.order and len(self.under[d + 1]):
                den = np.where(fresh, den, self.under[d + 1][ab])
                esc = np.where(fresh, esc, self.pass_[d + 1][ab])
            got[open_] += np.where(hit, self.log[d][place] - den, np.where(known, esc, 0.0))
            above[open_] = np.where(known, at, -1)
            open_ = open_[~hit]
        got[open_] -= self.under[0][0] if len(self.under[0]) else math.log10(SYMBOLS)
        out[mine] = got
        return out

    def _piece(self, seq: np.ndarray) -> np.ndarray:
        return self.log10(gram_keys(seq, self.order))


def _find(names: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where x is in the sorted names, -1 where it is not."""
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return np.where(names[at] == x, at, -1)


class Model:
    """The counts of all grams as a table, and the ranges of contexts it is given out in."""

    def __init__(self, levels: DataFrame, order: int, ranges: list[tuple[int, int]]):
        self.levels, self.order, self.ranges = levels, order, ranges
        self._held: list[Slice] = []

    def slice(self, i: int) -> Slice:
        lo, hi = self.ranges[i]
        drop = [8 * (self.order - d) for d in range(self.order + 1)]
        own = [(F.col("d") == d) & F.col("key").between(lo >> x << 8, (hi - 1 >> x << 8) + 255) for d, x in enumerate(drop)]
        rows = self.levels.where(reduce(Column.__or__, own)).toArrow()
        level, keys, counts = (rows[c].to_numpy() for c in ("d", "key", "n"))
        return Slice([(keys[level == d].astype(np.uint64), counts[level == d]) for d in range(self.order + 1)], lo, hi)

    def _piece(self, seq: np.ndarray) -> np.ndarray:
        """All slices at once, for models that fit the driver."""
        self._held = self._held or [self.slice(i) for i in range(len(self.ranges))]
        return sum(x._piece(seq) for x in self._held)


def _ranges(levels: DataFrame, order: int, most: int) -> list[tuple[int, int]]:
    """Ranges of contexts with at most ``most`` grams each: what has more is split by one more
    byte, as far as order - 1 bytes, then neighbours are joined."""
    top = levels.where(F.col("d") == order)
    parts, new = [], [(0, top.count())]
    for d in range(1, order):
        large = [lo >> 8 * (order - d + 1) for lo, n in new if n > most]
        if not large:
            break
        parts += [x for x in new if x[1] <= most]
        whole, byte = (F.shiftright("key", 8 * (order - d + x) + 8) for x in (1, 0))
        got = top.where(whole.isin(large)).groupBy(byte.alias("p")).count().collect()
        new = [(r["p"] << 8 * (order - d), r["count"]) for r in got]
    parts += new
    starts, held = [], 0
    for lo, n in sorted(parts):
        if not starts or held + n > most:
            starts.append(lo)
            held = 0
        held += n
    return list(zip([0, *starts[1:]], [*starts[1:], 1 << 8 * order]))


def train(docs: DataFrame, order: int = 4, max_nodes: int = 2_000_000) -> Model:
    """The model of all texts of docs (doc_id, text); a slice of it has about max_nodes grams of a length."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, codes, _, _ in _distinct((text_bytes(t.as_py()) for t in b.column(0)), order):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(codes, minlength=len(keys)))], names=["key", "n"])

    grams = docs.select("text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    grams = written(grams, "grams")
    byte = F.col("key").bitwiseAND(F.lit(255).cast("bigint"))
    each = [F.struct(F.lit(d).alias("d"), F.shiftleft(F.shiftright("key", 8 * (order - d) + 8), 8).bitwiseOR(byte).alias("key")) for d in range(order + 1)]
    levels = written(grams.select(F.inline(F.array(*each)), "n").groupBy("d", "key").agg(F.sum("n").alias("n")), "levels")
    return Model(levels, order, _ranges(levels, order, max_nodes))


def _distinct(texts: Iterable[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """(distinct grams, the place of each gram among them, whose they are, where each one's end)
    of texts, a few MB at a time; a long text comes in pieces."""
    got, whose, size = [], [], 0

    def done() -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
        codes, keys = pd.factorize(np.concatenate(got))
        return keys, codes, whose, np.cumsum([len(x) for x in got]).tolist()

    for i, t in enumerate(texts):
        seq = framed(t, order)
        for at in range(0, len(seq) - order, _PIECE):
            got.append(gram_keys(seq[at:at + _PIECE + order], order))
            whose.append(i)
            size += len(got[-1])
            if size > 1 << 21:
                yield done()
                got, whose, size = [], [], 0
    if got:
        yield done()


def text_scores(model: Slice, texts: list[bytes]) -> np.ndarray:
    """The part of each text's score that the slice answers for."""
    out = np.zeros(len(texts))
    for keys, codes, whose, ends in _distinct(texts, model.order):
        logs = model.log10(keys)[codes]
        np.add.at(out, whose, np.add.reduceat(logs, [0, *ends[:-1]]))
    return out


def scores(docs: DataFrame, order: int = 4, max_nodes: int = 2_000_000, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    d = clean_docs(docs)
    d = d.withColumn("held_out", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held)
    trained = train(d.where("NOT held_out"), order, max_nodes)
    d = d.withColumn("row", F.monotonically_increasing_id())
    if len(trained.ranges) > 1:  # every pass must give a row the same number
        d = written(d, "numbered")
    trie = spark.sparkContext.broadcast(trained.slice(0))
    lists = pa.list_(pa.int32())
    fields = [("kind", pa.int8()), ("batch", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("at", lists), ("times", lists), ("i", pa.int32()), ("word", pa.int64()), ("n", pa.int64())]

    def rows(size: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols[k] if k in cols else pa.nulls(size, t) for k, t in fields], names=[k for k, _ in fields])

    def listed(parts: list[np.ndarray]) -> pa.Array:
        ends = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: a document with its distinct words as places in the batch's word list and
        how often each occurs. kind 1: a word of that list with its count in training texts."""
        model = trie.value

        def done(ids: list, held_out: list[bool], row: list[int], hashes: list[np.ndarray], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            score = text_scores(model, texts)
            batch, sizes = uuid.uuid4().int >> 65, np.array([len(h) for h in hashes])
            words, place = np.unique(np.concatenate(hashes), return_inverse=True)
            learn = np.repeat(~np.array(held_out, bool), sizes)
            counts = np.bincount(place[learn], minlength=len(words))
            at, times = zip(*(np.unique(x, return_counts=True) for x in np.split(place, np.cumsum(sizes)[:-1])))
            same = lambda n, k: (pa.array(np.full(n, k, np.int8)), pa.array(np.full(n, batch, np.int64)))
            kind, own = same(len(sizes), 0)
            yield rows(len(sizes), kind=kind, batch=own, row=pa.array(row, pa.int64()), doc_id=pa.array(ids, pa.int64()), held_out=pa.array(held_out, pa.bool_()), n_tokens=pa.array(sizes + 1, pa.int64()), score=pa.array(score, pa.float64()), at=listed(list(at)), times=listed(list(times)))
            kind, own = same(len(words), 1)
            yield rows(len(words), kind=kind, batch=own, i=pa.array(np.arange(len(words), dtype=np.int32)), word=pa.array(words.view(np.int64)), n=pa.array(counts.astype(np.int64)))

        got: tuple[list, ...] = ([], [], [], [], [])
        size = 0
        for b in batches:
            for doc_id, t, held_out, row in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                buf = text_bytes(t.as_py()).lower()
                h = word_hashes(buf)
                for part, x in zip(got, (doc_id, held_out, row, h, buf)):
                    part.append(x)
                size += len(h)
                if size > _LIST_WORDS:
                    yield from done(*got)
                    got, size = ([], [], [], [], []), 0
        if got[0]:
            yield from done(*got)

    schema = "kind tinyint, batch bigint, row bigint, doc_id bigint, held_out boolean, n_tokens bigint, score double, at array<int>, times array<int>, i int, word bigint, n bigint"
    both = written(d.mapInArrow(run, schema), "scored")
    rest = [_more(d, trained.slice(i)) for i in range(1, len(trained.ranges))]
    w = Window.partitionBy("word")
    words = both.where("kind = 1").select("batch", "i", "word", "n")
    words = words.withColumns({"c": F.sum("n").over(w), "first": F.row_number().over(w.orderBy("batch", "i")) == 1})
    words = written(words.select("batch", "i", "c", "first"), "words")
    ends = both.where("kind = 0 AND NOT held_out").count()
    sums = words.where("first AND c > 0").agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    total, kinds = sums["n"] + ends, sums["v"] + (ends > 0)
    bottom, end = math.log10(total + kinds + 1), math.log10(ends + 1)

    def base(docs_: pd.DataFrame, words_: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(len(words_), np.int64)
        c[words_["i"].to_numpy()] = words_["c"].to_numpy(np.int64)
        logs, known, score = np.log10(c + 1.0) - bottom, [], []
        for at, times in zip(docs_["at"], docs_["times"]):
            known.append(int(times[c[at] > 0].sum()) + (ends > 0))
            score.append(float((times * logs[at]).sum()) + end - bottom)
        return docs_[["doc_id", "held_out", "n_tokens", "score"]].assign(n_known=known, base_score=score, train_tokens=total)[names]

    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    names = [x.split()[0] for x in out.split(", ")]
    scored = both.where("kind = 0").select("batch", "row", "doc_id", "held_out", "n_tokens", "score", "at", "times")
    if rest:
        more = reduce(DataFrame.unionAll, rest).groupBy("row").agg(F.sum("more").alias("more"))
        scored = scored.join(more, "row").withColumn("score", F.col("score") + F.col("more")).drop("more")
    return scored.groupBy("batch").cogroup(words.select("batch", "i", "c").groupBy("batch")).applyInPandas(base, out)


def _more(docs: DataFrame, part: Slice) -> DataFrame:
    """row, more: what a further slice adds to each document's score."""
    trie = docs.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = text_scores(trie.value, [text_bytes(t.as_py()) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["row", "more"])

    out = written(docs.select("row", "text").mapInArrow(run, "row bigint, more double"), "more")
    trie.unpersist()
    return out


def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
