"""Operator 9, substring dedup with an FM-index per shard.

A window is ``span`` consecutive words of one document. Words are removed that a window
covers whose words also start in a document of a smaller doc_id.

Equal windows must meet in one shard without sending every window or every document to every
shard. The anchor of a window is the least hash of the ``gram``-word runs inside it, so equal
windows have equal anchors, and consecutive windows mostly share one.

1. Each document's distinct anchors are shuffled (a fifth of its words); anchors that only
   one document has go: their windows occur nowhere else.
2. For the rest, the runs of consecutive windows of one anchor are cut out as segments.
   Equal segments of some ten thousand documents become one with the least and largest doc_id, so what many
   documents share is sent once for each of these. Anchors of very many documents are split by
   the windows' second-least hash, which equal windows share too.
3. Segments are dealt out by anchor. A task takes them in order of anchor in shards of about
   ``shard_words`` words, cut between anchors, builds the shard's FM-index, streams all its
   segments through backward search, and finds for each window that is repeated the least
   doc_id over its suffix interval.
4. Segments that have something to remove are joined back to the documents' segments (thin
   rows; a hot segment is split by the skew join), which gives the intervals to remove.

Words are compared by 64-bit hashes. Documents shuffle once, by doc_id, for steps 2 and 4 and the
result together.

Defined results: null and empty texts have no words and the digest of the empty text; rows of a
null doc_id keep all words and count for no one; rows of equal doc_id do not remove one another's
words, each is judged by its own text; ties do not arise, as ids are strictly smaller; empty
table: no rows; further columns are ignored. A very long text is one row of one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seepage.llm.common import _P, _P_INV, _powers, clean_docs, mix, span_hashes, table, text_bytes, window_hashes, word_bounds, word_hashes, written
from seepage.llm.fmindex import FMIndex

#: Anchors of more documents than this are split by the second-least hash.
HOT_ANCHOR = 5_000
#: About so many distinct segments are gathered before they are sent.
_SEGMENTS = 100_000


def window_anchors(h: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each window, gram hashes)."""
    g = window_hashes(h, gram)
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), g
    least = g[:n].copy()
    for j in range(1, span - gram + 1):
        np.minimum(least, g[j:j + n], out=least)
    return least, g


def _segments(h: np.ndarray, wanted: np.ndarray, hot: np.ndarray, span: int, gram: int):
    """(key, first window, last window, segment hash) of the runs whose anchor is wanted."""
    anchor, g = window_anchors(h, span, gram)
    key = mix(anchor)
    if len(hot):
        at = np.flatnonzero(np.isin(anchor, hot))
        if len(at):
            second = np.partition(sliding_window_view(g, span - gram + 1)[at], 1, axis=1)[:, 1]
            key[at] = mix(key[at] ^ mix(second + np.uint64(1)))
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(key)] - 1
    keep = np.isin(anchor[first], wanted)
    first, last = first[keep], last[keep]
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers("p", _P, len(h)), dtype=np.uint64, out=run[1:])
    end = last + span
    digest = mix((run[end] - run[first]) * _powers("i", _P_INV, len(h))[first] + (end - first).astype(np.uint64))
    return key[first], first, last, digest


def shard_results(shard: list[tuple[int, bytes, int, int, int]], span: int) -> list[tuple[int, list[int]]]:
    """(segment hash, least doc_id of each of its windows) for the segments (hash, text, words,
    least and largest doc_id) of a shard, where a document has something to remove."""
    words = np.array([s[2] for s in shard], np.int64)
    buf = b"\n".join(s[1] for s in shard)
    ids = np.unique(span_hashes(buf, *word_bounds(buf)), return_inverse=True)[1].astype(np.int64) + 1
    seq = np.zeros(len(ids) + len(shard), np.int64)  # 0 ends a segment
    of = np.repeat(np.arange(len(shard)), words)
    begin = np.r_[0, np.cumsum(words + 1)[:-1]]
    seq[np.arange(len(ids)) + of] = ids
    least = np.array([s[3] for s in shard], np.int64)
    most = np.array([s[4] for s in shard], np.int64)
    index = FMIndex(seq, span)
    n = words - span + 1
    offset = np.r_[0, np.cumsum(n)[:-1]]
    own = np.repeat(np.arange(len(shard)), n)
    at = np.arange(int(n.sum())) - offset[own] + begin[own]
    found = least[own]
    which, lo, hi = index.repeated(at, span)
    found[which] = index.least(np.repeat(least, words + 1), lo, hi)
    smallest = np.minimum.reduceat(found, offset)
    out = []
    for s in np.flatnonzero(smallest < most).tolist():
        out.append((shard[s][0], found[offset[s]:offset[s] + n[s]].tolist()))
    return out


def removed_words(docs: DataFrame, span: int = 13, gram: int = 5, shard_words: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    docs = clean_docs(docs).withColumn("h", F.xxhash64("text"))
    named = docs.where("doc_id IS NOT NULL")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1)):
                a, _ = window_anchors(word_hashes(text_bytes(t.as_py())), span, gram)
                if len(a):
                    a = np.unique(a)
                    out.append(a)
                    ids.append(np.full(len(a), doc_id, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(ids))], names=["anchor", "doc_id"])

    w = Window.partitionBy("anchor")
    a = named.select("doc_id", "text").mapInArrow(anchors, "anchor bigint, doc_id bigint")
    a = a.withColumns({"lo": F.min("doc_id").over(w), "hi": F.max("doc_id").over(w), "n": F.count(F.lit(1)).over(w)}).where("lo <> hi")
    a = a.groupBy("doc_id").agg(F.collect_list("anchor").alias("wanted"), F.collect_list(F.when(F.col("n") > HOT_ANCHOR, F.col("anchor"))).alias("hot"))
    a = written(a, "anchors").withColumnRenamed("doc_id", "a_id")
    found = named.join(a, named["doc_id"] == a["a_id"]).select("doc_id", "text", "h", "wanted", "hot")

    def longs(x) -> np.ndarray:
        return np.asarray(x.values, np.int64).view(np.uint64)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each segment of a document."""
        for b in batches:
            cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for doc_id, t, th, wanted, hot in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3), b.column(4)):
                h = word_hashes(text_bytes(t.as_py()))
                if len(h) < span:
                    continue
                _, first, _, digest = _segments(h, longs(wanted), longs(hot), span, gram)
                for c, v in zip(cols, (digest.view(np.int64), np.full(len(first), doc_id, np.int64), np.full(len(first), th, np.int64), first)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["segment", "doc_id", "h", "first"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each distinct segment of some documents, with its words."""
        got: dict[int, list] = {}

        def done() -> pa.RecordBatch:
            cols = list(zip(*got.values())) or [[]] * 6
            got.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))],
                                              names=["key", "segment", "words", "n", "lo", "hi"])

        for b in batches:
            for doc_id, t, wanted, hot in zip(b.column(0).to_pylist(), b.column(1), b.column(3), b.column(4)):
                buf = text_bytes(t.as_py())
                starts, ends = word_bounds(buf)
                if len(starts) < span:
                    continue
                key, first, last, digest = _segments(span_hashes(buf, starts, ends), longs(wanted), longs(hot), span, gram)
                lefts, rights, sizes = starts[first].tolist(), ends[last + span - 1].tolist(), (last - first + span).tolist()
                for k, d, left, right, n in zip(key.view(np.int64).tolist(), digest.view(np.int64).tolist(), lefts, rights, sizes):
                    s = got.get(d)
                    if s is None:
                        got[d] = [k, d, buf[left:right], n, doc_id, doc_id]
                    else:
                        s[4], s[5] = min(s[4], doc_id), max(s[5], doc_id)
            if len(got) > _SEGMENTS:
                yield done()
        yield done()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        size, last = 0, None

        def done() -> pa.RecordBatch:
            rows = shard_results([tuple(x) for x in got.values()], span) if got else []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["segment", "least"])

        for b in batches:
            for key, segment, words, n, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                if key != last and size >= shard_words:
                    yield done()
                    got, size = {}, 0
                last = key
                s = got.get(segment)
                if s is None:
                    got[segment] = [segment, words, n, lo, hi]
                    size += n
                else:
                    s[3], s[4] = min(s[3], lo), max(s[4], hi)
        yield done()

    segments = found.mapInArrow(full, "key bigint, segment bigint, words binary, n bigint, lo bigint, hi bigint")
    results = segments.repartition("key").sortWithinPartitions("key").mapInArrow(shards, "segment bigint, least array<bigint>")
    places = found.mapInArrow(thin, "segment bigint, doc_id bigint, h bigint, first bigint")
    hit = places.join(results, "segment")
    gone = hit.select("doc_id", "h", F.explode(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.col("first") + i))).alias("w")).where("w IS NOT NULL")
    gone = gone.groupBy(F.col("doc_id").alias("g_id")).agg(F.collect_list(F.struct("h", "w")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, t, th, out in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3)):
                words = text_bytes(t.as_py()).split()
                n, removed = len(words), 0
                if out.is_valid:
                    at = np.asarray(out.values.field("w"), np.int64)[np.asarray(out.values.field("h"), np.int64) == th]
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + span, -1)
                    keep = np.cumsum(step[:n]) == 0
                    removed = n - int(keep.sum())
                    words = compress(words, keep.tolist())
                rows.append((doc_id, n, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    none = F.lit(None).cast("array<struct<h:bigint,w:bigint>>").alias("gone")
    judged = named.join(gone, named["doc_id"] == gone["g_id"], "left").select("doc_id", "text", "h", "gone").mapInArrow(cut, schema)
    return written(judged.unionByName(docs.where("doc_id IS NULL").select("doc_id", "text", "h", none).mapInArrow(cut, schema)), "kept-words")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents
), win AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i + 12], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id
), cut AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS p FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN p IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string([x FOR x, i IN ws IF NOT list_contains(p, i)], ' ') END) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id)
"""
