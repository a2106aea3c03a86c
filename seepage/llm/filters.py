"""Operator 11, filter interaction audit: what five filters take, alone and after one another.

Sparse document-term matrix. A batch of documents becomes a CSR shard: the batch's own dictionary
gives column numbers, a row a document, an entry the count of a word in it. Each shard sends its
distinct words, dealt to buckets by hash and packed, a row a bucket; where a bucket's words meet, a
word gets its global number once (``numbers``, of which ``dictionary`` reads the words), and the shard gets
the numbers of its words back, never a row for each entry. With them its columns become global
(``document_term_matrix``, kept as Parquet: row pointers, columns and counts as little-endian 32-, 64-
and 32-bit integers, each compressed by zstandard). Row sums are the numbers of words and nonzero
counts those of distinct words: they decide A and B. Symbols and capitals (C, D) are counted on the
bytes; identity (E) is that of the texts' SHA-256.

Documents of one text fail the same of A to D, so rows are counted by (text, part, labels) before
the smallest doc_id of each text is sought: a text that a third of all rows share costs a few
rows. What is left is a count for each (part, set of failed filters), at most 32 a part;
the 80 pairs of a filter and a set of earlier ones give all 120 orders.

Defined results: null texts are empty (no words, no characters: only A fails, and E for copies);
null sources are the empty name; of several labels of a document each mark counts if any has it;
labels of null ids mark nothing; repeated rows are documents of their own; rows with the same
doc_id and text are not copies by that (none has a smaller id); rows of a null doc_id have no
smaller id and are smaller than none; empty table: no rows; further columns are not read. A batch
has at most ``BATCH_ROWS`` documents and ends with the document that brings it over ``BATCH_BYTES``, so a
shard is bounded by these and the longest text.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm.common import table, written

LETTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
MIN_WORDS = 200
SYMBOLS = b"#$%&*|"
BATCH_ROWS, BATCH_BYTES = 4000, 8 << 20

_DOCS = "docs array<struct<doc_id: bigint, part: string, text_hash: binary, c: boolean, d: boolean>>"
_SHARD = f"shard bigint, {_DOCS}, indptr binary, columns binary, counts binary, parts array<struct<bucket: int, words: binary>>"
_UPPER, _TAIL = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def pack(values, kind: str) -> bytes:
    return zstandard.compress(np.asarray(values, kind).tobytes(), 1)


def unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def _marks(text: bytes) -> tuple[bool, bool]:
    """Whether a text fails C and D."""
    points = len(text.translate(None, _TAIL))
    return 100 * (len(text) - len(text.translate(None, _UPPER))) > 2 * points, len(text.translate(None, SYMBOLS)) < len(text)


def _batches(tables):
    """Lists of (doc_id, part, text) within the bounds."""
    rows, size = [], 0
    for t in tables:
        for row in zip(t["doc_id"].to_pylist(), t["part"].to_pylist(), t["text"].to_pylist()):
            rows.append(row)
            size += len(row[2])
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


class _Shards:
    """CSR shards with the batch's own column numbers, its words by bucket in the order of these."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __call__(self, tables):
        schema = pa.schema([("shard", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("text_hash", pa.binary()), ("c", pa.bool_()), ("d", pa.bool_())]))),
                            ("indptr", pa.binary()), ("columns", pa.binary()), ("counts", pa.binary()), ("parts", pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])))])
        first = TaskContext.get().partitionId() << 32
        for k, rows in enumerate(_batches(tables)):
            own: dict[bytes, int] = {}
            columns, counts, indptr, docs = [], [], [0], []
            for i, part, text in rows:
                n = Counter(text.split())
                columns += [own.setdefault(w, len(own)) for w in n]
                counts += n.values()
                indptr.append(len(columns))
                c, d = _marks(text)
                docs.append({"doc_id": i, "part": part, "text_hash": hashlib.sha256(text).digest(), "c": c, "d": d})
            words, bucket = list(own), np.array([zlib.crc32(w) % self.buckets for w in own], np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            ends = np.cumsum(np.bincount(bucket, minlength=self.buckets))
            parts = [{"bucket": b, "words": b" ".join([words[j] for j in order[a:e]])} for b, (a, e) in enumerate(zip([0, *ends[:-1]], ends)) if e > a]
            yield pa.RecordBatch.from_pylist([{"shard": first + k, "docs": docs, "indptr": pack(indptr, "<i4"), "columns": pack(place[np.array(columns, np.int64)], "<i4"),
                                               "counts": pack(counts, "<i4"), "parts": parts}], schema)


def _number(tables):
    """Numbers for the words of a task's buckets, and the words that are new to it."""
    have: dict[bytes, int] = {}
    base = TaskContext.get().partitionId() << 33
    for t in tables:
        out = []
        for blob in t["words"].to_pylist():
            was, words = len(have), blob.split(b" ")
            ids = np.array([have.setdefault(w, len(have)) for w in words], np.int64) + base
            out.append((pack(ids, "<i8"), base + was, b" ".join([w for w, i in zip(words, ids) if i >= base + was])))
        yield pa.RecordBatch.from_arrays([t["shard"], t["bucket"], *(pa.array(x, k) for x, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary())))], ["shard", "bucket", "ids", "first", "new"])


def _global_columns(tables):
    """Shards with their columns as global word numbers, ascending within a row."""
    for t in tables:
        out = []
        for row in t.select(["indptr", "columns", "counts", "ids"]).to_pylist():
            indptr, columns, counts = (unpack(row[k], "<i4") for k in ("indptr", "columns", "counts"))
            found = np.concatenate([np.zeros(0, "<i8"), *(unpack(x, "<i8") for x in row["ids"])])[columns]
            order = np.lexsort((found, np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))))
            out.append((pack(found[order], "<i8"), pack(counts[order], "<i4")))
        yield pa.RecordBatch.from_arrays([t["shard"], t["docs"], t["indptr"], pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["shard", "docs", "indptr", "columns", "counts"])


def numbers(local: DataFrame, buckets: int) -> DataFrame:
    """shard, bucket, ids: the global numbers of the shard's words of that bucket; first, new: the words
    that got theirs there, from ``first`` on. Written, so the numbers stay as they are."""
    places = local.select("shard", F.explode("parts").alias("x")).select("shard", "x.bucket", "x.words")
    return written(places.repartition(buckets, "bucket").mapInArrow(_number, "shard bigint, bucket int, ids binary, first bigint, new binary"), "numbers")


def dictionary(numbered: DataFrame) -> DataFrame:
    """word, id: every distinct word of the corpus, once."""
    new = numbered.where(F.octet_length("new") > 0)
    return new.select("first", F.posexplode(F.split(F.col("new").cast("string"), " ")).alias("at", "word")).select("word", (F.col("first") + F.col("at")).alias("id"))


def document_term_matrix(docs: DataFrame) -> DataFrame:
    """CSR shards of docs (doc_id, text, source): shard, docs, indptr, columns, counts."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                    F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    # A task holds the distinct words of its buckets: their number grows with the setting that sizes all shuffles.
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = written(d.mapInArrow(_Shards(buckets), _SHARD), "shards")
    own = numbers(local, buckets).groupBy(F.col("shard").alias("own")).agg(F.sort_array(F.collect_list(F.struct("bucket", "ids"))).alias("x"))
    whole = local.drop("parts").join(own.select("own", F.transform("x", lambda e: e["ids"]).alias("ids")), F.col("shard") == F.col("own"), "left").drop("own")
    whole = whole.withColumn("ids", F.coalesce("ids", F.array().cast("array<binary>")))
    return written(whole.mapInArrow(_global_columns, f"shard bigint, {_DOCS}, indptr binary, columns binary, counts binary"), "matrix", 4)  # a row is a whole shard


def _rows(tables):
    """From each row of the matrix: its sum and its number of entries."""
    for t in tables:
        for docs, indptr, counts in zip(t["docs"], t["indptr"].to_pylist(), t["counts"].to_pylist()):
            indptr = unpack(indptr, "<i4")
            run = np.concatenate([[0], np.cumsum(unpack(counts, "<i4"), dtype=np.int64)])
            flat = docs.values
            yield pa.RecordBatch.from_arrays([*flat.flatten(), pa.array(run[indptr[1:]] - run[indptr[:-1]], pa.int64()), pa.array(np.diff(indptr), pa.int64())],
                                             ["doc_id", "part", "text_hash", "c", "d", "n_words", "n_distinct"])


def document_marks(matrix: DataFrame) -> DataFrame:
    """A row a document: doc_id, part, text_hash, n_words, n_distinct and the failures a, b, c, d."""
    n = matrix.select("docs", "indptr", "counts").mapInArrow(_rows, "doc_id bigint, part string, text_hash binary, c boolean, d boolean, n_words bigint, n_distinct bigint")
    n = written(n, "marks", 4)
    return n.select("doc_id", "part", "text_hash", "n_words", "n_distinct", (F.col("n_words") < MIN_WORDS).alias("a"), (F.col("n_distinct") * 100 < F.col("n_words") * 50).alias("b"), "c", "d")


def failures(marks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: numbers of documents that fail exactly the filters of mask (A 1, B 2, ...)."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    own = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(flag("quality"), flag("toxic"))
    m = marks.join(own, marks["doc_id"] == own["label_id"], "left")
    good, toxic = (F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("quality", "toxic"))
    # Rows that share an id and a text, then rows that share a text: what a copied text needs is its smallest id and how often that occurs.
    key = ["text_hash", "part", "a", "b", "c", "d", "quality", "toxic"]
    ids = m.select("doc_id", *key[:6], good, toxic).groupBy("doc_id", *key).agg(F.count(F.lit(1)).alias("n"))
    texts = ids.groupBy(*key, F.col("doc_id").isNull().alias("nameless")).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    texts = written(texts, "texts")
    least = texts.where(~F.col("nameless")).groupBy(F.col("text_hash").alias("least_hash")).agg(F.min("first.doc_id").alias("least"))
    x = texts.join(least, texts["text_hash"] == least["least_hash"], "left")
    own_first = F.when(F.col("nameless"), F.col("n")).when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    each = F.explode(F.array(F.struct(F.lit(0).alias("e"), own_first.alias("n")), F.struct(F.lit(1).alias("e"), (F.col("n") - own_first).alias("n")))).alias("x")
    x = x.select("part", *[F.col(k).cast("int").alias(k) for k in "abcd"], "quality", "toxic", each).where("x.n > 0")
    mask = F.col("a") + F.col("b") * 2 + F.col("c") * 4 + F.col("d") * 8 + F.col("x.e") * 16
    some = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0))
    return x.groupBy("part", mask.alias("mask")).agg(F.sum("x.n").alias("n"), some("quality").alias("good"), some("toxic").alias("toxic"))


def _constant(rows: list[tuple], fields: str) -> Column:
    names = [f.split(":")[0] for f in fields.split(",")]
    return F.explode(F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), f"array<struct<{fields}>>"))


def interactions(counts: DataFrame) -> DataFrame:
    """The report of the module's contract from failures()."""
    steps = [("".join(LETTERS[f] for f in p), k + 1, 1 << p[k], sum(1 << f for f in p[:k])) for p in permutations(range(5)) for k in range(5)]
    orders = Counter((f, s) for _, _, f, s in steps)  # in how many of the 120 a filter comes right after a set
    c = counts.select("*", _constant([(f, s, n) for (f, s), n in orders.items()], "f:int,s:int,orders:int").alias("z")).select("*", "z.*")
    f, s, mask = F.col("f"), F.col("s"), F.col("mask")
    fails, before = mask.bitwiseAND(f) != 0, mask.bitwiseAND(s) != 0
    total = lambda what, when: F.sum(F.when(when, F.col(what)).otherwise(0)).cast("bigint")
    c = c.groupBy("part", "f", "s", "orders").agg(
        total("n", ~fails & ~before).alias("kept"), total("n", fails & ~before).alias("removed"), total("n", fails & before).alias("redundant"),
        total("n", mask == f).alias("unique_fails"), total("good", fails & ~before).alias("good_lost"), total("toxic", fails & ~before).alias("toxic_lost"))
    # A part's 80 rows; each order and step takes the one of its filter and the set before it.
    by = c.groupBy("part").agg(F.collect_list(F.struct("f", "s", "orders", *COUNTS)).alias("by"))
    out = by.select("part", "by", _constant(steps, "filter_order:string,step:int,f:int,s:int").alias("z"))
    z = F.col("z")
    own = F.filter("by", lambda x: (x["f"] == z["f"]) & (x["s"] == z["s"]))[0]
    shapley = F.aggregate("by", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["f"] == z["f"], x["removed"] * x["orders"]).otherwise(F.lit(0)).cast("bigint"))
    out = out.select("part", z["filter_order"].alias("filter_order"), z["step"].alias("step"), own.alias("v"), shapley.alias("shapley"))
    return out.select("part", "filter_order", "step", *[F.col("v")[k].alias(k) for k in COUNTS], "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(written(failures(document_marks(document_term_matrix(docs)), labels), "failures"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: DuckDB SQL for the same rows.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM f p, f q, f r, f s, f t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b | q.b | r.b | s.b | t.b = 31),
st AS (SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0) AS before FROM o, range(1, 6) AS g(k)),
a AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & own = 0 AND mask & before = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, (SELECT filter_order, step, CAST(own AS BIGINT) AS own, CAST(before AS BIGINT) AS before FROM st) GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a
"""
