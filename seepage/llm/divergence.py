"""Operator 13, source divergence audit: how far a source's words are from those of its language.

Terms are runs of letters (``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased); the pattern's cuts
are ASCII, so UTF-8 bytes are cut at the same places.

First pass: the number of documents that have a term, by language; tasks add up before they
shuffle. Terms of ``MIN_DOCS`` documents or more are kept, exactly. Each language's kept
terms are dealt by hash to shards of about ``SHARD`` terms, and each shard gets a minimal
perfect hash (perfecthash.py), built in its own task and written with its keys.

Second pass: the shards are broadcast and the documents read again. A batch's distinct terms get
their numbers, proved by the stored keys, and every (language, source) that a task meets has
a dense array of counts for each shard, which the batch increments. Full arrays
(``SLOTS`` counts in all) and the end of the task send out what is not 0. Shards that take more than
``ROUND_BYTES`` together are broadcast one part after the other, with one reading of the documents for
each: the size is measured before, and nothing larger is collected or broadcast.

The report: shares are p = 1 + floor(10^9 (count + 5) / (N + 5 V)) in decimal arithmetic. ``term`` rows are
a ranking of the counts. ``pair`` rows sum |p - q| over all kept terms, those that neither source
has too: blocks of terms, bounded to ``CELLS`` counts, become a matrix with a column for each source,
whose empty cells hold the share of count 0, and give a partial sum for each two sources.

Defined results: null texts, languages and sources are empty ones; documents without terms count
for their group; repeated rows are documents of their own, whatever their ids; a language
without kept terms has pairs of value 0; a language with one source has no pairs; terms are ranked
by value, then by their bytes; empty table: no rows; further columns are not read. A text is
cut as a whole in its task.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seepage.llm.common import table, written
from seepage.llm.perfecthash import PerfectHash, key_hashes

MIN_DOCS = 30
TOP = 50
SHARD = 1 << 16
#: Bytes of perfect hashes in one broadcast.
ROUND_BYTES = 64 << 20
#: Entries of a task's table of document counts, and of its dense arrays, before they are sent out.
ENTRIES, SLOTS = 400_000, 1 << 23
#: Cells of a block's matrix.
CELLS = 1 << 16
SCALE = 1_000_000_000

_CUT = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_CUT).split()


def _docs(docs: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))


def _document_counts(tables):
    """(lang, term, hash, n): in how many of the task's documents a term is."""
    have: dict[str, Counter] = {}

    def out():
        for lang, n in have.items():
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array(key_hashes(keys).view(np.int64), pa.int64()), pa.array(list(n.values()), pa.int64())],
                                             ["lang", "term", "hash", "n"])
        have.clear()

    for t in tables:
        for lang, text in zip(t["lang"].to_pylist(), t["text"].to_pylist()):
            have.setdefault(lang, Counter()).update(set(terms(text)))
            if sum(map(len, have.values())) > ENTRIES:
                yield from out()
    yield from out()


def kept_terms(d: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, hash: the terms in at least so many documents of a language. Written."""
    n = d.select("lang", "text").mapInArrow(_document_counts, "lang string, term binary, hash bigint, n bigint")
    n = n.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.first("hash").alias("hash"))
    return written(n.where(F.col("n") >= min_docs).select("lang", "term", "hash"), "terms")


_PERFECT = "lang string, shard int, shards int, n int, bytes bigint, perfect binary, keys array<binary>"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    made = PerfectHash([bytes(k) for k in pdf["term"]])
    first = pdf.iloc[0]
    return pd.DataFrame([{"lang": first["lang"], "shard": first["shard"], "shards": first["shards"], "n": made.n, "bytes": made.size(), "perfect": pickle.dumps(made), "keys": [made.key(i) for i in range(made.n)]}])


def perfect_hashes(kept: DataFrame, shard_terms: int) -> DataFrame:
    """A row for each shard of each language, with the hash and its keys in order. Written."""
    shards = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / shard_terms).cast("int").alias("shards"))
    k = kept.join(shards, "lang").withColumn("shard", F.pmod(F.shiftrightunsigned("hash", 1), F.col("shards")).cast("int"))
    return written(k.select("lang", "shard", "shards", "term").groupBy("lang", "shard").applyInPandas(_build, _PERFECT), "perfect", 1)


class _Recount:
    """The second pass over a task's documents, with one broadcast of shards."""

    def __init__(self, found, slots: int):
        self.found, self.slots = found, slots

    def __call__(self, tables):
        perfect: dict[str, tuple[int, dict[int, PerfectHash]]] = {}
        for lang, shard, shards, blob in self.found.value:
            perfect.setdefault(lang, (shards, {}))[1][shard] = pickle.loads(blob)
        dense: dict[tuple[str, str, int], np.ndarray] = {}

        def out():
            rows = [(lang, source, shard, at, n[at]) for (lang, source, shard), n in dense.items() if len(at := np.flatnonzero(n))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()),
                                                  pa.array([r[3].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[4] for r in rows], pa.list_(pa.int64()))], ["lang", "source", "shard", "slots", "counts"])
            dense.clear()

        for t in tables:
            by: dict[str, list[tuple[str, bytes]]] = {}
            for lang, source, text in zip(t["lang"].to_pylist(), t["source"].to_pylist(), t["text"].to_pylist()):
                if lang in perfect:
                    by.setdefault(lang, []).append((source, text))
            for lang, docs in by.items():
                own: dict[bytes, int] = {}
                seen: dict[str, list[list[int]]] = {}
                for source, text in docs:
                    n = Counter(terms(text))
                    at = seen.setdefault(source, [[], []])
                    at[0] += [own.setdefault(w, len(own)) for w in n]
                    at[1] += n.values()
                shards, parts = perfect[lang]
                keys = list(own)
                hashes = key_hashes(keys)
                shard = ((hashes >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)
                slot = np.full(len(keys), -1, np.int64)
                for s, p in parts.items():
                    at = np.flatnonzero(shard == s)
                    slot[at] = p.find([keys[i] for i in at], hashes[at])
                for source, (at, n) in seen.items():
                    at, n = np.array(at, np.int64), np.array(n, np.int64)
                    for s, p in parts.items():
                        mine = (shard[at] == s) & (slot[at] >= 0)
                        if mine.any():
                            if (key := (lang, source, s)) not in dense:
                                dense[key] = np.zeros(p.n, np.int64)
                            np.add.at(dense[key], slot[at[mine]], n[mine])
                if sum(map(len, dense.values())) > self.slots:
                    yield from out()
        yield from out()


def recount(d: DataFrame, perfect: DataFrame, round_bytes: int, slots: int) -> DataFrame:
    """lang, source, shard, slot, n: occurrences of kept terms, without zeros. Written."""
    spark = d.sparkSession
    size = perfect.agg(F.sum("bytes")).first()[0] or 0
    rounds = max(1, -(-size // round_bytes))
    parts = []
    for r in range(rounds):
        # at most round_bytes, up to the shards' unevenness under the hash
        rows = perfect.where(F.pmod(F.xxhash64("lang", "shard"), F.lit(rounds)) == r).select("lang", "shard", "shards", "perfect").collect()
        found = spark.sparkContext.broadcast([(x.lang, x.shard, x.shards, bytes(x.perfect)) for x in rows])
        got = d.mapInArrow(_Recount(found, slots), "lang string, source string, shard int, slots array<int>, counts array<bigint>")
        got = got.select("lang", "source", "shard", F.explode(F.arrays_zip("slots", "counts")).alias("x"))
        got = got.groupBy("lang", "source", "shard", F.col("x.slots").alias("slot")).agg(F.sum("x.counts").alias("n"))
        parts.append(written(got, "counts"))  # of this round's shards alone
        found.unpersist()
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 v)); decimals, as the product passes 64 bits from 9 * 10^9 occurrences on."""
    top = (n + 5).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + v * 5).cast("decimal(20,0)")).cast("bigint") + 1


def _pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of |p - q| over a block's terms for each two sources (numbers a < b)."""
    zero = pdf[pdf["slot"] < 0].sort_values("at")["p"].to_numpy(np.int64)
    some = pdf[pdf["slot"] >= 0]
    row, which = np.unique(some["slot"].to_numpy(), return_inverse=True)
    p = np.tile(zero, (len(row), 1))
    p[which, some["at"].to_numpy() - 1] = some["p"].to_numpy(np.int64)
    out = [(g + 1, h + 1, s) for g in range(len(zero) - 1) for h, s in enumerate(np.abs(p[:, g + 1:] - p[:, g:g + 1]).sum(axis=0).tolist(), g + 1)]
    x = pd.DataFrame(out, columns=["a", "b", "value"])
    x.insert(0, "lang", pdf["lang"].iloc[0])
    return x


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard_terms: int = SHARD, round_bytes: int = ROUND_BYTES, slots: int = SLOTS, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    d = _docs(docs)
    kept = kept_terms(d, min_docs)
    perfect = perfect_hashes(kept, shard_terms)
    counts = recount(d, perfect, round_bytes, slots)
    names = perfect.select("lang", "shard", F.posexplode("keys").alias("slot", "term"))
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    n = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = n.groupBy("lang").agg(F.sum("total").alias("whole"))
    groups = d.select("lang", "source").distinct().join(v, "lang", "left").join(n, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0)
    number = Window.partitionBy("lang").orderBy("source")  # a row a source
    groups = written(groups.withColumn("at", F.row_number().over(number)).withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang"))), "groups")

    key = ["lang", "shard", "slot"]
    every = counts.groupBy(*key).agg(F.sum("n").alias("all_n")).join(names, key)
    c = counts.join(groups, ["lang", "source"])
    c = c.withColumn("p", _share(F.col("n"), F.col("total"), F.col("v")))

    t = c.join(every, key).withColumn("q", _share(F.col("all_n"), F.col("whole"), F.col("v"))).where("p > q")
    t = t.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    t = t.withColumn("rank", ranked).where(F.col("rank") <= top)

    # Blocks of about cells / sources terms of a shard; each holds, as slot -1, every source's share of count 0.
    block = F.floor(F.col("slot") / F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("sources")))).alias("block")
    some = c.where("sources > 1").select("lang", "shard", block, "slot", "at", "p")
    zero = groups.where("v > 0").select(F.col("lang").alias("own"), "at", _share(F.lit(0), F.col("total"), F.col("v")).alias("p"))
    zero = some.select("lang", "shard", "block").distinct().join(zero, F.col("lang") == F.col("own")).select("lang", "shard", "block", F.lit(-1).alias("slot"), "at", "p")
    sums = some.unionByName(zero).groupBy("lang", "shard", "block").applyInPandas(_pair_sums, "lang string, a int, b int, value bigint")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("z")
    sums = sums.select(F.col("lang").alias("own"), both, "value").select("own", "z.*", "value")
    # the report itself has a row for each two sources of a language
    other = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("other"))
    pairs = groups.select("lang", "source", "at").join(other, "lang").where("at <> other")
    pairs = pairs.join(sums, (F.col("lang") == F.col("own")) & (F.col("at") == F.col("x")) & (F.col("other") == F.col("y")), "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value")).withColumn("rank", ranked)
    return pairs.unionByName(t)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


#: DuckDB SQL for the same rows.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, id, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
a AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
l AS (SELECT lang, sum(n) AS total FROM a GROUP BY lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p,
    1 + (1000000000::HUGEINT * (a.n + 5)) // (l.total + 5 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang JOIN l ON g.lang = l.lang JOIN a ON a.lang = k.lang AND a.term = k.term
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (
    SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
