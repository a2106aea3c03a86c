"""Operator 3, n-gram Jaccard join in the metric space of shingle sets.

The distance 1 - |x & y| / |x | y| is a metric. Documents within ``1 - share`` are
linked; wanted is the class (connected component) of every document. The join never
forms all pairs of a group:

1. Sets. Each text becomes its set of hashed shingles; equal sets are one vertex with a
   64-bit id. Written: a narrow row per document, and shingles that are frequent within
   a batch, whose total counts give the order: all shingles sorted rarest first, that is
   those outside the table of the ``max_frequent`` most frequent ones by hash, then the
   table's by count. Any fixed order is right; this one keeps common passages last.
2. Prefixes. Of two sets within the distance, the first n - ceil(share * n) + 1 shingles in
   that order have one in common. Prefix rows meet by shingle; those met by one set only go.
3. Pivots and Voronoi regions. In each shingle's group the set that has it earliest in its order
   is a pivot (it has the fewest rare shingles, so it is central; ties by a random rank). A set's home is the nearest of the pivots it met (most prefix shingles in common,
   then rank); its distance to the home is computed exactly from the texts. What lies within
   the distance is linked to the pivot: one row for each member, however large the group.
   Other pivots are only tested for sets that are not yet in one class with them. Pairs that
   cannot be near go unread: what follows a first common shingle is too short, or the counts of
   shingles in 64 parts of the hash range (a map that does not widen distances) differ too much.
4. Recursion. Groups in which all sets are of one class are done. The rest, without its
   pivots, is the next level's input: new pivots by another rank, and so on. A group of at
   most ``leaf`` sets, or what is left after ``levels`` levels, is joined directly: only
   sets outside the group's largest class against the sets of other classes, and only
   within the triangle window |d(x, p) - d(y, p)| <= 1 - share around the last level's pivot p.
5. Classes are the connected components of the links, carried back to the documents.

Results are exact but for hash collisions of 64 bits (two different sets of equal id need
about 2**32 documents; a collision of two shingles changes a count by one).

Defined results: null and empty texts and texts without words have n_shingles 0 and
are linked with nothing, not even one another; fewer than ``n`` words are one shingle; rows
with equal texts are one vertex; a null doc_id gets its row with a null component_id and
links nothing; rows with equal doc_id each take part with their own text; empty table: no
rows; further columns are ignored. Very long texts are one set each, of at most 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seepage.llm.common import Packed, clean_docs, fresh, mix, table, text_bytes, window_hashes, word_hashes, written
from seepage.llm.components import components

#: (doc_id, set id) rows are broadcast to pick documents up to this many; beyond it the join shuffles.
MAX_BROADCAST_IDS = 1_000_000
#: A set's shingles are counted in 2 ** this many parts by hash; the counts' difference is at most
#: that of the sets.
_PART_BITS = 6
#: Shingles are counted within about so many of a task's at a time, to find frequent ones.
_COUNTED_SHINGLES = 4_000_000


class Frequent(Packed):
    """Frequent shingles, sorted, and their keys in the order."""

    def __init__(self, hot: np.ndarray, level: np.ndarray):
        self.hot, self.level = hot, level


def shingle_set(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n consecutive words, A-Z lower-cased."""
    h = word_hashes(text.lower())
    if not len(h):
        return np.zeros(0, np.uint64)
    if len(h) < n:
        return mix(np.array([int(sum((int(x) * pow(3, i + len(h), 2**64)) for i, x in enumerate(h.tolist())) % 2**64)], np.uint64))
    return np.unique(window_hashes(h, n))


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit id of a set: an order-free sum and an order-free xor of its hashes, mixed."""
    total, folded = int(np.add.reduce(s, dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s)))
    x = (total + folded * 0x9E3779B97F4A7C15 + len(s)) % 2**64
    return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def _need(n: np.ndarray | int, share: int):
    """ceil(share% of n)."""
    return (n * share + 99) // 100


def _set_rows(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: doc_id, set id, set size, its shingles counted by their hash's top bits.
    kind 1: shingle, its sets among some millions of shingles of a task (3 or more)."""
    def counted(sets: list[np.ndarray]) -> pa.Array:
        flat = np.concatenate([np.bincount((s >> np.uint64(64 - _PART_BITS)).astype(np.int64), minlength=1 << _PART_BITS) for s in sets] + [np.zeros(0, np.int64)])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) << _PART_BITS), pa.array(flat.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []

        def often() -> pa.RecordBatch:
            every = np.sort(np.concatenate([*pending, np.zeros(0, np.uint64)]))
            starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][:len(every)])
            counts = np.diff(np.r_[starts, len(every)])
            hot, counts = every[starts[counts >= 3]].view(np.int64), counts[counts >= 3]
            pending.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(hot), np.int8)), pa.array(hot), pa.array(np.zeros(len(hot), np.int64)), pa.array(counts.astype(np.int64)),
                                               pa.nulls(len(hot), pa.list_(pa.int32())), pa.nulls(len(hot), pa.int64())], names=["kind", "a", "b", "n", "parts", "h"])

        for b in batches:
            sids, sizes, sets = [], [], []
            for t in b.column(1):
                s = shingle_set(text_bytes(t.as_py()), n)
                sids.append(set_id(s))
                sizes.append(len(s))
                sets.append(s)
            ids = b.column(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int8)), ids, pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), counted(sets), b.column(2)], names=["kind", "a", "b", "n", "parts", "h"])
            pending += sets
            if sum(map(len, pending)) > _COUNTED_SHINGLES:
                yield often()
        yield often()
    return docs.mapInArrow(run, "kind tinyint, a bigint, b bigint, n bigint, parts array<int>, h bigint")


def _prefix_rows(docs: DataFrame, n: int, share: int, frequent) -> DataFrame:
    """(s, sid, n, i): each set's prefix shingles and their places in the order. frequent:
    broadcast (sorted hashes, order keys)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, level = frequent.value.hot, frequent.value.level
        for b in batches:
            out, sids, sizes, places = [], [], [], []
            for t in b.column(1):
                s = shingle_set(text_bytes(t.as_py()), n)
                if not len(s):
                    continue
                size = len(s)
                keep = size - _need(size, share) + 1
                sid = set_id(s)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    order = np.where(hot[at] == s, level[at], 0)
                    if order[:keep].any():
                        s = s[np.lexsort((s, order))]
                out.append(s[:keep])
                sids.append(np.full(keep, sid, np.int64))
                sizes.append(np.full(keep, size, np.int32))
                places.append(np.arange(keep, dtype=np.int32))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["s", "sid", "n", "i"])
    return docs.mapInArrow(run, "s bigint, sid bigint, n int, i int")


def _distances(docs: DataFrame, rep: DataFrame, pairs: DataFrame, n: int, share: int) -> DataFrame:
    """(x, p, dist, linked) for the pairs of set ids that their part counts leave possible,
    exact from the texts of one document of each set."""
    few = rep.select("sid", "n", "parts")
    both = pairs.join(few.toDF("x", "nx", "cx"), "x").join(few.toDF("p", "np", "cp"), "p")
    apart = F.aggregate(F.zip_with("cx", "cp", lambda a, b: F.abs(a - b)), F.lit(0), lambda a, d: a + d)
    pairs = written(both.where(apart * (100 + share) <= (F.col("nx") + F.col("np")) * (100 - share)).select("x", "p"), "possible")
    ends = pairs.select(F.col("x").alias("sid")).unionByName(pairs.select(F.col("p").alias("sid"))).distinct()
    need = written(rep.join(ends, "sid").select("doc_id", "h", "sid"), "needed")
    texts = docs.join(F.broadcast(need) if need.count() <= MAX_BROADCAST_IDS else need, ["doc_id", "h"]).select("sid", "text").dropDuplicates(["sid"])
    both = pairs.join(texts.select(F.col("sid").alias("x"), F.col("text").alias("tx")), "x")
    both = both.join(texts.select(F.col("sid").alias("p"), F.col("text").alias("tp")), "p").select("x", "p", "tx", "tp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sp = None, None
        for b in batches:
            xs, ps, dist, linked = [], [], [], []
            for x, p, tx, tp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if p != last:
                    sp, last = shingle_set(text_bytes(tp.as_py()), n), p
                sx = shingle_set(text_bytes(tx.as_py()), n)
                common = len(np.intersect1d(sx, sp, assume_unique=True))
                union = len(sx) + len(sp) - common
                xs.append(x)
                ps.append(p)
                dist.append(1 - common / union)
                linked.append(100 * common >= share * union)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ps, pa.int64()), pa.array(dist, pa.float64()), pa.array(linked, pa.bool_())], names=["x", "p", "dist", "linked"])
    return written(both.sortWithinPartitions("p").mapInArrow(run, "x bigint, p bigint, dist double, linked boolean"), "distances").distinct()


def _rank(c: str, level: int):
    return F.xxhash64(F.lit(level), F.col(c))


def set_classes(docs: DataFrame, n: int = 5, share: int = 80, max_frequent: int = 1_000_000, leaf: int = 32, levels: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc rows: doc_id, sid, n), (classes: v set id, comp) of sets that have a link."""
    spark, docs = docs.sparkSession, clean_docs(docs).withColumn("h", F.xxhash64("text"))
    rows = written(_set_rows(docs, n), "sets")
    named = rows.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("sid"), "n", "parts", "h")
    ids = named.drop("parts", "h")
    rep = written(named.where("n > 0 AND doc_id IS NOT NULL").groupBy("sid").agg(F.min(F.struct("doc_id", "h")).alias("d"), F.first("n").alias("n"), F.first("parts").alias("parts")).select("sid", "d.*", "n", "parts"), "representatives")
    top = rows.where("kind = 1").groupBy("a").agg(F.sum("n").alias("c")).where("c >= 32").orderBy(F.desc("c"), "a").limit(max_frequent).toArrow()
    hot, count = top["a"].to_numpy().view(np.uint64), top["c"].to_numpy().astype(np.float64)
    by = np.argsort(hot)
    frequent = spark.sparkContext.broadcast(Frequent(hot[by], (1 + np.floor(np.log2(np.maximum(count[by], 1)))).astype(np.int8)))

    # Prefix rows of shingles that two different sets have.
    w = Window.partitionBy("s")
    pre = _prefix_rows(docs.where("doc_id IS NOT NULL"), n, share, frequent)
    pre = pre.withColumn("lo", F.min("sid").over(w)).withColumn("hi", F.max("sid").over(w)).where("lo <> hi").select("s", "sid", "n", "i").distinct()
    groups = written(pre, "groups").withColumn("dist", F.lit(None).cast("double"))
    links: DataFrame | None = None
    comp: DataFrame | None = None
    near = 1 - share / 100 + 1e-9

    def classed(df: DataFrame, key: str, name: str) -> DataFrame:
        if comp is None:
            return df.withColumn(name, F.col(key))
        c = comp.select(F.col("v").alias(key), F.col("comp").alias("_c"))
        return df.join(c, key, "left").withColumn(name, F.coalesce("_c", key)).drop("_c")

    def test(pairs: DataFrame) -> DataFrame:
        """Distances of pairs (x, p); links and classes follow."""
        nonlocal links, comp
        d = _distances(docs, rep, pairs, n, share)
        found = d.where("linked").select(F.col("x").alias("a"), F.col("p").alias("b"))
        if found.limit(1).count():
            links = found if links is None else links.unionByName(found)
            comp = components(links)
        return d

    def leaves(own: DataFrame) -> DataFrame:
        """What is outside a group's largest class against the sets of other classes, as far as
        their part counts (here cut off at 127, which widens nothing) leave possible."""
        few = rep.select("sid", F.transform("parts", lambda v: F.least(v, F.lit(127)).cast("tinyint")).alias("parts"))
        own = own.join(few, "sid")
        most = own.groupBy("s", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("s").agg(F.max(F.struct("k", "c"))["c"].alias("big"))
        x = own.join(most, "s").where("c <> big").select("s", F.col("sid").alias("x"), "n", "i", F.col("c").alias("cx"), F.col("dist").alias("dx"), F.col("parts").alias("px"))
        y = own.select("s", F.col("sid").alias("p"), F.col("n").alias("np"), F.col("i").alias("ip"), F.col("c").alias("cy"), F.col("dist").alias("dy"), F.col("parts").alias("py"))
        window = F.coalesce(F.abs(F.col("dx") - F.col("dy")) <= near, F.lit(True))
        apart = F.aggregate(F.zip_with("px", "py", lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda a, d: a + d)
        near_parts = apart * (100 + share) <= (F.col("n") + F.col("np")) * (100 - share)
        both = x.join(y, "s").where((F.col("cx") != F.col("cy")) & size_ok & window & near_parts)
        return both.select(F.least("x", "p").alias("x"), F.greatest("x", "p").alias("p"))

    # What two sets share begins with their first common shingle, at places i and ip: from
    # there on there must be enough of both. (In the group of a later one this may fail; the
    # pair then comes from the group of the first.)
    size_ok = F.least(F.col("n") - F.col("i"), F.col("np") - F.col("ip")) * (100 + share) >= (F.col("n") + F.col("np")) * share
    for level in range(levels + 1):
        g = classed(groups, "sid", "c")
        of = g.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"),
                                F.min(F.struct(F.col("i").alias("ip"), _rank("sid", level).alias("r"), F.col("sid").alias("p"), F.col("n").alias("np"), F.col("c").alias("cp"))).alias("pv")).where("lo <> hi")
        groups = written(g.join(of.select("s", "m", "pv.*"), "s"), "groups")
        small = ((F.col("m") <= leaf) | F.lit(level >= levels)) & F.lit(level > 0)
        rest = groups.where(~small)
        met = rest.where((F.col("sid") != F.col("p")) & (F.col("c") != F.col("cp")) & size_ok).groupBy(F.col("sid").alias("x"), "p").agg(F.count(F.lit(1)).alias("k"), F.min("r").alias("r"))
        if level:
            pairs = written(met.select("x", "p").unionByName(leaves(groups.where(small).drop("p", "np", "ip"))).distinct(), "pairs")
            if pairs.limit(1).count():
                d = test(pairs)
            elif rest.limit(1).count():
                d = pairs.withColumn("dist", F.lit(None).cast("double"))
            else:
                break
        else:
            met = written(met, "met")
            d = test(written(met.groupBy("x").agg(F.max(F.struct(F.col("k"), (-F.col("r")).alias("r"), F.col("p").alias("p")))["p"].alias("p")), "homes"))
            other = classed(classed(met, "x", "cx"), "p", "cp").where("cx <> cp").select("x", "p").join(d.select("x", "p"), ["x", "p"], "left_anti")
            d = d.unionByName(test(written(other, "others")))
        at = d.select(F.col("x").alias("sid"), "p", F.col("dist").alias("d"))
        groups = rest.where("sid <> p").join(at, ["sid", "p"], "left").select("s", "sid", "n", "i", F.col("d").alias("dist"))
    if comp is None:
        comp = spark.createDataFrame([], "v bigint, comp bigint")
    return ids, comp


def jaccard_classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id of the class."""
    ids, comp = set_classes(docs, **how)
    c = ids.join(comp, ids["sid"] == comp["v"], "left").select("doc_id", "n", F.coalesce("comp", "sid").alias("c"))
    smallest = c.where("n > 0").groupBy(F.col("c").alias("k")).agg(F.min("doc_id").alias("smallest"))
    out = c.join(smallest, (c["c"] == smallest["k"]) & (c["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each class: that of the smallest doc_id. Rows with a null
    doc_id stay, and so do all rows of an id that stays."""
    name = fresh(docs, "kept_id")
    kept = jaccard_classes(docs, **how).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"] == F.col(name), "left").where(F.col(name).isNotNull() | docs["doc_id"].isNull()).drop(name)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id, n.n
"""
