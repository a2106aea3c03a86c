"""Operator 12, approximate nearest neighbours: randomly rotated one-bit codes, reranked within bounds.

Index (``build_index``): with c the mean of a sample of at most ``SAMPLE`` vectors, each vector's rest
x - c is turned by a random rotation P (fixed seed) and kept as the signs of its coordinates,
packed, with two correction scalars. If o is the turned rest's direction, s = signs / sqrt(D) and
a = <s, o>, then s = a o + sqrt(1 - a^2) e with a random direction e orthogonal to o, so that <o, q> =
<s, q> / a less an error sqrt(1 / a^2 - 1) <e, q>, whose standard deviation is at most
sqrt(1 / a^2 - 1) |q| / sqrt(D - 1). So scale = |x - c| / a makes a code's product an estimate of
<x - c, q>, and slack = |x - c| sqrt(1 / a^2 - 1) / sqrt(D - 1) gives its bound: ``errors`` (3)
standard deviations.

Search (``search``): queries are rounded to ``PLANES`` bit planes, so that <s, q> is a few ANDs and bit
counts of 64-bit words; the rounding's largest error is added to the bound. A vector is reranked,
by its product with the query in double precision, summed in one fixed order, if its estimate plus its bound
reaches the query's threshold: the k-th best product found so far. The index lies in parts,
each ``GROWTH`` times the one before, searched one after the other; what a part finds sets the
threshold for the next one, so about k * GROWTH rows of a part pass for a query, however large
the index is. Tasks return at most k rows a query.

The first part has no threshold and is searched exactly. What is lost: a vector whose error is above
the bound, about one in 700 of those just at the threshold. Recall is measured in the tests and the README.

Work: queries times rows, each pair a word operation for 64 dimensions; queries go out in broadcasts of at
most ``QUERY_BYTES``, one after the other, each against the whole index in its blocks.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do
rows of a null vec_id, nor vectors of another length than the commonest one (of equally common ones the
longest); repeated rows are candidates of their own, but rows of a query's vec_id are its own; a query
id that occurs n times is searched for each of its different vectors (ranks start again for each);
fewer candidates than k: all of them; ties go to the smaller vec_id; empty table: no rows; further columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seepage.llm.common import Packed, table, written

K, EVERY = 20, 20
SAMPLE = 4096
#: Rows of the first part and of a file, and how many times larger each next part is.
FIRST, GROWTH = 16_384, 16
PLANES = 8
#: Bytes of query vectors in one broadcast.
QUERY_BYTES = 32 << 20
#: Rows and queries that are estimated together, and pairs that are reranked together.
BLOCK, PAIRS = 1024, 1 << 17


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>): the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    common = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("v") == (common.n if common else 0))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


class Space(Packed):
    """What codes and queries share: the centre and the rotation."""

    def __init__(self, centre: np.ndarray, seed: int = 12):
        self.dims, self.centre = len(centre), centre
        turn, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.dims, self.dims)))
        self.turn = turn * np.sign(np.diag(r))

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(packed signs as 64-bit words, scale, slack) of each row."""
        y = (x - self.centre) @ self.turn
        norm, reach = np.sqrt((y * y).sum(axis=1)), np.abs(y).sum(axis=1) / np.sqrt(self.dims)
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(norm > 0, norm * norm / reach, 0.0)
            slack = np.where(norm > 0, np.sqrt(np.maximum(0.0, scale * scale - norm * norm)), 0.0) / np.sqrt(max(1, self.dims - 1))
        bits = np.zeros((len(x), -(-self.dims // 64) * 64), np.uint8)
        bits[:, :self.dims] = y > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8"), scale, slack

    def planes(self, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """(bit planes, step, least, sum) of the turned queries' coordinates, rounded to 2 ** PLANES levels, and
        what a product needs besides: <centre, q>, the largest effect of the rounding, the norm."""
        y = q @ self.turn
        low = y.min(axis=1)
        step = np.maximum((y.max(axis=1) - low) / (2 ** PLANES - 1), 1e-300)
        level = np.rint((y - low[:, None]) / step[:, None]).astype(np.uint16)
        bits = np.zeros((PLANES, len(q), -(-self.dims // 64) * 64), np.uint8)
        for j in range(PLANES):
            bits[j, :, :self.dims] = level >> j & 1
        return (np.packbits(bits, axis=2, bitorder="little").view("<u8"), step, low, low * self.dims + step * level.sum(axis=1),
                q @ self.centre, step * np.sqrt(self.dims) / 2, np.sqrt((q * q).sum(axis=1)))


def _estimates(words: np.ndarray, scale: np.ndarray, slack: np.ndarray, q, dims: int, errors: float) -> np.ndarray:
    """For each row and query the most that the product can be, by estimate and bound."""
    planes, step, low, total, centre, rounding, norm = q
    dot = np.zeros((len(words), planes.shape[1]), np.int32)
    for j in range(PLANES):
        for w in range(words.shape[1]):
            dot += np.bitwise_count(words[:, w:w + 1] & planes[j][None, :, w]).astype(np.int32) << j
    ones = np.bitwise_count(words).sum(axis=1).astype(np.float64)
    signed = (2 * (step * dot + low * ones[:, None]) - total) / np.sqrt(dims)
    return centre + scale[:, None] * (signed + rounding) + errors * slack[:, None] * norm


def build_index(v: DataFrame, seed: int = 12) -> tuple[list[DataFrame], Space]:
    """(parts of vec_id, v, words, scale, slack; the space). Every vector is in one part; all are written."""
    chosen = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    space = Space(np.mean([r.v for r in chosen], axis=0) if chosen else np.zeros(1), seed)
    dims = space.dims

    def encode(tables):
        for t in tables:
            words, scale, slack = space.codes(_matrix(t["v"], dims))
            yield pa.RecordBatch.from_arrays([t["vec_id"], t["v"], pa.array([w.tobytes() for w in words], pa.binary()), pa.array(scale), pa.array(slack)], ["vec_id", "v", "words", "scale", "slack"])

    n = v.count()
    sizes = [FIRST]
    while sum(sizes) < n:
        sizes.append(sizes[-1] * GROWTH)
    # A row's part by its hash: shares in proportion to the sizes, whatever ids there are.
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) / float(1 << 30) * max(n, FIRST)
    parts, begin = [], 0
    for i, size in enumerate(sizes):
        mine = v.where((place >= begin) & (place < begin + size)) if i + 1 < len(sizes) else v.where(place >= begin)
        files = max(1, -(-min(size, n - begin) // FIRST))
        parts.append(written(mine.repartition(files).mapInArrow(encode, "vec_id bigint, v array<double>, words binary, scale double, slack double"), "codes"))
        begin += size
    return parts, space


class _Best:
    """The k best products found for each query, and the threshold they set."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k, self.held, self.rows = least.copy(), k, [], 0

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.least[q]
        self.held.append((q[keep], ids[keep], score[keep]))
        self.rows += int(keep.sum())
        if self.rows > max(PAIRS, self.k * len(self.least)):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, score = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
        keep = rank < self.k
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], score[last])
        self.held, self.rows = [(q[keep], ids[keep], score[keep])], int(keep.sum())
        return self.held[0]


class _Queries(Packed):
    """One broadcast: the queries and the product that each already has k of."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray):
        self.ids, self.vectors, self.least = ids, vectors, least


class _Scan:
    """One part of the index against one broadcast of queries."""

    def __init__(self, queries, space: Space, k: int, errors: float):
        self.queries, self.space, self.k, self.errors = queries, space, k, errors

    def __call__(self, tables):
        ids, vectors, dims = self.queries.value.ids, self.queries.value.vectors, self.space.dims
        blocks = [(np.arange(i, min(i + BLOCK, len(ids))), self.space.planes(vectors[i:i + BLOCK])) for i in range(0, len(ids), BLOCK)]
        best = _Best(self.queries.value.least, self.k)
        for t in tables:
            own, x = t["vec_id"].to_numpy(zero_copy_only=False), _matrix(t["v"], dims)
            words = np.frombuffer(b"".join(t["words"].to_pylist()), "<u8").reshape(len(own), -1)
            scale, slack = (t[c].to_numpy(zero_copy_only=False) for c in ("scale", "slack"))
            for a in range(0, len(own), BLOCK):
                at = slice(a, a + BLOCK)
                for number, q in blocks:
                    least = best.least[number]
                    most = _estimates(words[at], scale[at], slack[at], q, dims, self.errors)
                    # a hair lower, for the rounding of the estimate's own sums
                    row, query = np.nonzero((most >= least - 1e-9 * (1 + np.abs(least))) & (own[at][:, None] != ids[number]))
                    for i in range(0, len(row), PAIRS):
                        r, n = row[i:i + PAIRS] + a, number[query[i:i + PAIRS]]
                        best.add(n, own[r], (x[r] * vectors[n]).sum(axis=1))
        q, found, score = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids[q], pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], ["q", "query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(parts: list[DataFrame], space: Space, queries: DataFrame, k: int = K, errors: float = 3.0, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score for queries (vec_id, v)."""
    spark = queries.sparkSession
    queries = queries.distinct()
    n = queries.count()
    rounds = max(1, -(-n * 8 * (space.dims + 2) // query_bytes))
    out = []
    for r in range(rounds):
        # about query_bytes: the hash deals the rows out evenly
        rows = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(rounds)) == r).orderBy("vec_id", "v").collect()
        ids, vectors = np.array([x.vec_id for x in rows], np.int64), np.array([x.v for x in rows], np.float64).reshape(len(rows), space.dims)
        least, found = np.full(len(rows), -np.inf), None
        for i, part in enumerate(parts):
            sent = spark.sparkContext.broadcast(_Queries(ids, vectors, least))
            hits = part.mapInArrow(_Scan(sent, space, k, errors), "q bigint, query_id bigint, vec_id bigint, score double")
            # the best of this part and those before it: k rows a query, of which the driver takes the last one's score
            found = written(_top(hits if found is None else hits.unionByName(found.drop("rank")), k), "found")
            sent.unpersist()
            for x in found.where(F.col("rank") == k).select("q", "score").collect() if i + 1 < len(parts) else ():
                least[x.q] = x.score
        out.append(found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K, **how) -> DataFrame:
    """The k nearest of every vector whose vec_id is divisible by ``every``."""
    v = written(valid_vectors(vectors), "vectors")
    parts, space = build_index(v)
    return search(parts, space, v.where(F.col("vec_id") % every == 0), k, **how)


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
