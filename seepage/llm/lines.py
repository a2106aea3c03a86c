"""Operator 1, line dedup over deletion neighbourhoods [native].

A line (a part of a text between line feeds that has a word) is removed if an earlier line of
the corpus, in order of (doc_id, line number), is within one edit of it: equal, or one
character replaced, inserted or deleted. The earliest stays. Only built-in functions run.

1. Equal lines: two 64-bit hashes of each line, aggregated to the earliest place before
   anything else, so a very common line costs a row for each task.
2. Halves. Of two lines within one edit, either the left or the right part (as the shorter
   line's length is halved) is equal. Each distinct line emits hashed keys of both parts, in two
   roles: as a line of its own length, and as the longer one of a pair. A line goes on where its
   key meets a partner in the right role. What is left of the line is halved again, ``halvings``
   times in all, so that only short stretches with a possible edit remain; most lines end here.
3. Deletion neighbourhood of that stretch: all its variants with one character deleted, hashed
   with the key of what surrounds it. Lines of one length that share a variant of one
   position differ by a replacement; a line that equals a longer one's variant differs by an
   insertion. Each line is only compared with the earliest line of its variant, so no pairs of
   a group are formed: ``levenshtein`` verifies that one.

Hashes have 64 bits (128 for whole lines); a collision among candidates is caught by the edit
distance but may hide a further candidate of the same variant.

Defined results: null and empty texts have no lines; rows of equal doc_id and line number count as
the same place, so none of them is earlier than another, but equal lines in different places of one
document are; rows with a null doc_id keep all their lines and count for none; empty table: no
rows; further columns are ignored (``dedup_lines`` keeps them). Very long lines only pay for
their last stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seepage.llm.common import fresh, table, written

GAPS = " \t\n\x0b\f\r"
MAX_BROADCAST_ROWS = 1_000_000


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, no, line: the lines that have a word."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "line"))
    return d.where(F.btrim("line", F.lit(GAPS)) != "")


def _id(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line, F.length(line)).alias("h2")]


def _halved(e: DataFrame, rest: Column) -> DataFrame:
    """Both halves of what is left: role 0 holds m characters from off, role 1 one more. The
    new key takes in the half that is equal; the other one is left."""
    h = F.floor(F.col("m") / 2).cast("int")
    left = F.struct(F.xxhash64("k", F.lit("left"), F.substring(rest, F.lit(1), h)).alias("k"), (F.col("off") + h).alias("off"), (F.col("m") - h).alias("m"))
    tail = F.col("m") - h
    right = F.struct(F.xxhash64("k", F.lit("right"), F.substring(rest, F.col("m") + F.col("role") - tail + 1, tail)).alias("k"), F.col("off").alias("off"), h.alias("m"))
    keep = [c for c in e.columns if c not in ("k", "off", "m")]
    return e.select(*keep, F.explode(F.array(left, right)).alias("x")).select(*keep, "x.*")


def _met(e: DataFrame) -> DataFrame:
    """Entries whose key has a partner: another line of role 0, or for role 0 one of role 1."""
    w = Window.partitionBy("k")
    lo, hi = F.min(F.when(F.col("role") == 0, F.col("h1"))).over(w), F.max(F.when(F.col("role") == 0, F.col("h1"))).over(w)
    e = e.withColumns({"lo": lo, "hi": hi, "longer": F.max("role").over(w)})
    own = F.col("role") == 0
    return e.where((own & ((F.col("lo") != F.col("hi")) | (F.col("longer") == 1))) | (~own & F.col("lo").isNotNull())).drop("lo", "hi", "longer").distinct()


def _entries(line: Column) -> Column:
    """A line's two roles before any halving: key, off, m, role."""
    n = F.length(line)
    return F.array(*[F.struct(F.xxhash64(n - r).alias("k"), F.lit(0).alias("off"), (n - r).cast("int").alias("m"), F.lit(r).alias("role")) for r in (0, 1)])


def near_earlier(docs: DataFrame, halvings: int = 4) -> DataFrame:
    """(h1, h2, doc_id, no, removed) for each distinct line with its earliest place: whether an
    earlier line is within one edit."""
    ln = _lines(docs.where("doc_id IS NOT NULL"))
    # One pass over the texts: whole-line hashes and the four keys of the first halving.
    first = ln.select(F.struct("doc_id", "no").alias("place"), "line", *_id(F.col("line")), F.explode(_entries(F.col("line"))).alias("e"))
    first = first.select("place", "line", "h1", "h2", "e.*").where("m >= 0")
    keyed = _halved(first, F.col("line")).groupBy("h1", "h2", "role", "k", "off", "m").agg(F.min("place").alias("place"))
    keyed = written(keyed, "line-keys")
    lines = keyed.groupBy("h1", "h2").agg(F.min("place").alias("place"))
    left = written(_met(keyed.drop("place")), "line-candidates")
    # Texts of the candidates, from their earliest places.
    wanted = written(lines.join(left.select("h1", "h2").distinct(), ["h1", "h2"]).select("h1", "h2", "place"), "line-places")
    ask = wanted.select(F.col("place.doc_id").alias("a_id"), F.col("place.no").alias("a_no"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), "place")
    if ask.count() <= MAX_BROADCAST_ROWS:
        ask = F.broadcast(ask)
    texts = ln.withColumns({"h1": _id(F.col("line"))[0], "h2": _id(F.col("line"))[1]})
    texts = texts.join(ask, (texts["doc_id"] == ask["a_id"]) & (texts["no"] == ask["a_no"]) & (texts["h1"] == ask["a1"]) & (texts["h2"] == ask["a2"]))
    texts = written(texts.select("h1", "h2", "place", "line").dropDuplicates(["h1", "h2"]), "line-texts")
    stretch = F.substring(F.col("line"), F.col("off") + 1, F.col("m") + F.col("role"))
    for _ in range(halvings - 1):
        more = _halved(left.where("m > 8").join(texts, ["h1", "h2"]), stretch).drop("line", "place")
        left = written(_met(more).unionByName(left.where("m <= 8")), "line-candidates")
    # Variants. Role 0 also stands for itself (position 0), to be met by longer lines' variants.
    e = left.join(texts, ["h1", "h2"]).withColumn("r", stretch)
    i = F.col("i")
    cut = F.xxhash64("k", F.concat(F.substring(F.col("r"), F.lit(1), i - 1), F.substring(F.col("r"), i + 1, F.length("r"))))
    v = e.select("h1", "h2", "place", "role", "k", "r", F.explode(F.sequence(F.lit(0), F.length("r"))).alias("i")).where("i > 0 OR role = 0")
    v = v.select("h1", "h2", "place", "role", F.when(i == 0, F.xxhash64("k", "r")).otherwise(cut).alias("v"),
                 F.when((F.col("role") == 0) & (i > 0), i).otherwise(0).alias("i")).distinct()
    w = Window.partitionBy("v", "i")
    own = F.col("role") == 0
    here = F.struct("place", "h1", "h2")
    v = v.withColumns({"short": F.min(F.when(own, here)).over(w), "long": F.min(F.when(~own, here)).over(w)})
    # replacements: the earliest of the same position; insertions: the other role's earliest
    other = F.when(i > 0, F.col("short")).otherwise(F.when(own, F.col("long")).otherwise(F.col("short")))
    near = v.withColumn("o", other).where(F.col("o.place") < F.col("place")).select("h1", "h2", F.col("o.h1").alias("o1"), F.col("o.h2").alias("o2")).distinct()
    a, b = texts.select("h1", "h2", "line"), texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("o_line"))
    near = near.join(a, ["h1", "h2"]).join(b, ["o1", "o2"]).where(F.levenshtein("line", "o_line", 1) >= 0)
    near = near.select("h1", "h2").distinct().withColumn("near", F.lit(True))
    return lines.join(near, ["h1", "h2"], "left").select("h1", "h2", "place.doc_id", "place.no", F.coalesce("near", F.lit(False)).alias("removed"))


def removed_lines(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, no, removed) for every line of every row."""
    first = near_earlier(docs, **how).select("h1", "h2", F.col("doc_id").alias("f_id"), F.col("no").alias("f_no"), F.col("removed").alias("near"))
    ln = _lines(docs).select("doc_id", "no", *_id(F.col("line")))
    j = ln.join(first, ["h1", "h2"], "left")
    earliest = (F.col("f_id") == F.col("doc_id")) & (F.col("f_no") == F.col("no"))
    return j.select("doc_id", "no", F.coalesce(F.col("doc_id").isNotNull() & (F.col("near") | ~earliest), F.lit(False)).alias("removed"))


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with their texts cut down to the lines that stay (lines without words stay)."""
    name, key = fresh(docs, "gone_lines"), fresh(docs, "gone_id")
    gone = removed_lines(docs, **how).where("removed").groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("no").alias(name))
    d = docs.join(gone, docs["doc_id"] == gone[key], "left")
    keep = F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.array_contains(F.col(name), i), F.lit(False)) | (F.btrim(x, F.lit(GAPS)) == ""))
    return d.withColumn("text", F.array_join(keep, "\n")).drop(key, name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_lines, n_removed and the removed line numbers (from 0), comma-joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    g = removed_lines(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count(F.when(F.col("removed"), 1)).alias("n_removed"),
                                                  F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("no")))), lambda x: x.cast("string")), ",").alias("removed"))
    g = g.withColumnRenamed("doc_id", "g_id")
    d = docs.select("doc_id")
    return d.join(g, d["doc_id"].eqNullSafe(g["g_id"]), "left").select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"))


ORACLE_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents
), ln AS (
  SELECT doc_id, i - 1 AS no, p[i] AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)
  WHERE regexp_matches(p[i], '[^\x20\x09-\x0D]')
), firsts AS (
  SELECT line, length(line) AS n, min({'d': doc_id, 'n': no}) AS place FROM ln GROUP BY line
), keys AS (
  SELECT line, n, place, m, 'l' AS side, left(line, m // 2) AS half FROM (SELECT *, unnest([n, n - 1]) AS m FROM firsts)
  UNION ALL SELECT line, n, place, m, 'r', right(line, m - m // 2) FROM (SELECT *, unnest([n, n - 1]) AS m FROM firsts)
), pairs AS (
  SELECT DISTINCT a.line AS x, b.line AS y, a.n AS nx, b.n AS ny, a.place AS px, b.place AS py
  FROM keys a JOIN keys b ON a.m = b.m AND a.side = b.side AND a.half = b.half
  WHERE a.line <> b.line AND a.place > b.place AND a.m = least(a.n, b.n) AND abs(a.n - b.n) <= 1
), near AS (
  SELECT DISTINCT x FROM pairs WHERE len(CASE
    WHEN nx = ny THEN [i FOR i IN range(1, nx + 1) IF left(x, i - 1) = left(y, i - 1) AND substr(x, i + 1) = substr(y, i + 1)]
    WHEN nx > ny THEN [i FOR i IN range(1, nx + 1) IF left(x, i - 1) = left(y, i - 1) AND substr(x, i + 1) = substr(y, i)]
    ELSE [i FOR i IN range(1, ny + 1) IF left(x, i - 1) = left(y, i - 1) AND substr(x, i) = substr(y, i + 1)] END) > 0
), judged AS (
  SELECT ln.doc_id, ln.no, (near.x IS NOT NULL OR NOT (firsts.place.d = ln.doc_id AND firsts.place.n = ln.no)) AS removed
  FROM ln JOIN firsts USING (line) LEFT JOIN near ON near.x = ln.line
)
SELECT d.doc_id, count(no) AS n_lines, count(no) FILTER (removed) AS n_removed,
  coalesce(string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) FILTER (removed), '') AS removed
FROM documents d LEFT JOIN judged USING (doc_id) GROUP BY d.doc_id
"""
