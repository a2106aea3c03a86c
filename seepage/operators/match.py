"""Leak matching: J4 (other domains), F4 (min length), J5 exact, J6 fuzzy, J7.

Inputs
  writes: write_id, target_worktree, content_bin (+ any pass-through columns)
  fps:    fp_worktree, fp_path, fp_ord, secret_field, classification, value_bin, vlen
Fingerprint key = (fp_worktree, fp_path, fp_ord); one event per (write, key).

Matching runs on the distinct values (nested roots and copied files repeat them); what a
write matched is joined back to the fingerprints afterwards, on value ids, where the
other-domain rule (J4) applies. One reading of the contents finds what may match
(gramscan.py: filters of fixed size, tested on every byte); only thin rows (content hash,
position, gram) leave it, and they meet the values' grams in one join: broadcast if those
fit the measured bound, else by a shuffle of the thin rows, so that the number of values
changes neither the number of readings nor what is read. The fuzzy rows of a common trigram would be contents times
values; while the values' prefix trigrams fit a bound, the scan itself meets them and hands out window ranges.

J5 exact: each value has one anchor, its rarest 8-byte gram among the values, at offset s (so
common beginnings, "-----BEGIN", "postgres://", are not probed). An occurrence at p shows the
anchor at p + s.

J6 fuzzy, trigram prefix filter. A window W matches V iff 10|W∩V| >= 9|W∪V|,
which needs |W∩V| >= m = ceil(0.9 T), T = |trigrams(V)|. So among any
T - m + 2 trigrams of V, W holds at least 2 (pigeonhole; 1 if V has no T - m + 2). V emits its
T - m + 2 rarest trigrams (rarity = frequency among all values), numbered. Hits are
counted per content hash, value and stretch of two buckets of L positions (a window starting
in bucket b ends before bucket b + 2), so far apart hits do not add up: two different
trigrams are there iff the smallest and the largest number differ, so sums of hits need four
numbers a group and collapse before they are shuffled, copies of a content too.

Candidates, exact and fuzzy, go back to the contents in as many bounded broadcasts as their
measured size asks for (it follows what matches, not how many values there are): an exact one
compares the bytes at p, a fuzzy one tests the windows that can hold it, at most 2 L bytes, unless the
value occurs exactly. Copies of a content are tested once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seepage.functions import columns as C
from seepage.functions import constants as K
from seepage.functions.similarity import fuzzy_window_udf
from seepage.operators import broadcast, gramscan
from seepage.operators.broadcast import bounded_broadcast, broadcast_slices, hold
from seepage.operators.gramscan import ANCHOR, EXACT, FOUND, FUZZY

FP_KEY = ["fp_worktree", "fp_path", "fp_ord"]
_KINDS = {"exact": EXACT, "fuzzy": FUZZY}
#: Offsets at which a value's anchor is sought: the rarest gram there is found as well as any.
_ANCHOR_OFFSETS = 4096
#: Bytes that a prefix trigram takes in the scan's index, its share of the values' ids and lengths included.
_INDEX_ROW = 32


def other_domain_counts(targets: DataFrame, fps: DataFrame) -> DataFrame:
    """J4 + F4 as counts: for each receiving root, the fingerprints it is
    matched against = all values of >= 8 bytes minus its own. Built from
    per-root counts (partial aggregation); no pair relation is formed.

    targets: target_worktree (one row per receiving root or per write)."""
    long = fps.where(F.col("vlen") >= K.MIN_MATCH_LEN)
    # one row per root, read for the join and for the total: the fingerprints are made once
    per = hold(long.groupBy(F.col("fp_worktree").alias("wt")).agg(F.count(F.lit(1)).alias("c")))
    t = targets.select(F.col("target_worktree").alias("wt")).distinct()
    total = F.coalesce(per.agg(F.sum("c")).scalar(), F.lit(0))
    return t.join(per, "wt", "left").select(F.col("wt").alias("target_worktree"),
                                            (total - F.coalesce("c", F.lit(0))).cast("bigint").alias("n_candidates"))


def distinct_values(fps: DataFrame) -> DataFrame:
    """vid, value_bin, vlen: the values that take part in matching, once each."""
    v = fps.where(F.col("vlen") >= K.MIN_MATCH_LEN).select("value_bin", "vlen").distinct()
    return v.select(F.unhex(F.md5("value_bin")).alias("vid"), "value_bin", "vlen")


def anchors(values: DataFrame) -> DataFrame:
    """(vid, off, vlen, g): each value's rarest 8-byte gram among all values' grams."""
    last = F.least(F.col("vlen") - ANCHOR, F.lit(_ANCHOR_OFFSETS))
    g = values.select("vid", "vlen", F.posexplode(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring("value_bin", i + 1, ANCHOR))).alias("off", "g"))
    freq = g.groupBy("g").agg(F.count(F.lit(1)).alias("_df"))
    least = g.join(freq, "g").groupBy("vid", "vlen").agg(F.min(F.struct("_df", "off", "g")).alias("_a"))
    return least.select("vid", "_a.off", "vlen", "_a.g")


def prefix_trigrams(values: DataFrame) -> DataFrame:
    """(vid, vlen, key, idx, need): per value its P = min(T, T - m + 2) rarest distinct
    trigrams as numbers, m = ceil(0.9 T), and need = P - (T - m): a matching window misses at
    most T - m trigrams of V, so it holds at least ``need`` of these P, 2 or 1."""
    f = values.withColumn("_vt", C.trigrams(F.col("value_bin")))
    tri = f.select("vid", "vlen", F.size("_vt").alias("_ntri"), F.explode("_vt").alias("_tri"))
    freq = tri.groupBy("_tri").agg(F.count(F.lit(1)).alias("_df"))
    tri = tri.join(freq, "_tri")
    # bounded by one value's length
    r = F.row_number().over(Window.partitionBy("vid").orderBy("_df", "_tri"))
    slack = F.col("_ntri") - F.expr("CAST((9 * _ntri + 9) DIV 10 AS BIGINT)")  # T - m
    p = F.least(F.col("_ntri"), slack + F.lit(2))
    tri = tri.withColumn("idx", r).where(F.col("idx") <= p)
    return tri.select("vid", "vlen", F.conv(F.hex("_tri"), 16, 10).cast("bigint").alias("key"), "idx", (p - slack).cast("int").alias("need"))


@dataclass
class Probes:
    """What matching needs of the fingerprints: built once, used for any number of write
    batches (a stream's index is fixed at start). All parts are held until release()."""
    fps: DataFrame
    values: DataFrame
    probe: DataFrame
    joined: DataFrame  # what the scan's rows are joined to: without the fuzzy rows if the index has them
    filters: object
    kinds: tuple[int, ...]
    index: object = None


def probe_tables(fps: DataFrame, kinds=("exact", "fuzzy")) -> Probes:
    fps = hold(fps)
    values = hold(distinct_values(fps))
    found, own = tuple(_KINDS[k] for k in kinds), []
    if EXACT in found:
        a = gramscan.encode_anchors(anchors(values))
        own.append(a.select(F.lit(EXACT).alias("kind"), "key", "vid", "vlen", "off", F.lit(1).alias("idx"), F.lit(1).alias("need")))
    if FUZZY in found:
        t = prefix_trigrams(values)
        own.append(t.select(F.lit(FUZZY).alias("kind"), "key", "vid", "vlen", F.lit(0).alias("off"), "idx", "need"))
    probe, small = bounded_broadcast(own[0] if len(own) == 1 else own[0].unionByName(own[1]), sensitive=True)
    n = {r.kind: r.n for r in probe.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    sc = fps.sparkSession.sparkContext
    filters = sc.broadcast(gramscan.build_filters(probe, gramscan.filter_words(n.get(EXACT, 0))))
    joined, index = probe, None
    if FUZZY in found and _INDEX_ROW * n.get(FUZZY, 0) <= broadcast.MAX_BROADCAST_BYTES:
        index = sc.broadcast(gramscan.build_index(probe.where(F.col("kind") == FUZZY)))
        joined = probe.where(F.col("kind") == EXACT)
        joined = F.broadcast(joined) if small else bounded_broadcast(joined, sensitive=True)[0]
    return Probes(fps, values, probe, joined, filters, found, index)


def candidates(contents: DataFrame, probes: Probes) -> DataFrame:
    """(_ch, _rep, kind, vid, vlen, lo, hi): places of contents (_ch, content_bin) that may hold a value,
    an exact one at lo, a fuzzy one in a window that starts at lo .. hi (necessary, not sufficient);
    _rep is that of one of the content's copies, where the contents have it."""
    if "_rep" not in contents.columns:
        contents = contents.withColumn("_rep", F.lit(None).cast("bigint"))
    s = gramscan.scan(contents, probes.filters, probes.kinds, probes.index)
    p = probes.joined.toDF("_kind", "_key", "_vid", "_vlen", "off", "idx", "need")
    j = s.join(p, (F.col("key") == F.col("_key")) & (F.col("kind") == F.col("_kind")), "left" if probes.index else "inner")
    exact, fuzzy, found = F.col("kind") == EXACT, F.col("kind") == FUZZY, F.col("kind") == FOUND
    j = j.withColumns({"vid": F.coalesce("vid", "_vid"), "vlen": F.coalesce("vlen", "_vlen"), "need": F.coalesce("need", F.lit(1))}).where("vid IS NOT NULL")
    b = F.when(exact, F.col("pos") - F.col("off")).when(found, F.col("pos")).otherwise(F.floor(F.col("pos") / F.col("vlen"))).cast("int")
    j = j.select("_ch", "_rep", "n", "kind", "vid", "vlen", "need", "idx", "pos", "hi", F.explode(F.when(fuzzy, F.array(b, b - 1)).otherwise(F.array(b))).alias("b"))
    j = j.where((F.col("b") >= 0) & (~exact | (F.col("b") + F.col("vlen") <= F.col("n"))))
    g = j.groupBy("_ch", "kind", "vid", "vlen", "need", "b").agg(
        F.min("idx").alias("_imin"), F.max("idx").alias("_imax"), F.min("pos").alias("_tmin"), F.max("pos").alias("_tmax"),
        F.max("hi").alias("_hi"), F.min("_rep").alias("_rep"))
    g = g.where((F.col("need") <= 1) | (F.col("_imin") < F.col("_imax")))
    lo = F.greatest(F.col("b") * F.col("vlen"), F.col("_tmin") - F.col("vlen") + 3, F.lit(0))
    hi = F.least((F.col("b") + 1) * F.col("vlen") - 1, F.col("_tmax"))
    g = g.select("_ch", "_rep", F.when(exact, F.lit(EXACT)).otherwise(F.lit(FUZZY)).alias("kind"), "vid", "vlen",
                 F.when(fuzzy, lo).otherwise(F.col("b")).cast("int").alias("lo"), F.when(fuzzy, hi).when(found, F.col("_hi")).otherwise(F.col("b")).cast("int").alias("hi"))
    return g.where("lo <= hi")


def matched_values(writes: DataFrame, probes: Probes) -> DataFrame:
    """(write columns without content, vid, kind), exact else fuzzy. Each content is tested in one
    of the writes that have it; what it holds is joined to all of them, on its hash."""
    w = writes.withColumn("_ch", F.unhex(F.sha2("content_bin", 256)))
    cand = candidates(w.withColumn("_rep", F.col("write_id")), probes).join(probes.values.drop("vlen"), "vid").withColumnRenamed("_ch", "_cch")
    out = None
    for side in broadcast_slices(cand, "_cch", F.col("vlen") + F.lit(112)):
        v = w.select("write_id", "_ch", "content_bin").join(side, (F.col("_ch") == F.col("_cch")) & F.col("write_id").eqNullSafe(F.col("_rep")))
        exact = (F.col("kind") == EXACT) & (F.substring("content_bin", F.col("lo") + 1, F.col("vlen")) == F.col("value_bin"))
        # only the bytes of the windows go to Python, and nothing of an exact candidate; a shorter content is compared whole
        n = F.octet_length("content_bin")
        part = F.when(n < F.col("vlen"), F.col("content_bin")).otherwise(
            F.substring("content_bin", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("vlen")))
        part = F.when((F.col("kind") == FUZZY) & ~F.contains(F.col("content_bin"), F.col("value_bin")), part)
        v = v.withColumn("_same", exact).withColumn("_part", part).withColumn("_last", F.col("hi") - F.col("lo")).drop("content_bin")
        v = v.where("_same OR _part IS NOT NULL")
        if FUZZY in probes.kinds:
            v = v.where(F.col("_same") | fuzzy_window_udf("_part", "value_bin", F.lit(0), "_last"))
        v = v.select("_cch", "vid", "kind")
        out = v if out is None else out.unionByName(v)
    held, _ = bounded_broadcast(out.dropDuplicates(["_cch", "vid"]), width=F.lit(64), sensitive=True)
    found = w.drop("content_bin").join(held, F.col("_ch") == F.col("_cch")).drop("_ch", "_cch")
    return found.dropDuplicates(["write_id", "vid"])


def leak_matches(writes: DataFrame, fps: DataFrame | Probes, kinds=("exact", "fuzzy"), owned=None) -> DataFrame:
    """J7 core: exact else fuzzy (fuzzy pairs exclude exact ones), one row per
    (write, fingerprint key). The fingerprints, their distinct values and the probe tables
    are held (memory + disk; lost blocks are recomputed from lineage). ``owned`` adds
    target_worktree to what was found, if the writes do not have it yet."""
    probes = fps if isinstance(fps, Probes) else probe_tables(fps, kinds)
    fps = probes.fps
    found = matched_values(writes, probes)
    found = owned(found) if owned else found
    found = found.withColumn("match_kind", F.when(F.col("kind") == EXACT, F.lit(K.MATCH_EXACT)).otherwise(F.lit(K.MATCH_FUZZY))).drop("kind")
    keys = fps.select(*FP_KEY, "secret_field", "classification", "vlen", F.unhex(F.md5("value_bin")).alias("_fv"))
    j = found.join(keys, (found["vid"] == keys["_fv"]) & (found["target_worktree"] != keys["fp_worktree"]))
    return j.drop("vid", "_fv")


def event_columns(m: DataFrame) -> DataFrame:
    """Project matches to the 10 event columns (+ write_id); timestamp = write ts."""
    return m.select(
        "write_id",
        F.col("ts").alias("timestamp"),
        F.col("fp_worktree").alias("source_worktree"),
        F.lit(0).cast("bigint").alias("source_agent_pid"),
        F.col("fp_path").alias("source_path"),
        "secret_field",
        "target_worktree",
        F.col("target_agent_pid").cast("bigint").alias("target_agent_pid"),
        "target_path",
        "match_kind",
        C.severity(F.col("classification")).alias("severity"),
    )
