"""Inventory and leak-map rollups: A1-A5, O1-O3, P8-P10, P14.

Every aggregate here is algebraic (count, min, max_by...), so Spark combines
map-side before the shuffle and a hot key (one severity or one edge holding a
third of the trail) costs one partial row per task, not a hot reducer.
Numbering (ranked report, node order) is distributed: ranges of the keys, a count
for each, a window inside them, prefix offsets over at most #ranges rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.functions import columns as C
from seepage.functions import constants as K
from seepage.session import checkpoint_dir

#: Keys in the sample that the ranges are cut from, for each range: it decides how even they are, not what they hold.
_SAMPLE = 64


def _place(key: Column, cuts: Column, n: int) -> Column:
    """How many of at most ``n`` sorted cuts are not above the key, by halving: a row costs log2(n) comparisons.
    The key is part of the start value, so that it is computed once a row, whatever it is made of."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, n.bit_length())))])
    at = lambda a, s: a["p"] + s
    step = lambda a, s: F.when((at(a, s) <= F.size(cuts)) & (F.get(cuts, at(a, s) - 1) <= a["k"]), at(a, s)).otherwise(a["p"])
    start = F.struct(F.lit(0).alias("p"), key.alias("k"))
    return F.aggregate(steps, start, lambda a, s: F.struct(step(a, s).alias("p"), a["k"].alias("k")), lambda a: a["p"])


def number_rows(df: DataFrame, order: list, out: str = "rn", partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position in ``order`` without a single-task window.

    Ranges of the keys are cut at quantiles of a bounded sample; the cuts, one row of keys, are the only
    thing kept (checkpointed, so that every reading of the rows sees the same ranges). A reading of the
    keys alone counts each range; a window inside the ranges numbers the rows, which are shuffled
    once and neither checkpointed nor read for the counts as a whole. Rows of equal keys are in the
    order of their hash, so that a key that very many rows share is cut into several ranges too.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)], F.xxhash64(*df.columns).alias("h"))
    keyed = df.withColumn("_key", key)
    thin = keyed.select("_key")
    sample = thin.orderBy(F.xxhash64("_key")).limit(_SAMPLE * n)
    cut = lambda a: F.transform(F.sequence(F.lit(1), F.lit(max(1, n - 1))), lambda i: F.get(a, F.floor(i * F.size(a) / n).cast("int")))
    cuts = sample.agg(cut(F.sort_array(F.collect_list("_key"))).alias("cuts")).checkpoint(eager=True)
    place = _place(F.col("_key"), F.col("_cuts"), n)
    counts = thin.withColumn("_cuts", cuts.scalar()).groupBy(place.alias("_part")).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(F.col("_part").alias("_range"), F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    res = keyed.withColumn("_cuts", cuts.scalar()).withColumn("_part", place).drop("_cuts")
    res = res.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy("_key")))
    res = res.join(F.broadcast(offs), F.col("_part") == F.col("_range"))  # at most n rows
    return res.withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint")).drop("_key", "_part", "_local", "_off", "_range")


# --- inventory (scan) ---------------------------------------------------------

def inventory_by_root(fps: DataFrame, roots: DataFrame, actors: DataFrame) -> DataFrame:
    """A1: worktree, agent_pid, n_fingerprints; roots without any appear with 0."""
    per = fps.groupBy("worktree").agg(F.count(F.lit(1)).alias("n_fingerprints"))
    r = roots.select(F.col("path").alias("worktree")).distinct()
    return (r.join(per, "worktree", "left").join(actors, "worktree", "left")
             .select("worktree", F.coalesce("agent_pid", F.lit(0)).cast("bigint").alias("agent_pid"),
                     F.coalesce("n_fingerprints", F.lit(0)).cast("bigint").alias("n_fingerprints")))


def inventory_totals(fps: DataFrame, roots: DataFrame) -> DataFrame:
    """A2: n_worktrees, n_fingerprints (one row)."""
    tagged = roots.select(F.lit(0).alias("_t")).unionByName(fps.select(F.lit(1).alias("_t")))
    return tagged.agg(F.count_if(F.col("_t") == 0).cast("bigint").alias("n_worktrees"),
                      F.count_if(F.col("_t") == 1).cast("bigint").alias("n_fingerprints"))


def inventory_order(fps: DataFrame) -> list:
    """O3: root, then walk order (lexical per directory = path element array), then line."""
    return [F.col("worktree"), F.split(F.col("path"), "/"), F.col("ord")]


def normalized_inventory(fps: DataFrame) -> DataFrame:
    """P11 as a rollup: normalized_field, classification, n."""
    return (fps.groupBy(C.normalize_field(F.col("field")).alias("normalized_field"), "classification")
               .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


# --- leak map / report (over a trail) ------------------------------------------

_EVENT_ORDER = ["target_path", "source_worktree", "source_path", "secret_field", "match_kind"]


def trail_order(trail: DataFrame) -> list[Column]:
    """By trail_pos if the trail has it, else by time (never by its text, which drops
    trailing zeros) and then by the event's own keys."""
    if "trail_pos" in trail.columns:
        return [F.col("trail_pos")]
    time = F.col("ts") if "ts" in trail.columns else F.col("timestamp")
    if not dict(trail.dtypes)["ts" if "ts" in trail.columns else "timestamp"].startswith("timestamp"):
        time = F.try_to_timestamp(time)
    return [time] + [F.col(c) for c in _EVENT_ORDER]


def positioned(trail: DataFrame) -> DataFrame:
    """The trail with ``trail_pos`` (from 1, in trail order) where it has none."""
    return trail if "trail_pos" in trail.columns else number_rows(trail, trail_order(trail), "trail_pos")


def count_by_severity(trail: DataFrame) -> DataFrame:
    """A3: severity, n, rank."""
    return (trail.groupBy("severity").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
                 .withColumn("severity_rank", C.severity_rank(F.col("severity")).cast("bigint")))


def report_sentence(trail: DataFrame) -> DataFrame:
    """A3: total, secrets and the summary sentence (one row, empty trail included)."""
    agg = trail.agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                    F.count_if(F.col("severity") == K.SEV_SECRET).cast("bigint").alias("secrets"))
    head = F.format_string(K.SUMMARY_HEAD_FMT, F.col("total"), F.col("secrets"))
    tail = F.when(F.col("secrets") > 0, F.lit(K.SENTENCE_ANY_SECRET)).otherwise(F.lit(K.SENTENCE_NO_SECRET))
    return agg.withColumn("sentence", F.concat(head, tail))


def report_header(roots: DataFrame, trail: DataFrame) -> DataFrame:
    """n_events, n_worktrees, notice: what a report says first; the notice is null unless the trail is
    empty, and then all that follows (one row)."""
    n = trail.agg(F.count(F.lit(1)).cast("bigint").alias("n_events")).withColumn("n_worktrees", count_nodes(roots, trail).scalar())
    return n.select("n_events", "n_worktrees", F.when(F.col("n_events") == 0, F.lit(K.EMPTY_TRAIL_NOTICE)).alias("notice"))


def ranked_report(trail: DataFrame) -> DataFrame:
    """O1 + P9 + P14: stable rank by severity, ties in trail order, from 1."""
    t = trail.withColumn("_sr", C.severity_rank(F.col("severity")))
    t = number_rows(t, [F.col("_sr")] + trail_order(trail), "rn")
    src, tgt = C.short_path(F.col("source_worktree")), C.short_path(F.col("target_worktree"))
    return t.select(
        "rn", src.alias("source"), tgt.alias("target"), F.col("secret_field").alias("field"),
        F.col("match_kind").alias("match"), "severity",
        F.format_string(K.REPORT_ROW_FMT, F.col("rn"), src, tgt, F.col("secret_field"),
                        F.col("match_kind"), F.col("severity")).alias("row_text"))


def event_summary(trail: DataFrame, id_col: str = "trail_pos") -> DataFrame:
    """P10: one human line per event."""
    trail = trail if id_col in trail.columns else positioned(trail)
    s = F.format_string(K.SUMMARY_FMT, C.rfc3339_seconds(F.col("timestamp").cast("timestamp")),
                        "source_worktree", "source_path", "target_worktree", "target_path",
                        "secret_field", "match_kind", "severity")
    return trail.select(id_col, s.alias("summary"))


def map_edges(trail: DataFrame, id_col: str = "trail_pos") -> DataFrame:
    """A5, one edge per event, in trail order."""
    trail = trail if id_col in trail.columns else positioned(trail)
    e = F.format_string(K.EDGE_FMT, C.short_path(F.col("source_worktree")), F.col("match_kind"),
                        C.short_path(F.col("target_worktree")), F.col("secret_field"), F.col("severity"))
    return trail.select(id_col, e.alias("edge_text"))


def map_edges_rollup(trail: DataFrame) -> DataFrame:
    """A5 as documented: source -> target edges with count and worst severity."""
    g = trail.groupBy(F.col("source_worktree").alias("source"), F.col("target_worktree").alias("target")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.min(C.severity_rank(F.col("severity"))).alias("_w"))
    worst = (F.when(F.col("_w") == 0, F.lit(K.SEV_SECRET)).when(F.col("_w") == 1, F.lit(K.SEV_CONFIG))
              .when(F.col("_w") == 2, F.lit(K.SEV_STATE)).otherwise(F.lit("other")))
    return g.withColumn("worst_severity", worst).drop("_w")


def map_nodes(roots: DataFrame, trail: DataFrame) -> DataFrame:
    """A4: roots first (by path), then roots first seen in the trail (source
    before target); pos from 1, label = short path."""
    # First appearance of a path = the least key: a partial aggregation. Only nodes are numbered.
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(trail_order(trail))])
    ends = F.array(F.struct(F.col("source_worktree").alias("path"), F.lit(0).alias("side")),
                   F.struct(F.col("target_worktree").alias("path"), F.lit(1).alias("side")))
    ev = trail.select(key.alias("_key"), F.explode(ends).alias("_e"))
    seen = ev.groupBy(F.col("_e.path").alias("path")).agg(F.min(F.struct("_key", F.col("_e.side"))).alias("_seen"))
    r = roots.select(F.col("path").alias("_root")).distinct()
    first = seen.join(r, seen["path"] == r["_root"], "full_outer").select(
        F.coalesce("_root", "path").alias("path"), F.when(F.col("_root").isNotNull(), 0).otherwise(1).alias("_grp"),
        F.col("_root").alias("_skey"), F.when(F.col("_root").isNull(), F.col("_seen")).alias("_nkey"))
    n = number_rows(first, ["_grp", "_skey", "_nkey"], "pos")
    return n.select("pos", "path", C.short_path(F.col("path")).alias("label"))


def count_nodes(roots: DataFrame, trail: DataFrame) -> DataFrame:
    """Number of distinct roots among worktrees and trail endpoints."""
    p = roots.select("path").unionByName(trail.select(F.col("source_worktree").alias("path"))).unionByName(
        trail.select(F.col("target_worktree").alias("path")))
    return p.agg(F.count_distinct("path").cast("bigint").alias("n_nodes"))
