"""The three jobs on the fixture relations: scan (fingerprints), watch (leak
events) and the inputs they share. Each returns a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.operators.fingerprint import as_match_side, fingerprints
from seepage.operators.match import Probes, event_columns, leak_matches
from seepage.operators.roots import actor_per_root, in_ignored_dir, measured_roots, owner_root, with_target_pid
from seepage.plans.fixtures import fixture


def fx_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(fixture(spark, sf_dir, "files_fx"), fixture(spark, sf_dir, "worktrees_fx"))


def fx_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actor_per_root(fixture(spark, sf_dir, "procs_fx"), fixture(spark, sf_dir, "worktrees_fx"))


def nonempty_writes(writes: DataFrame) -> DataFrame:
    """write_id, ts, target_path, content_bin of writes that have a content."""
    w = writes.select("write_id", "ts", F.col("path").alias("target_path"),
                      F.coalesce(F.col("content").cast("binary"), F.lit(b"").cast("binary")).alias("content_bin"))
    return w.where(F.octet_length("content_bin") > 0)


def owned(rows: DataFrame, roots: DataFrame, actors: DataFrame | None = None) -> DataFrame:
    """J2 + F1 (+ J8): rows with their target root (and its pid); those without one drop."""
    w = owner_root(rows, "target_path", roots, "target_worktree")
    w = w.where(~in_ignored_dir(F.col("target_worktree"), F.col("target_path"), F.col("target_worktree_base")))
    w = w.drop("target_worktree_base")
    if actors is not None:
        w = with_target_pid(w, actors, small=measured_roots(roots)[1])
    return w


def owned_writes(writes: DataFrame, roots: DataFrame, actors: DataFrame | None = None) -> DataFrame:
    """F5 + J2 + F1 (+ J8): writes with their target root (and its pid).

    write_id, ts, target_path, target_worktree, content_bin[, target_agent_pid]
    """
    return owned(nonempty_writes(writes), roots, actors)


def write_matches(writes: DataFrame, fps: DataFrame | Probes, roots: DataFrame, actors: DataFrame, kinds=("exact", "fuzzy")) -> DataFrame:
    """J7 on a write log. Roots within the broadcast bound drop what nobody owns before the contents are
    searched; beyond it the owners are joined to what was found, which has no contents."""
    if measured_roots(roots)[1]:
        return leak_matches(owned_writes(writes, roots, actors), fps, kinds)
    return leak_matches(nonempty_writes(writes), fps, kinds, lambda found: owned(found, roots, actors))


def fx_owned_writes(spark: SparkSession, sf_dir: str, with_pid: bool = True) -> DataFrame:
    roots = fixture(spark, sf_dir, "worktrees_fx")
    actors = fx_actors(spark, sf_dir) if with_pid else None
    return owned_writes(fixture(spark, sf_dir, "writes_fx"), roots, actors)


def fx_matches(spark: SparkSession, sf_dir: str, kinds=("exact", "fuzzy")) -> DataFrame:
    fps = as_match_side(fx_fingerprints(spark, sf_dir))
    return write_matches(fixture(spark, sf_dir, "writes_fx"), fps, fixture(spark, sf_dir, "worktrees_fx"), fx_actors(spark, sf_dir), kinds)


def fx_leak_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 event columns + write_id."""
    return event_columns(fx_matches(spark, sf_dir))
