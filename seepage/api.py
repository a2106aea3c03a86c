"""Entry points mirroring the reference's commands, as DataFrame functions.

    scan(files, roots, procs)        -> inventory (fingerprints), per-root counts, totals
    leaks(writes, files, roots, procs) -> leak events for a batch of writes
    watch(spark, write_log_dir, ...) -> a running stream appending events to a trail
    trail_map(roots, trail)          -> nodes, per-event edges, edge rollup
    report(trail)                    -> ranked rows, per-severity counts, summary sentence

Inputs are DataFrames: roots(path), files(path, content) or the rows of
``sources.files.read_files``, procs(pid, ord, cwd), writes(write_id, ts, path, content).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seepage.operators import rollups as R
from seepage.operators.fingerprint import as_match_side, fingerprints, fingerprints_from_tree
from seepage.operators.match import event_columns
from seepage.operators.roots import actor_per_root
from seepage.plans.jobs import write_matches
from seepage.sources.tree_stream import written_files
from seepage.streaming.leak_stream import run_leak_stream


def scan(files: DataFrame, roots: DataFrame, procs: DataFrame | None = None, promote=None) -> dict:
    # rows of read_files carry their root: no second containment join
    fps = fingerprints_from_tree(files, promote) if "worktree" in files.columns else fingerprints(files, roots, promote)
    actors = actor_per_root(procs, roots) if procs is not None else \
        roots.selectExpr("path AS worktree", "CAST(0 AS BIGINT) AS agent_pid")
    return {"fingerprints": fps,
            "by_root": R.inventory_by_root(fps, roots, actors),
            "totals": R.inventory_totals(fps, roots),
            "actors": actors}


def leaks(writes: DataFrame, files: DataFrame, roots: DataFrame, procs: DataFrame | None = None) -> DataFrame:
    s = scan(files, roots, procs)
    return event_columns(write_matches(writes, as_match_side(s["fingerprints"]), roots, s["actors"]))


def watch(spark: SparkSession, write_log_dir: str | None, files: DataFrame, roots: DataFrame, trail_dir: str,
          checkpoint: str, procs: DataFrame | None = None, available_now: bool = False,
          max_files_per_trigger: int | None = None, since_ns: int | None = None):
    """Without a write log the roots' own trees are watched: files written from now on (or since a point
    in time) are the writes."""
    s = scan(files, roots, procs)
    writes = write_log_dir
    if writes is None:
        top = [r.path for r in roots.select("path").distinct().collect()]  # the source's argument is a list
        outer = [p for p in top if not any(p.startswith(q.rstrip("/") + "/") for q in top)]  # nested roots lie in these
        writes = written_files(spark, outer, since_ns)
    return run_leak_stream(spark, writes, s["fingerprints"], roots, s["actors"], trail_dir,
                           checkpoint, available_now=available_now,
                           max_files_per_trigger=max_files_per_trigger)


def trail_map(roots: DataFrame, trail: DataFrame) -> dict:
    return {"nodes": R.map_nodes(roots, trail), "edges": R.map_edges(trail),
            "edge_rollup": R.map_edges_rollup(trail), "node_count": R.count_nodes(roots, trail)}


def report(trail: DataFrame, roots: DataFrame | None = None) -> dict:
    """With roots also the header: numbers of events and worktrees, and a notice if the trail is empty."""
    head = {"header": R.report_header(roots, trail)} if roots is not None else {}
    return head | {"ranked": R.ranked_report(trail), "by_severity": R.count_by_severity(trail),
            "sentence": R.report_sentence(trail)}
