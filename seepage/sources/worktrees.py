"""Captured ``git worktree list --porcelain`` texts -> one row per worktree.

A block starts at a 'worktree <path>' line and ends at a blank line or the
next 'worktree ' line; lines outside a started block and blocks with an empty
path are dropped; the last HEAD/branch line of a block wins; a 'bare' line
sets the flag; other lines are ignored; a trailing '\\r' is stripped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seepage.functions import columns as C


def worktrees_from_listing(listings: DataFrame, id_col: str = "listing_id", text_col: str = "text") -> DataFrame:
    ln = listings.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "raw"))
    ln = ln.withColumn("line", F.regexp_replace("raw", r"\r+\z", ""))
    boundary = (F.col("line") == "") | F.col("line").startswith("worktree ")
    # Each listing is one text (one row before the explode): the window is
    # bounded by that text's line count.
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ln = ln.withColumn("block", F.sum(boundary.cast("int")).over(w))

    def value_of(prefix: str):
        hit = F.col("line").startswith(prefix)
        return F.when(hit, C.ws_trim(F.substring("line", len(prefix) + 1, 1 << 30)))

    ln = (ln.withColumn("_path", F.when(F.col("line").startswith("worktree "), value_of("worktree ")))
            .withColumn("_head", value_of("HEAD "))
            .withColumn("_branch", value_of("branch ")))
    g = ln.where(F.col("block") > 0).groupBy(id_col, "block").agg(
        F.min_by("_path", "pos").alias("path"),
        F.max_by("_head", F.when(F.col("_head").isNotNull(), F.col("pos"))).alias("head"),
        F.max_by("_branch", F.when(F.col("_branch").isNotNull(), F.col("pos"))).alias("branch"),
        F.max((F.col("line") == "bare").cast("int")).alias("_bare"))
    return g.where(F.col("path").isNotNull() & (F.col("path") != "")).select(
        id_col, "path", F.coalesce("head", F.lit("")).alias("head"),
        F.coalesce("branch", F.lit("")).alias("branch"), (F.col("_bare") == 1).alias("bare"))
