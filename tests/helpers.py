"""Literal-DataFrame builders and a plain-Python reading of the match rule."""

from pyspark.sql import functions as F


def fps_df(spark, rows):
    """rows: (worktree, field, value) -> matcher-side fingerprints."""
    from seepage.operators.fingerprint import enrich
    df = spark.createDataFrame([(wt, f"/r/{wt}/.env", i, f, v) for i, (wt, f, v) in enumerate(rows)],
                               "worktree string, path string, ord int, field string, value string")
    e = enrich(df)
    return e.select(F.col("worktree").alias("fp_worktree"), F.col("path").alias("fp_path"),
                    F.col("ord").alias("fp_ord"), F.col("field").alias("secret_field"),
                    "classification", "value_bin", "vlen")


def writes_df(spark, rows):
    """rows: (write_id, content, target_worktree, target_path, pid)."""
    df = spark.createDataFrame(rows, "write_id long, content string, target_worktree string, "
                                     "target_path string, target_agent_pid long")
    return df.select("write_id", F.lit(None).cast("timestamp").alias("ts"), "target_path", "target_worktree",
                     F.col("content").cast("binary").alias("content_bin"), "target_agent_pid")


def grams(b: bytes):
    return {b[i:i + 3] for i in range(len(b) - 2)}


def sim(a: bytes, b: bytes) -> float:
    ga, gb = grams(a), grams(b)
    if not ga and not gb:
        return 1.0
    inter = len(ga & gb)
    union = len(ga) + len(gb) - inter
    return 0.0 if union == 0 else inter / union


def brute_match(content: bytes, value: bytes):
    """None, 'exact' or 'fuzzy' by the plain definition."""
    if not content or len(value) < 8:
        return None
    if value in content:
        return "exact"
    L = len(value)
    if len(content) < L:
        return "fuzzy" if (content == value or sim(content, value) >= 0.9) else None
    for i in range(len(content) - L + 1):
        if sim(content[i:i + L], value) >= 0.9:
            return "fuzzy"
    return None
