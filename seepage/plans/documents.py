"""Documents lane: the driver's ``documents`` table at full size.

Domain = ``source``; fingerprints = quoted assignments ``name = "value"`` in
the text (field = name, value = the quoted part, ord = match index); writes =
the documents themselves, and of those with an assignment a fork in a domain of its
own (negative ids) whose values end otherwise. Same operators as the fixture lane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.operators.fingerprint import enrich
from seepage.operators.match import leak_matches
from seepage.plans.tables import table

# fixed value: the assignment pattern (same text for Java regex and RE2)
ASSIGN_RE = '([A-Za-z_][A-Za-z0-9_.-]*) *= *"([^"]+)"'
# fixed value: what a fork changes, the last character of each quoted value
EDIT_RE = '= *"([^"]+)[^"]"'


def doc_fingerprints(docs: DataFrame) -> DataFrame:
    # The pattern needs both '=' and '"': cheap byte scans skip the regex
    # for every other document.
    d = docs.where(F.col("text").contains("=") & F.col("text").contains('"')).select(
        "doc_id", "source",
        F.regexp_extract_all("text", F.lit(ASSIGN_RE), 1).alias("_f"),
        F.regexp_extract_all("text", F.lit(ASSIGN_RE), 2).alias("_v"))
    d = d.select("doc_id", "source", F.posexplode(F.arrays_zip("_f", "_v")).alias("ord", "_fv"))
    d = d.select("doc_id", "source", F.col("ord").cast("int").alias("ord"),
                 F.col("_fv._f").alias("field"), F.col("_fv._v").alias("value"))
    return enrich(d)


def doc_match_side(fps: DataFrame) -> DataFrame:
    return fps.select(F.col("source").alias("fp_worktree"), F.col("doc_id").cast("string").alias("fp_path"),
                      F.col("ord").alias("fp_ord"), F.col("field").alias("secret_field"),
                      "classification", "value_bin", "vlen")


def doc_writes(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("write_id"), F.lit(None).cast("timestamp").alias("ts"),
        F.col("doc_id").cast("string").alias("target_path"), F.col("source").alias("target_worktree"),
        F.col("text").cast("binary").alias("content_bin"),
        F.lit(0).cast("bigint").alias("target_agent_pid"))


def with_forks(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "source", "text").where(F.col("text").isNotNull())
    forks = d.where(F.col("text").contains("=") & F.col("text").contains('"')).select(
        (-1 - F.col("doc_id")).alias("doc_id"), F.concat("source", F.lit("-fork")).alias("source"),
        F.regexp_replace("text", EDIT_RE, '= "$1Z"').alias("text"))
    return d.unionByName(forks)


def doc_leaks(spark: SparkSession, sf_dir: str, kinds=("exact",)) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    m = leak_matches(doc_writes(with_forks(docs)), doc_match_side(doc_fingerprints(docs)), kinds)
    return m.select(F.col("write_id").alias("doc_id"), F.col("target_worktree").alias("source"),
                    F.col("fp_path").cast("bigint").alias("source_doc_id"),
                    F.col("fp_worktree").alias("source_domain"), F.col("fp_ord").alias("source_ord"),
                    F.col("secret_field").alias("field"), "match_kind")
