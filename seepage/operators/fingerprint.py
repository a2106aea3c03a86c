"""Fingerprint job: files under roots -> classified, hashed secret inventory.

S1/J1 -> F1 -> F2 -> F3 -> (P1 env lines | P2 blob) -> P3 -> P4, P5, P6, P11.
The raw ``value`` column exists only inside the job (matching needs it); every
query projects it away before output.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.functions import columns as C
from seepage.functions import constants as K
from seepage.operators.roots import files_in_roots, in_ignored_dir, measured_roots

FP_COLS = ["worktree", "path", "ord", "field", "value", "value_bin", "vlen",
           "value_hash", "classification", "masked"]


def content_text(df: DataFrame, col: str = "content") -> DataFrame:
    """content_str: the bytes as a string, as they are (regex functions on it decode
    them, so only use it where the text need not be cut); content_bin: the bytes."""
    t = dict(df.dtypes)[col]
    s = F.col(col).cast("string") if t == "binary" else F.col(col)
    b = F.col(col) if t == "binary" else F.col(col).cast("binary")
    return df.withColumn("content_str", s).withColumn("content_bin", b)


def secret_files(files: DataFrame, roots: DataFrame) -> DataFrame:
    """worktree, path, kind ('env' | 'blob') + content columns: J1, F1, F2, F3."""
    fr = files_in_roots(with_kind(files), roots)
    return fr.where(~in_ignored_dir(F.col("worktree"), F.col("path")))


def with_kind(files: DataFrame) -> DataFrame:
    """the files with a secret name, and how they are read."""
    name = C.basename(F.col("path"))
    return files.where(C.is_secret_file(name)).withColumn("kind", F.when(C.is_env_file(name), F.lit("env")).otherwise(F.lit("blob")))


def spread(files: DataFrame) -> DataFrame:
    """The secret files dealt over all tasks: cutting, classifying and hashing cost far more than their bytes say,
    so that a scan which puts a few megabytes into one task leaves the other cores idle."""
    spark = files.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.where(C.is_secret_file(C.basename(F.col("path")))).repartition(n)


def env_entries(sf: DataFrame) -> DataFrame:
    """P1 + P3: one row per KEY=VALUE line of env-style files.

    Lines, keys and values are cut on the bytes (one character a byte): a regex
    split of the text view would put U+FFFD in place of bytes that are not UTF-8."""
    e = sf.where(F.col("kind") == "env")
    content = F.col("content_bin") if "content_bin" in sf.columns else F.col("content_str").cast("binary")
    e = e.select("worktree", "path", F.posexplode(F.split(C.byte_view(content), "\n")).alias("ord", "raw"))
    line = C.ws_trim_view(F.col("raw"))
    e = e.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    e = e.withColumn("idx", F.instr(F.col("line"), "=")).where(F.col("idx") > 1)
    key = C.ws_trim_view(F.col("line").substr(F.lit(1), F.col("idx") - 1))
    val = C.ws_trim_view(F.col("line").substr(F.col("idx") + 1, F.length(F.col("line"))))
    e = e.select("worktree", "path", F.col("ord").cast("int").alias("ord"),
                 C.from_byte_view(key).cast("string").alias("field"),
                 C.from_byte_view(C.unquote(val)).cast("string").alias("value"))
    return e.where(F.col("value") != "")


def blob_entries(sf: DataFrame) -> DataFrame:
    """The whole trimmed content is the value, the base name the field."""
    b = sf.where(F.col("kind") == "blob")
    b = b.select("worktree", "path", F.lit(0).alias("ord"),
                 C.basename(F.col("path")).alias("field"),
                 C.ws_trim(F.col("content_str")).alias("value"))
    return b.where(F.col("value") != "")


def enrich(entries: DataFrame) -> DataFrame:
    """P4 hash, P5 mask, P6 classification, byte view and length of the value."""
    vb = F.col("value").cast("binary")
    return (entries.withColumn("value_bin", vb)
                   .withColumn("vlen", F.octet_length(vb))
                   .withColumn("value_hash", C.value_hash(vb))
                   .withColumn("classification", C.classify(F.col("value"), F.col("field")))
                   .withColumn("masked", C.mask(F.col("value"))))


def fingerprints(files: DataFrame, roots: DataFrame,
                 promote: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The inventory: one row per (root, file, entry).

    The contents of secret files are dealt over all tasks once (``spread``). Roots within the broadcast bound:
    contents are cut there, under each root that has them. Beyond it each content is cut once, whatever roots it is in, and the roots of the distinct
    paths are joined to the entries: no content is shuffled for its root."""
    if measured_roots(roots)[1]:
        sf = secret_files(content_text(spread(files)), roots)
        entries = env_entries(sf).unionByName(blob_entries(sf))
    else:
        sf = with_kind(content_text(spread(files))).withColumn("worktree", F.lit(""))
        entries = env_entries(sf).unionByName(blob_entries(sf)).drop("worktree")
        own = files_in_roots(with_kind(files.select("path")).select(F.col("path").alias("_path")).distinct(), roots, "_path")
        own = own.where(~in_ignored_dir(F.col("worktree"), F.col("_path")))
        entries = entries.join(own, entries["path"] == own["_path"]).drop("_path")
    return promote_unknown(enrich(entries), promote).select(*FP_COLS)


def fingerprints_from_tree(files: DataFrame, promote: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The inventory from S1 rows (worktree, path, content): the walk already
    pruned ignored directories and applied the name filter."""
    sf = with_kind(content_text(files))
    return promote_unknown(enrich(env_entries(sf).unionByName(blob_entries(sf))), promote).select(*FP_COLS)


def promote_unknown(fps: DataFrame, fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """V1: hand only the 'unknown' slice to ``fn`` (e.g. a model scorer as a
    pandas UDF); without one this is the identity. A hook that says it works ``in_place``
    (promote.py) gets all rows and leaves the known ones alone, so that the input is read once."""
    if fn is None:
        return fps
    if getattr(fn, "in_place", False):
        return fn(fps)
    unknown = fps.where(F.col("classification") == K.CLASS_UNKNOWN)
    known = fps.where(F.col("classification") != K.CLASS_UNKNOWN)
    return known.unionByName(fn(unknown).select(*fps.columns))


def as_match_side(fps: DataFrame) -> DataFrame:
    """Fingerprints in the shape the matcher expects."""
    return fps.select(F.col("worktree").alias("fp_worktree"), F.col("path").alias("fp_path"),
                      F.col("ord").cast("int").alias("fp_ord"), F.col("field").alias("secret_field"),
                      "classification", "value_bin", "vlen")
