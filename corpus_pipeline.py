"""The corpus pipeline: quality rules, one document of each near-copy class, no benchmark
leaks, sources mixed to target weights (documents are repeated, none is dropped), token files.

Each stage takes (spark, docs, sf_dir) and works on what the one before it kept; run()
writes each stage's result to the shared folder and reads it again. The first four stages
return the columns of ``documents``; the last one returns, read back from the files, a row
per document and copy: doc_id, start, n_tokens, ids_crc32. A stage begins by deleting the
intermediates that earlier ones have left in the shared folder, but for what its own input reads.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from seepage.llm import bitplanes, decontaminate, jaccard, mixing, rules
from seepage.llm.common import clear, recorded, table, written

#: Folders with intermediates that stages of this driver have left.
_LEFT: list[str] = []


def _stage(build):
    """A stage begins by deleting what earlier ones have left, but for what its input reads."""
    @wraps(build)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(spark, _LEFT, docs)
        with recorded(_LEFT):
            return build(spark, docs, sf_dir)
    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.quality_filter(docs, table(spark, sf_dir, "labels"))


@_stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, table(spark, sf_dir, "labels"), lowest=1.0, size=MIXED_SIZE)


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bitplanes.token_files(spark, docs)


#: The mixed corpus has so many times the tokens of what enters the stage: no document is dropped, and
#: the tokens beyond the first copies (at most mixing's cap of 4 each) go where the targets ask for more.
MIXED_SIZE = 1.5

STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mixing),
    ("token files", token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
