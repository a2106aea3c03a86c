"""ST1 leak_stream + ST2 sink: writes arrive as a stream; each micro-batch is
matched (the batch job J7) against an index, roots and actors fixed at start.

Stateless: no streaming aggregation or join state. The gram joins need
distinct/group-by, so they run inside ``foreachBatch`` on the micro-batch as a
plain batch DataFrame. Replays are safe: batch N is committed to the trail under its
number, as a whole, and replaces what an earlier attempt had committed.
Offsets live in the checkpoint location (shared folder).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from seepage.operators.broadcast import scoped
from seepage.operators.fingerprint import as_match_side
from seepage.operators.match import Probes, event_columns, probe_tables
from seepage.operators.roots import measured_roots
from seepage.plans import jobs
from seepage.plans.fixtures import fixture
from seepage.session import scratch_path
from seepage.sources.trail import append_leak_events, read_leak_events

WRITE_LOG_SCHEMA = StructType([
    StructField("write_id", LongType()), StructField("ts", TimestampNTZType()),
    StructField("path", StringType()), StructField("content", StringType()), StructField("kind", StringType()),
])


def write_stream(spark: SparkSession, log_dir: str, schema: StructType = WRITE_LOG_SCHEMA,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """The write log as a stream; only write/create events count."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(log_dir).where(F.col("kind").isin("write", "create"))


def snapshot(df: DataFrame) -> DataFrame:
    """A dimension as it is at start, held in memory (spilling to local disk); blocks
    lost with an executor are recomputed."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


def leak_batch_writer(probes: Probes, roots: DataFrame, actors: DataFrame, trail_dir: str):
    """foreachBatch body: J7 on the micro-batch, events committed to the trail as batch N."""
    def run(batch: DataFrame, batch_id: int) -> None:
        with scoped():
            ev = event_columns(jobs.write_matches(batch, probes, roots, actors))
            append_leak_events(ev, trail_dir, f"batch-{batch_id}")
    return run


def run_leak_stream(spark: SparkSession, writes: str | DataFrame, fps: DataFrame, roots: DataFrame,
                    actors: DataFrame, trail_dir: str, checkpoint: str, available_now: bool = True,
                    max_files_per_trigger: int | None = None):
    """writes: the folder of a write log, or a stream of its schema (tree_stream.written_files)."""
    probes = probe_tables(as_match_side(fps))
    roots, actors = snapshot(roots), snapshot(actors)
    measured_roots(roots)  # measured and held once; batches find it
    if isinstance(writes, str):
        writes = write_stream(spark, writes, max_files_per_trigger=max_files_per_trigger)
    q = (writes.writeStream
         .foreachBatch(leak_batch_writer(probes, roots, actors, trail_dir))
         .option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 second")
    return q.start()


def run_fixture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture writes -> write log (in several files) -> stream -> trail."""
    log_dir = scratch_path(spark, "write-log")
    w = fixture(spark, sf_dir, "writes_fx").withColumn("kind", F.lit("write"))
    # events of other kinds repeat the contents and must not count
    w = w.unionByName(w.where("write_id % 3 = 0").withColumn("kind", F.when(F.col("write_id") % 2 == 0, F.lit("remove")).otherwise(F.lit("chmod"))))
    w.repartition(max(4, spark.sparkContext.defaultParallelism), "write_id").write.parquet(log_dir)  # as many tasks write and read it as there are cores
    trail_dir = scratch_path(spark, "stream-trail")
    q = run_leak_stream(spark, log_dir, jobs.fx_fingerprints(spark, sf_dir), fixture(spark, sf_dir, "worktrees_fx"),
                        jobs.fx_actors(spark, sf_dir), trail_dir, scratch_path(spark, "stream-ckpt"))
    q.awaitTermination()
    return read_leak_events(spark, trail_dir)
