"""S2 read_leak_events, S3 append_leak_events, S5 redacted inventory export.

The trail is JSON lines with the 10 event keys in record order. Missing keys
read as ''/0 (coalesce), a malformed line fails the read (FAILFAST), empty
lines are skipped, and an absent trail is an empty DataFrame.

What is appended becomes visible at once. A batch's part files go to a folder of its own under
``parts/``, which no reader looks into by itself; when all of them are there, the batch's
manifest ``_manifest/<batch>`` names that folder, put in place by one rename. Readers take the
folders that manifests name: a batch that fails, or a task that runs twice, leaves nothing to
be seen, and a batch that is written again under its name replaces what it wrote before. All of it goes
through Hadoop's file systems, so the trail can be wherever Spark writes. A folder or file of JSON lines
without manifests is a trail too, and is read as it is.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from seepage.functions import columns as C
from seepage.functions.constants import EVENT_KEYS, MISSING_TRAIL_HINT

_INT_KEYS = {"source_agent_pid", "target_agent_pid"}

TRAIL_SCHEMA = StructType([StructField(k, LongType() if k in _INT_KEYS else StringType())
                           for k in EVENT_KEYS])


def trail_records(events: DataFrame) -> DataFrame:
    """Events -> the 10 trail columns (timestamp as RFC 3339 text)."""
    ts = F.col("timestamp")
    ts_txt = ts if dict(events.dtypes)["timestamp"] == "string" else C.rfc3339_nano(ts)
    cols = []
    for k in EVENT_KEYS:
        if k == "timestamp":
            cols.append(F.coalesce(ts_txt, F.lit("")).alias(k))
        elif k in _INT_KEYS:
            cols.append(F.coalesce(F.col(k).cast("bigint"), F.lit(0)).alias(k))
        else:
            cols.append(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k))
    return events.select(*cols)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def append_leak_events(events: DataFrame, path: str, batch: str | None = None) -> None:
    """S3: append the events (no raw value exists in them) to the JSON trail, as a whole or not at all.
    A ``batch`` name makes it replace what was written under that name."""
    spark = events.sparkSession
    part = f"parts/{uuid.uuid4().hex}"
    trail_records(events).write.json(f"{path}/{part}")
    jvm, folder, fs = _fs(spark, f"{path}/_manifest")
    fs.mkdirs(folder)
    name = batch or part.rpartition("/")[2]
    made = jvm.org.apache.hadoop.fs.Path(folder, f".{name}.{uuid.uuid4().hex}")
    out = fs.create(made, True)
    out.write(bytearray(part.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(made, jvm.org.apache.hadoop.fs.Path(folder, name), how)


def committed_parts(spark: SparkSession, path: str) -> list[str] | None:
    """The folders that the trail's manifests name, one for each batch; None if it has no manifests."""
    jvm, folder, fs = _fs(spark, f"{path}/_manifest")
    if not fs.exists(folder):
        return None
    out = []
    for s in fs.listStatus(folder):
        if not s.getPath().getName().startswith("."):
            f = fs.open(s.getPath())
            out.append(f"{path}/{jvm.org.apache.commons.io.IOUtils.toString(f, 'UTF-8')}")
            f.close()
    return sorted(out)


def read_leak_events(spark: SparkSession, path: str) -> DataFrame:
    """The trail as a DataFrame of the 10 keys, timestamp as text, plus ``ts``:
    the same parsed (UTC, microseconds), by which trails are ordered."""
    parts = committed_parts(spark, path)
    if parts is None:
        _, p, fs = _fs(spark, path)
        parts = [path] if fs.exists(p) else []
        if not parts:
            warnings.warn(MISSING_TRAIL_HINT % path)
    if parts:
        df = spark.read.schema(TRAIL_SCHEMA).option("mode", "FAILFAST").json(parts)
    else:
        df = spark.createDataFrame([], TRAIL_SCHEMA)
    # '' (a missing key) has no time; FAILFAST above is for lines that are not JSON
    return trail_records(df).withColumn("ts", F.try_to_timestamp(F.col("timestamp")))


def redacted_inventory(fps: DataFrame) -> DataFrame:
    """Path, field, value_hash, classification only (no value, no root)."""
    return fps.select("path", "field", "value_hash", "classification")


def write_redacted_inventory(fps: DataFrame, path: str) -> None:
    redacted_inventory(fps).write.mode("overwrite").json(path)
