"""S6 over a growing file tree: a streaming Python Data Source of the files that were written.

An offset is a point in time. A micro-batch holds the files whose modification time lies
between its two offsets, so a new file arrives once, and a changed one once for each batch in
which it changed, as it is then; nothing has to remember which files there were. The newest
offset stays ``settle_ms`` behind the clock, so a file that is being written when a batch is planned
belongs to a later one. Trees are cut into pieces as in files.py: the driver reads a bounded
number of names, the executors list and read. Files of any name count; ignored directories
are pruned, symlinked ones are not followed.

A replayed batch reads the same span of time again; a file that has changed since is past its end and comes
with a later batch. Rows have the schema of a write log; write_id is a 64-bit hash of path and
time, so the same write has the same id in every attempt.

    spark.dataSource.register(WrittenFilesSource)
    spark.readStream.format("written_files").option("roots", '["/a"]').load()
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import sys
import time

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from seepage.sources.files import SecretTreeReader


class SpanPartition(InputPartition):
    """A piece of a tree, and the span of time (nanoseconds; after start, up to end)."""

    def __init__(self, piece, start: int, end: int):
        self.piece, self.start, self.end = piece, start, end


class WrittenFilesReader(DataSourceStreamReader):
    def __init__(self, options):
        self.tree = SecretTreeReader({"roots": options.get("roots", "[]"), "names": "all", "splits": options.get("splits", "64")})
        self.settle = int(options.get("settle_ms", "1000")) * 1_000_000
        self.since = int(options.get("since_ns", str(time.time_ns())))

    def initialOffset(self) -> dict:
        return {"ns": str(self.since)}

    def latestOffset(self) -> dict:
        return {"ns": str(max(self.since, time.time_ns() - self.settle))}

    def partitions(self, start: dict, end: dict):
        return [SpanPartition(p, int(start["ns"]), int(end["ns"])) for p in self.tree.partitions()]

    def read(self, partition: SpanPartition):
        def written(path: str) -> int | None:
            try:
                at = os.stat(path).st_mtime_ns
            except OSError:
                return None
            return at if partition.start < at <= partition.end else None

        for path in self.tree.paths(partition.piece):
            at = written(path)
            row = self.tree._read(partition.piece.root, path) if at else None
            if row and written(path) == at:  # changed meanwhile: a later batch has it
                write_id = int.from_bytes(hashlib.blake2b(f"{path}\0{at}".encode("utf-8", "surrogateescape"), digest_size=8).digest(), "big", signed=True)
                yield (write_id, datetime.datetime.fromtimestamp(at / 1e9, datetime.timezone.utc), path, row[2], "write")

    def commit(self, end: dict) -> None:
        pass


class WrittenFilesSource(DataSource):
    @classmethod
    def name(cls):
        return "written_files"

    def schema(self):
        return "write_id bigint, ts timestamp, path string, content binary, kind string"

    def streamReader(self, schema):
        return WrittenFilesReader(self.options)


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def written_files(spark: SparkSession, roots: list[str], since_ns: int | None = None, settle_ms: int = 1000, splits: int = 64) -> DataFrame:
    """The stream of writes under the roots, from now on or since a point in time."""
    spark.dataSource.register(WrittenFilesSource)
    r = spark.readStream.format("written_files").option("roots", json.dumps(list(roots))).option("settle_ms", settle_ms).option("splits", splits)
    return (r if since_ns is None else r.option("since_ns", since_ns)).load()
