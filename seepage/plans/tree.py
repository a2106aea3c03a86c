"""A file tree in the shared folder, made from files_fx: the input that S1 walks."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame

from seepage.session import scratch_path


def write_tree(files: DataFrame) -> str:
    """Writes files (path, content) below a folder of the shared one, on the executors; returns it."""
    base = urlparse(scratch_path(files.sparkSession, "tree")).path

    def put(batches):
        for x in batches:
            for path, content in zip(x["path"], x["content"]):
                to = base + path
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(f"{to}.part", "wb") as fh:
                    fh.write(bytes(content))
                os.replace(f"{to}.part", to)  # a task that runs again leaves the same file
            yield pd.DataFrame({"n": [len(x)]})

    files.selectExpr("path", "CAST(content AS BINARY) AS content").mapInPandas(put, "n bigint").agg({"n": "sum"}).collect()
    return base
