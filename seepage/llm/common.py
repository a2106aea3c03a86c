"""Shared helpers: tables, the shared folder, written intermediates, word hashing.

Words everywhere are ``[^\\x20\\x09-\\x0D]+``: runs of bytes other than the six
ASCII white-space characters. ``bytes.split()`` cuts at exactly these, and
``bytes.lower()`` lower-cases exactly A-Z, so both work on UTF-8 bytes.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may fall back to
    a scratch folder of its own; on a cluster a missing setting is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """What runs inside hands at most so many rows at a time to Python, so that the
    memory of workers does not depend on how long the rows' texts are. (Spark's own
    default of 10,000 documents is 30 MB in each of several copies.)"""
    was = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, was)


def written(df: DataFrame, name: str, batch_rows: int = 1000) -> DataFrame:
    """df written as Parquet in the shared folder and read again: later plans
    start at the files, which survive the loss of executors."""
    path = shared_path(df.sparkSession, name)
    _WRITTEN.append(path)
    with small_batches(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that written() has made, of this driver.
_WRITTEN: list[str] = []


@contextmanager
def recorded(into: list[str]):
    """Adds the folders that written() makes inside to the list."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        into += _WRITTEN[before:]


def clear(spark: SparkSession, folders: list[str], needed: DataFrame) -> None:
    """Deletes those of the folders that ``needed`` does not read, and takes them off the list."""
    files = "\n".join(needed.inputFiles())
    for path in [p for p in folders if p.rpartition("/")[2] not in files]:
        remove(spark, path)
        folders.remove(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# ---------------------------------------------------------------- word hashes

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept between calls."""
    have = _POWERS[kind]
    if len(have) < n:
        m = 1 << (n - 1).bit_length()
        full = np.full(m, base, np.uint64)
        full[0] = 1
        have = _POWERS[kind] = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_bounds(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    gap = np.ones(len(buf) + 2, np.int8)
    gap[1:-1] = _SPACE[np.frombuffer(buf, np.uint8)]
    step = np.diff(gap)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def span_hashes(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of buf[s:e] for each pair: differences of one running
    polynomial sum, moved back to position 0 by the inverse power."""
    n = len(buf)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(buf, np.uint8)] * _powers("p", _P, n), dtype=np.uint64, out=run[1:])
    return mix((run[ends] - run[starts]) * _powers("i", _P_INV, n + 1)[starts])


def word_hashes(buf: bytes) -> np.ndarray:
    s, e = word_bounds(buf)
    return span_hashes(buf, s, e) if len(s) else np.zeros(0, np.uint64)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each k consecutive word hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _P + h[j:j + n]
    return mix(out)


def text_bytes(x) -> bytes:
    """UTF-8 of a text; null is the empty text."""
    return b"" if x is None else x.encode("utf-8", "surrogatepass")


def clean_docs(docs: DataFrame) -> DataFrame:
    """doc_id, text with null texts as empty ones; other columns go."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores until no column of df has it (in any case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


class Packed:
    """State that pickles its arrays as bytes and reads them in place afterwards. (With
    spark.io.encryption.enabled, Spark cannot broadcast large arrays as they are.)"""

    def __getstate__(self) -> dict:
        return {k: _pack(v) for k, v in self.__dict__.items()}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update({k: _unpack(v) for k, v in state.items()})


class _Array(tuple):
    """(dtype, shape, bytes)"""


def _pack(x):
    if isinstance(x, np.ndarray):
        return _Array((x.dtype.str, x.shape, x.tobytes()))
    if isinstance(x, (list, tuple)) and any(isinstance(v, (np.ndarray, list, tuple)) for v in x):
        return type(x)(_pack(v) for v in x)
    return x


def _unpack(x):
    if isinstance(x, _Array):
        return np.frombuffer(x[2], x[0]).reshape(x[1])
    if isinstance(x, (list, tuple)) and any(isinstance(v, (_Array, list, tuple)) for v in x):
        return type(x)(_unpack(v) for v in x)
    return x
