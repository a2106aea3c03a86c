"""Operator 5, token ids as bit-plane shuffled binary files.

Layout of one ``.ids`` file (little-endian):

    b"IDPLANE1"
    planes of chunk 0, planes of chunk 1, ...      each plane one zstandard frame
    zstandard frame of the doc ids (int64, null as the flag array says), the null flags (uint8) and the lengths (int64)
    JSON index, its length as uint64, b"IDPLANE1"

A chunk holds ``block`` ids (the last one of a file fewer). Its ids are taken as
unsigned 32-bit integers and transposed: byte plane k has byte k of every id, bit
plane k has bit k of every id, eight ids a byte. A plane of zeros takes no bytes.
The index lists for each chunk its offset, ids and plane lengths, so a reader
seeks to any chunk; the manifest lists for each file the ids before it.

Spark deals the documents out by range of doc_id and sorts each range; each task
tokenizes its range and writes its files. A file is written under a name of the
attempt and renamed, and its name and bytes depend on the range only, so a task
that runs again replaces equal files. Nothing passes through the driver but the
manifest (a row for each file of up to ``file_ids`` ids).

Defined results: null text is the empty text (only the end id); null doc_id comes
first and stays null; rows with equal doc_id are ordered by text; empty table: no
file, no row; further columns are ignored. A very long text is one document that may
span many chunks.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm.common import clean_docs, shared_path, small_batches, table

MAGIC = b"IDPLANE1"
END_ID = 1
_CACHE_CHUNKS = 700_000
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-;=?@\[-`{}~]*)")
_OTHER_GAPS = re.compile("[\x1c-\x1f]")
_CODERS: dict[str, "Coder"] = {}


class Coder:
    """Whole texts to ids by the tokenizers library, each distinct chunk between
    white space encoded once in a worker. The vocabulary's normalizer and
    pre-tokenizer never look across white space, so the ids of a text are those
    of its chunks in order."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        # On lower-case Latin-1 letters, or on ASCII signs without apostrophe, the normalizer changes nothing.
        from tokenizers import normalizers
        self.bare.normalizer = normalizers.Sequence([])
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}

    def _ids(self, tok, text: str) -> bytes:
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self.pieces[piece] = self._ids(self.bare, piece)
        return got

    def _chunk(self, chunk: str) -> bytes:
        m = _SIMPLE.fullmatch(chunk)
        if m is None:
            got = self._ids(self.tok, chunk)
        else:
            got = self._piece(m[1].lower()) + self._piece(m[2])
        self.chunks[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, without end id."""
        if _OTHER_GAPS.search(text):  # str.split() would cut there, the vocabulary does not
            return self._ids(self.tok, text)
        if len(self.chunks) > _CACHE_CHUNKS:
            self.chunks.clear()
            self.pieces = {"": b""}
        words = text.split()
        chunks = self.chunks
        try:
            return b"".join([chunks[w] for w in words])
        except KeyError:
            return b"".join([chunks.get(w) or self._chunk(w) for w in words])


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


# ------------------------------------------------------------------ the format

def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The transposed block: 4 byte planes or 32 bit planes, b"" for zeros."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        planes = [np.packbits(rows[:, k], bitorder="little") for k in range(32)]
    else:
        planes = [np.ascontiguousarray(rows[:, k]) for k in range(4)]
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "bit":
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        rows = np.packbits(bits, axis=1, bitorder="little")
    else:
        rows = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                rows[:, k] = np.frombuffer(p, np.uint8)
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file; holds at most one block of ids besides a document."""

    def __init__(self, out, block: int, kind: str, level: int = 3):
        self.out, self.block, self.kind = out, block, kind
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.chunks, self.pending, self.n_pending = 0, [], [], 0
        self.doc_ids: list[int] = []
        self.nulls: list[int] = []
        self.lengths: list[int] = []
        self.n_ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.pending.append(ids)
        self.n_pending += len(ids) // 4
        if self.n_pending >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        full = len(ids) if last else len(ids) - len(ids) % self.block
        for i in range(0, full, self.block):
            part, offset = ids[i:min(i + self.block, full)], self.at
            sizes = [self._put(self.zip.compress(p)) if p else 0 for p in to_planes(part, self.kind)]
            self.chunks.append([offset, len(part), sizes])
        self.pending, self.n_pending = [ids[full:].tobytes()], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        docs = np.array(self.doc_ids, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes() + np.array(self.lengths, "<i8").tobytes()
        offset = self.at
        size = self._put(self.zip.compress(docs))
        index = json.dumps({"kind": self.kind, "block": self.block, "ids": self.n_ids, "docs": len(self.lengths), "docs_at": [offset, size], "chunks": self.chunks}).encode()
        self._put(index + struct.pack("<Q", len(index)) + MAGIC)


class PlaneReader:
    """Reads a seekable file: documents in order, one chunk in memory at a time,
    or the ids of any chunk by its number."""

    def __init__(self, f):
        self.f, self.zip = f, zstandard.ZstdDecompressor()
        f.seek(0)
        if f.read(8) != MAGIC:
            raise ValueError("not an id-plane file")
        end = f.size() if callable(getattr(f, "size", None)) else f.seek(0, 2)
        f.seek(end - 16)
        n, magic = struct.unpack("<Q8s", f.read(16))
        if magic != MAGIC:
            raise ValueError("the file is cut off")
        f.seek(end - 16 - n)
        self.index = json.loads(f.read(n))

    def chunk(self, i: int) -> np.ndarray:
        offset, n, sizes = self.index["chunks"][i]
        self.f.seek(offset)
        return from_planes([self.zip.decompress(self.f.read(s)) if s else b"" for s in sizes], n, self.index["kind"])

    def docs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, (offset, size) = self.index["docs"], self.index["docs_at"]
        self.f.seek(offset)
        raw = self.zip.decompress(self.f.read(size))
        return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw, "<i8", n, 9 * n)

    def digests(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, ids before it in the file, its ids, their crc32."""
        i, left, start = -1, np.zeros(0, "<u4"), 0
        for doc_id, null, n in zip(*map(np.ndarray.tolist, self.docs())):
            crc, need = 0, n
            while need:
                if not len(left):
                    i += 1
                    left = self.chunk(i)
                part, left = left[:need], left[need:]
                crc, need = zlib.crc32(part.tobytes(), crc), need - len(part)
            yield None if null else doc_id, start, n, crc
            start += n


# ------------------------------------------------------------------ Spark jobs

def _open(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_ids(docs: DataFrame, path: str, vocabulary: str, block: int = 1 << 16,
              kind: str = "byte", file_ids: int = 1 << 26) -> list[tuple[str, int, int]]:
    """Writes all documents under path in ascending doc_id order. Returns the
    manifest: file, its documents, its ids, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        code, end = coder(vocabulary), np.array([END_ID], "<u4").tobytes()
        fs, base = _open(path)
        fs.create_dir(base, recursive=True)
        part, made, w, tmp, out = TaskContext.get().partitionId(), [], None, "", None

        def close():
            w.close()
            out.close()
            name = f"part-{part:06d}-{len(made):05d}.ids"
            fs.move(tmp, f"{base}/{name}")
            made.append((part, len(made), name, len(w.lengths), w.n_ids))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if w is None:
                    tmp = f"{base}/.{part}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(tmp)
                    w = PlaneWriter(out, block, kind)
                w.add(doc_id, code.encode(text.as_py()) + end)
                if w.n_ids >= file_ids:
                    close()
                    w = None
        if w is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.string()),
                                          pa.array([m[3] for m in made], pa.int64()), pa.array([m[4] for m in made], pa.int64())], names=["part", "seq", "file", "docs", "ids"])

    h = F.xxhash64("text")
    ordered = clean_docs(docs).repartitionByRange(F.col("doc_id").asc_nulls_first(), h).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), h, "text")
    with small_batches(docs.sparkSession):
        rows = ordered.mapInArrow(run, "part bigint, seq bigint, file string, docs bigint, ids bigint").collect()
    return [(r.file, r.docs, r.ids) for r in sorted(rows, key=lambda r: (r.part, r.seq))]


def read_ids(spark: SparkSession, path: str, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    rows, before = [], 0
    for file, _, ids in manifest:
        rows.append((file, before))
        before += ids
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(path)
        for b in batches:
            for file, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(f"{base}/{file}") as f:
                    got: list[list] = [[], [], [], []]
                    for doc_id, start, n, crc in PlaneReader(f).digests():
                        for col, v in zip(got, (doc_id, first + start, n, crc)):
                            col.append(v)
                        if len(got[0]) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            got = [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.sparkContext.parallelize(rows, len(rows)).toDF("file string, first bigint")
    return files.mapInArrow(run, schema)


def token_files(spark: SparkSession, docs: DataFrame, path: str | None = None, vocabulary: str | None = None, **how) -> DataFrame:
    """Writes the files (to path, or a new folder of the shared one) and returns
    what read_ids finds in them."""
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    path = path or shared_path(spark, "token-ids")
    return read_ids(spark, path, write_ids(docs, path, vocabulary, **how))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"))
