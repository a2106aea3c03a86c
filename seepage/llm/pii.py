"""Operator 2, personal data: exact patterns and a character tagger.

Base spans are found by four patterns, each leftmost and non-overlapping for itself. Matches
that fail their check (parts of an address, Luhn sum, count of digits) are dropped.

The tagger (a bidirectional LSTM with CRF, see tagger.py) is trained on the driver, from
windows labelled with base spans: at most ``max_windows`` windows (a documented bound), those
of least hash among windows around spans and around other triggers of all documents.

Every kind of span holds a digit or an "@", so windows without one have none: the tagger reads
the windows of a fixed grid (``width`` characters, half overlapping) that hold such a trigger, over
whole texts. Spans that touch a window's inner edge are left to the neighbour that sees more of them.
What the windows of a document propose is reconciled over the whole document: base spans stay, of
the rest the non-overlapping choice of highest total score is taken.

Defined results: null and empty texts have no spans and the digest of the empty string; repeated
rows each get their row; a null doc_id keeps its row; documents without any labelled span give no
tagger, so base spans alone; empty table: no rows; further columns are ignored. Long texts are
read window by window, in batches of bounded size. Added spans have at least ``LEAST`` (6) characters, a
digit or "@", and a score of ``least`` (1.0) a character. One of up to 47 characters lies whole in some
window; a longer one that both its windows cut is not added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm.common import clean_docs, table, written
from seepage.llm.tagger import KINDS, Tagger, tags_of

Span = tuple[str, int, int]

_MAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match never starts inside a run of digits: what fails at the run's first digit fails there too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_BATCH = 256
#: Characters of an added span.
LEAST = 6


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _mails(text: str) -> list[Span]:
    """Each "@" decides alone: a match starts where the run of name characters before it does, or where the
    last match ended, and what fails after the "@" fails for all starts. Linear in the text."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _MAIL_CHARS:
            lo -= 1
        m = _MAIL_DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            end = m.end()
            out.append(("email", lo, end))
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """By start, then kind as in KINDS."""
    if not _TRIGGER.search(text):
        return []
    out = _mails(text)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_part_ok, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def grid(text: str, width: int) -> list[int]:
    """Starts of the half-overlapping windows that hold a trigger."""
    half, last = width // 2, max(0, len(text) - 1) // (width // 2)
    out: list[int] = []
    at = 0
    while m := _TRIGGER.search(text, at):
        k = m.start() // half
        out += [i * half for i in (k - 1, k) if 0 <= i <= last and (not out or i * half > out[-1])]
        at = (k + 1) * half  # windows k - 1 and k hold all triggers up to here
    return out


def reconcile(base: list[Span], proposed: dict[Span, float]) -> list[Span]:
    """Base spans and the best non-overlapping choice of the others."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    far = np.maximum.accumulate([b for _, b in taken]).tolist()
    free = []
    for (kind, a, b), score in proposed.items():
        i = bisect_right(starts, b - 1)
        if not (i and far[i - 1] > a):
            free.append((b, a, KINDS.index(kind), score))
    free.sort()
    ends = [b for b, *_ in free]
    best = [0.0]
    for i, (_, a, _, score) in enumerate(free):
        best.append(max(best[i], best[bisect_right(ends, a, 0, i)] + score))
    out, i = [], len(free)
    while i:
        b, a, kind, score = free[i - 1]
        if best[i] > best[i - 1]:
            out.append((KINDS[kind], a, b))
            i = bisect_right(ends, a, 0, i - 1)
        else:
            i -= 1
    return sorted(base + out, key=lambda s: (s[1], KINDS.index(s[0])))


def tagged(texts: list[str], tagger: Tagger | None, width: int, least: float) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    proposed: list[dict[Span, float]] = [{} for _ in texts]

    def read(todo: list[tuple[int, int]]) -> None:
        for (i, at), spans in zip(todo, tagger.decode([texts[i][at:at + width] for i, at in todo])):
            for kind, a, b, score in spans:
                cut = (a == 0 and at > 0) or (b == width and at + width < len(texts[i]))
                if cut or score < least * (b - a) or b - a < LEAST or not _TRIGGER.search(texts[i], at + a, at + b):
                    continue
                key = (kind, at + a, at + b)
                proposed[i][key] = max(score, proposed[i].get(key, 0.0))

    if tagger is not None:
        todo: list[tuple[int, int]] = []
        for i, t in enumerate(texts):
            for at in grid(t, width):
                todo.append((i, at))
                if len(todo) == _BATCH:
                    read(todo)
                    todo = []
        if todo:
            read(todo)
    for b, p in zip(base, proposed):
        yield b, reconcile(b, p) if p else b


def train(docs: DataFrame, width: int = 96, max_windows: int = 400, **how) -> Tagger | None:
    """A tagger from labelled windows of docs (doc_id, text); None without labelled spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                spans = base_spans(t)
                places = [(a, 1) for _, a, _ in spans]
                inside = sorted((a, e) for _, a, e in spans)
                for at in grid(t, width):
                    if not any(a < at + width and e > at for a, e in inside):
                        places.append((at + width // 2, 0))
                for at, labelled in places:
                    lo = max(0, at - 8 - at % (width // 2))
                    w = t[lo:lo + width]
                    h = int.from_bytes(hashlib.sha256(f"{labelled}{w}".encode("utf-8", "surrogatepass")).digest()[:7], "big")
                    rows.append((h, labelled, w))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["h", "labelled", "w"])

    found = docs.select("text").where(F.col("text").rlike("[0-9@]")).mapInArrow(run, "h bigint, labelled int, w string")
    rows = [r for k, n in ((1, max_windows * 3 // 4), (0, max_windows // 4)) for r in found.where(F.col("labelled") == k).distinct().orderBy("h", "w").limit(n).collect()]
    if not any(r.labelled for r in rows):
        return None
    windows = [r.w for r in rows]
    return Tagger().fit(windows, [tags_of(len(w), base_spans(w)) for w in windows], **how)


def find_pii(docs: DataFrame, width: int = 96, max_windows: int = 400, least: float = 1.0) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    docs = clean_docs(docs)
    tagger = docs.sparkSession.sparkContext.broadcast(train(docs, width, max_windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base_, all_ = zip(*tagged(b.column(1).to_pylist(), tagger.value, width, least)) if b.num_rows else ([], [])
            told = lambda spans: ",".join(f"{k}:{a}:{e}" for k, a, e in spans)
            cols = [b.column(0)] + [pa.array([sum(s[0] == k for s in x) for x in base_], pa.int64()) for k in KINDS]
            cols += [pa.array([hashlib.sha256(told(x).encode()).hexdigest() for x in base_], pa.string()), pa.array([told(x) for x in all_], pa.string()),
                     pa.array([len(x) - len(y) for x, y in zip(all_, base_)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return written(docs.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"), "personal-data")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
