import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from seepage.llm import filters
from tests.llm import cases

LABELS = "doc_id bigint, quality int, toxic int"


def masks(rows):
    """Per row (doc_id, text, source): the set of failed filters, by plain Python."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = cases.WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        out.append({k for k, v in fails.items() if v})
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out, shapley = {}, Counter()
    failed = masks(rows)
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, failed) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for k, x in enumerate(order):
                lost = [r for r in left if x in r[1]]
                redundant = sum(x in f for _, f in gone)
                left = [r for r in left if x not in r[1]]
                gone += lost
                shapley[part, x] += len(lost)
                out[part, order, k + 1] = [len(left), len(lost), redundant, sum(f == {x} for _, f in own), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x") for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, words string")


def texts():
    long = " ".join(f"w{i}" for i in range(210))
    out = [long, long, long.upper(), long + " #", "a b " * 150, ("A B " * 150), long + " $x", long + " x", "é" * 300, (long + " Ä") * 2]
    return out + [long + " same"] * 6 + [t for _, t in cases.rows(2, 15)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filters, "BATCH_ROWS", 7)
    rows = [(i, t, [None, "", "a", "b", "a"][i % 5]) for i, t in enumerate(texts())]
    rows += [(3, "w " * 30, "c"), (3, "w " * 30, "c"), (None, rows[0][1], "a"), (None, None, "b"), (2, rows[0][1], "b"), rows[0], (99, texts()[0], "z")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(30)] + [(1, 0, 1), (None, 1, 1), (4, None, None)]
    got = filters.filter_audit(table(spark, rows), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", *filters.COUNTS, "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_matrix_holds_the_corpus(spark, monkeypatch):
    """Global columns name words: the matrix and the dictionary give the words back."""
    monkeypatch.setattr(filters, "BATCH_ROWS", 5)
    seen = []
    make = filters.numbers
    monkeypatch.setattr(filters, "numbers", lambda *a: seen.append(make(*a)) or seen[-1])
    rows = [(i, t, "s") for i, t in enumerate(texts())]
    shards = filters.document_term_matrix(table(spark, rows)).collect()
    words = {r.id: r.word for r in filters.dictionary(seen[0]).collect()}
    assert len(words) == len(set(words.values())) and len(shards) > 3
    got = {}
    for s in shards:
        at, col, n = (filters.unpack(s[k], t) for k, t in (("indptr", "<i4"), ("columns", "<i8"), ("counts", "<i4")))
        for k, doc in enumerate(s.docs):
            assert (np.diff(col[at[k]:at[k + 1]]) > 0).all()
            got[doc.doc_id] = {words[c]: int(x) for c, x in zip(col[at[k]:at[k + 1]], n[at[k]:at[k + 1]])}
    assert got == {i: dict(Counter(cases.WORD.findall(t or ""))) for i, t, _ in rows}


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)]])
def test_empty(spark, labels):
    assert filters.filter_audit(cases.empty(spark), spark.createDataFrame(labels, LABELS)).count() == 0
    d = filters.filter_audit(cases.frame(spark, cases.rows(1, 5, long=False)), spark.createDataFrame(labels, LABELS))
    assert d.count() == 600 * 3
