import random

import numpy as np

from seepage.llm import decontaminate as D
from tests.llm import cases


def least_edits(p, t):
    """Plain semi-global alignment: least edits of p against any region of t."""
    last = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        row = [i]
        for j, e in enumerate(t, 1):
            row.append(min(last[j - 1] + (c != e), last[j] + 1, row[-1] + 1))
        last = row
    return min(last)


def segments(text, m, stride):
    t = D.normal(text.encode())
    n = min(m, len(t))
    return [t[a:a + n] for a in sorted({*range(0, len(t) - n, stride), len(t) - n})] if t else []


def brute(docs, items, m=80, budget=10, stride=10):
    out = {}
    for d, t in docs:
        own = D.normal((t or "").encode())
        for i, x in items:
            n = sum(least_edits(s, own) <= len(s) * budget // 100 for s in segments(x or "", m, stride))
            if n:
                out[d, i] = out.get((d, i), 0) + n
    return {(d, i, n) for (d, i), n in out.items()}


def prose(rng, n):
    return " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def edit(rng, t, k):
    for _ in range(k):
        at = rng.randrange(len(t))
        op = rng.randrange(3)
        t = t[:at] + rng.choice("xyz") * (op != 1) + t[at + (op != 0):]
    return t


def fixture(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randrange(3, 30))) for i in range(12)] + [(50, None), (51, ""), (52, "Q"), (53, "tiny item")]
    items.append((60, items[0][1]))
    docs = []
    for d in range(40):
        t = prose(rng, rng.randrange(5, 40))
        if d % 2:
            x = edit(rng, rng.choice(items[:12])[1], rng.choice([0, 0, 2, 5, 9, 14]))
            t = t + (" " if d % 4 == 1 else "") + x.upper().replace(" ", "  \n") + " " + t
        docs.append((d, t))
    return docs + [(90, None), (91, ""), (92, "q" * 30)], items


def test_against_plain_alignment(spark):
    docs, items = fixture(1)
    docs.append((None, docs[1][1]))
    items += [(None, items[3][1]), (None, items[4][1]), (0, items[5][1])]
    for how in ({"stride": 40}, {"segment": 40, "q": 5, "block_bytes": 200, "stride": 7}):
        got = {(r.doc_id, r.item_id, r.regions) for r in D.leaks(cases.frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), **how).collect()}
        want = brute(docs, items, how.get("segment", 80), stride=how["stride"])
        assert got == want
        assert len(want) > 10


def test_filter_and_verification_alone():
    rng = random.Random(3)
    for _ in range(300):
        p = prose(rng, 8).encode()
        t = (prose(rng, 5) + edit(rng, p.decode(), rng.randrange(0, 8)) + prose(rng, 3)).encode()
        k = len(p) // 10
        assert min(D.region_distance(p, t, -k, len(t), k), k + 1) == min(least_edits(p, t), k + 1)


def test_gram_codes():
    b = bytes(range(1, 30))
    for q in range(1, 9):
        assert D.gram_codes(b, q).tolist() == [int.from_bytes(b[i:i + q], "little") for i in range(len(b) - q + 1)]
    assert len(D.gram_codes(b"ab", 8)) == 0 and D.gram_codes(b"", 1).dtype == np.uint64


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(D, "_PIECE", 128)
    rng = random.Random(5)
    item = prose(rng, 25)
    for at in range(0, 400, 23):
        t = prose(rng, 300)
        assert D.Index([(1, item.encode())], 80, 10, 8, 10).regions((t[:at] + " " + item + " " + t[at:]).encode()) == {1: len(segments(item, 80, 10))}


def test_every_quote_of_73_bytes_is_found():
    rng = random.Random(6)
    item = D.normal(prose(rng, 60).encode())
    ix = D.Index([(None, item)], 80, 10, 8, 10)
    for at in range(len(item) - 72):
        assert None in ix.regions(prose(rng, 9).encode() + b"#" + item[at:at + 73] + b"#" + prose(rng, 9).encode())
    assert not ix.regions(b"#" + item[5:70] + b"#" + prose(rng, 9).encode())


def test_short_quotes_against_plain_alignment():
    rng = random.Random(9)
    item = D.normal(prose(rng, 30).encode())
    ix = D.Index([(1, item)], 80, 10, 8, 10)
    for size in range(12, 90, 3):
        at = rng.randrange(len(item) - size)
        t = prose(rng, 6).encode() + item[at:at + size] + prose(rng, 6).encode()
        n = sum(least_edits(s, D.normal(t)) <= 8 for s in segments(item.decode(), 80, 10))
        assert ix.regions(t) == ({1: n} if n else {})


def test_repetitive_texts_in_halves(monkeypatch):
    monkeypatch.setattr(D, "_HITS", 2000)
    rng = random.Random(8)
    item = ("ab" * 60 + prose(rng, 20)).encode()
    for t in ("ab" * 2000, prose(rng, 200) + "ab" * 900 + prose(rng, 200), prose(rng, 300) + item.decode() + "ab" * 700):
        n = sum(least_edits(s, D.normal(t.encode())) <= 8 for s in segments(item.decode(), 80, 10))
        assert D.Index([(1, item)], 80, 10, 8, 10).regions(t.encode()) == ({1: n} if n else {})


def test_index_size():
    rng = random.Random(7)
    items = [(i, prose(rng, 60).encode()) for i in range(300)]
    size = sum(len(D.normal(x)) for _, x in items)
    ix = D.Index(items, 80, 10, 8, 10)
    assert sum(a.nbytes for t in ix.tables for a in t[1:5]) <= 21 * size


def test_documents_that_leak_go(spark):
    docs, items = fixture(2)
    d = cases.frame(spark, docs + [(None, docs[1][1]), (None, "clean text")])
    out = D.decontaminate(d, spark.createDataFrame(items, "item_id bigint, text string"))
    assert out.columns == d.columns
    bad = {x[0] for x in brute(docs, items)}
    assert {r.doc_id for r in out.where("doc_id IS NOT NULL").collect()} == {i for i, _ in docs} - bad


def test_empty(spark):
    items = spark.createDataFrame([(1, "some item text")], "item_id bigint, text string")
    assert D.leaks(cases.empty(spark), items).count() == 0
    assert D.decontaminate(cases.frame(spark, [(1, "x"), (2, None)]), items.where("false")).count() == 2
