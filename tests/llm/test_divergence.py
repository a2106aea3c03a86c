import random
import re
from collections import Counter

import pytest

from seepage.llm import divergence
from seepage.llm.perfecthash import PerfectHash
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top=50):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, w in own for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        count = {s: Counter(t for _, x, w in own if x == s for t in w if df[t] >= min_docs) for s in {d[1] for d in own}}
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in p:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(sorted(pair))]
            out += [(lang, s, "term", o.decode(), -v, k + 1) for k, (v, o) in enumerate(sorted(term)[:top])]
    return sorted(out)


def corpus(n=150):
    rng = random.Random(8)
    vocab = ["Alpha", "beta's", "Ünder", "naïve", "x1y", "日本", "é", "zero-width", "nbsp\xa0glue"] + [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    rows = []
    for i in range(n):
        source = [None, "", "hot", "hot", "hot", "rare", "é"][i % 7]
        lang = ["en", "en", "en", "de", None, "one"][i % 6]
        own = vocab[:30] if source == "rare" else vocab
        rows.append((" ".join(rng.choice(own) for _ in range(rng.randrange(0, 40))), lang, "only" if lang == "one" else source))
    rows += [(None, "en", "hot"), (None, None, None), ("", "fr", "lonely"), ("", "fr", "also"), ("...!?", "fr", "third")]
    return rows + rows[:9] + [("long " * 30_000 + "tail", "en", "hot")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, s, 1, "y") for i, (t, x, s) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, term string")


@pytest.mark.parametrize("how", [{}, {"shard_terms": 7, "round_bytes": 900, "slots": 40, "cells": 16}])
def test_against_brute_force(spark, how):
    """At their usual sizes, and with many shards, rounds, flushes and blocks."""
    rows = corpus()
    got = divergence.divergence(table(spark, rows), min_docs=6, top=9, **how)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 6, 9)


def test_odd_rows_and_empty(spark):
    pairs = cases.rows(4, 30)
    d = cases.frame(spark, pairs)
    assert sorted(map(tuple, divergence.divergence(d, min_docs=2).collect())) == brute([(r.text, r.lang, r.source) for r in d.collect()], 2)
    assert divergence.divergence(cases.empty(spark)).count() == 0


def test_shares_of_very_many(spark):
    from pyspark.sql import functions as F
    n, total, v = 7 * 10**17, 10**18, 10**9
    got = spark.range(1).select(divergence._share(F.lit(n).cast("bigint"), F.lit(total).cast("bigint"), F.lit(v).cast("bigint"))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


@pytest.mark.parametrize("n", [0, 1, 2, 9, 5000])
def test_perfect_hash(n):
    keys = [f"key {i * i}".encode() for i in range(n)] + [b""] * (n > 5)
    h = PerfectHash(keys)
    at = h.find(keys)
    assert sorted(at) == list(range(len(keys))) and all(h.key(i) == k for i, k in zip(at, keys))
    assert (h.find([f"no {i}".encode() for i in range(3 * n)]) == -1).all()


def test_perfect_hash_of_equal_hashes(monkeypatch):
    """Keys that no level can tell apart are found by their bytes."""
    import numpy as np
    from seepage.llm import perfecthash
    monkeypatch.setattr(perfecthash, "key_hashes", lambda keys: np.array([len(k) for k in keys], np.uint64))
    keys = [b"aa", b"ab", b"ba", b"c", b"ddd"]
    h = PerfectHash(keys)
    assert sorted(h.find(keys)) == [0, 1, 2, 3, 4] and h.find([b"bb", b"x", b"eeee"]).tolist() == [-1, -1, -1]
