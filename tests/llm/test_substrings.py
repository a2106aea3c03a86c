import hashlib
import random

import numpy as np
import pytest

from seepage.llm import substrings
from seepage.llm.fmindex import FMIndex
from tests.llm import cases


def brute(pairs, span=13):
    ws = [cases.WORD.findall(t or "") for _, t in pairs]
    least = {}
    for (d, _), w in zip(pairs, ws):
        if d is not None:
            for i in range(len(w) - span + 1):
                k = tuple(w[i:i + span])
                least[k] = min(d, least.get(k, d))
    out = []
    for (d, _), w in zip(pairs, ws):
        gone = set()
        if d is not None:
            for i in range(len(w) - span + 1):
                if least[tuple(w[i:i + span])] < d:
                    gone.update(range(i, i + span))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,hot", [(1, 5000), (2, 1)])
def test_against_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(substrings, "HOT_ANCHOR", hot)
    rng = random.Random(seed)
    pairs = cases.with_null_id(cases.rows(seed, 60) + [(500 + i, " ".join(cases.words(rng, 60, 3))) for i in range(5)])
    rng.shuffle(pairs)
    got = substrings.removed_words(cases.frame(spark, pairs), shard_words=200).collect()
    want = brute(pairs)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == want
    assert sum(w[2] for w in want) > 100


def test_fm_index_intervals():
    rng = np.random.default_rng(3)
    seq = rng.integers(0, 4, 400)
    index = FMIndex(seq, 5)
    at = np.arange(396)
    which, lo, hi = index.repeated(at, 5, batch=64)
    grams = [tuple(seq[i:i + 5]) for i in range(396)]
    many = {g: [i for i, x in enumerate(grams) if x == g] for g in set(grams)}
    assert sorted(which.tolist()) == [i for i in range(396) if len(many[grams[i]]) > 1]
    for w, a, b in zip(which.tolist(), lo.tolist(), hi.tolist()):
        assert sorted(index.suffixes[a:b].tolist()) == many[grams[w]]
    values = rng.integers(0, 1000, 400)
    least = index.least(values, lo, hi)
    assert [min(values[i] for i in many[grams[w]]) for w in which.tolist()] == least.tolist()


def test_empty(spark):
    assert substrings.removed_words(cases.empty(spark)).count() == 0
