import random

import pytest

from seepage.llm import jaccard
from tests.llm import cases


def shingles(text):
    w = cases.WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(pairs):
    sets = [shingles(t) for _, t in pairs]
    up = list(range(len(pairs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and pairs[i][0] is not None and pairs[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(pairs)), key=str)


def near_copies(seed, n):
    """A chain of edits (few direct links between its ends) and one common passage."""
    rng = random.Random(seed)
    w = cases.words(rng, 90, 5000)
    out = []
    passage = cases.words(rng, 40, 5000)
    for i in range(n):
        w = list(w)
        w[rng.randrange(len(w))] = f"c{rng.randrange(9999)}"
        out.append((100 + i, " ".join(w)))
        out.append((1000 + i, " ".join(cases.words(rng, 30, 5000) + passage)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    pairs = cases.with_null_id(cases.rows(seed) + near_copies(seed, 30))
    random.Random(seed).shuffle(pairs)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(cases.frame(spark, pairs)).collect()), key=str)
    assert got == brute(pairs)


def test_levels_and_frequent_table(spark):
    """Recursion without leaves, and an order that knows the frequent shingles."""
    pairs = near_copies(4, 50)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(cases.frame(spark, pairs), leaf=1, levels=2).collect()), key=str)
    assert got == brute(pairs)


def test_keep_one(spark):
    docs = cases.frame(spark, cases.with_null_id([(5, "a b c d e f"), (2, "A b c d e f"), (9, "other words"), (4, None)]))
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in out.where("doc_id IS NOT NULL").collect()) == [(False, 2), (False, 4), (False, 9)]
    assert out.where("doc_id IS NULL").count() == 2


def test_empty(spark):
    assert jaccard.jaccard_classes(cases.empty(spark)).count() == 0
