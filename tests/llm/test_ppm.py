import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from seepage.llm import ppm
from tests.llm import cases


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


def tokens(t):
    return cases.WORD.findall("".join(c.lower() if c.isascii() else c for c in t or "")) + [None]


class Brute:
    def __init__(self, texts, order):
        self.order, self.next = order, defaultdict(Counter)
        for t in texts:
            s = self.seq(t)
            for p in range(order, len(s)):
                for k in range(order + 1):
                    self.next[s[p - k:p]][s[p]] += 1

    def seq(self, t):
        return bytes([0xFE]) * self.order + (t or "").encode().lower() + b"\xff"

    def log10(self, s, p):
        out, gone = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = self.next.get(s[p - k:p])
            if not seen:
                continue
            left = {b: n for b, n in seen.items() if b not in gone}
            total = sum(left.values()) + len(left)
            if s[p] in left:
                return out + math.log10(left[s[p]] / total)
            if left:
                out += math.log10(len(left) / total)
            gone |= set(seen)
        return out - math.log10(255 - len(gone))


def test_scores_against_brute_force(spark):
    pairs = cases.with_null_id(cases.rows(3, 40))
    n, c = 0, Counter()
    for d, t in pairs:
        if not held(d):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    model = Brute([t for d, t in pairs if not held(d)], 3)
    want = []
    for d, t in pairs:
        w, s = tokens(t), model.seq(t)
        want.append((d, held(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6), round(sum(model.log10(s, p) for p in range(3, len(s))), 2)))
    got = ppm.scores(cases.frame(spark, pairs), order=3, max_nodes=10**7).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 2)) for r in got), key=str) == sorted(want, key=str)


def test_probabilities_sum_to_one(spark):
    """Also with a trie cut to its most frequent grams."""
    docs = cases.frame(spark, cases.rows(2, 20, long=False))
    trie = ppm.train(docs, order=3, max_nodes=150)
    for before in (b"", b"w1", b"w12 ", b"zz", b"\xc3"):
        total = 0.0
        for b in range(256):
            if b != ppm.START:
                seq = np.frombuffer((bytes([ppm.START]) * 3 + before)[-3:] + bytes([b]), np.uint8)
                total += 10 ** float(trie._piece(seq)[0])
        assert abs(total - 1) < 1e-5


def test_model_beats_uniform_on_held_out_text(spark):
    got = ppm.scores(cases.frame(spark, cases.rows(4, 60))).toPandas()
    one = got[got.held_out]
    assert len(one) and (one.score > -math.log10(255) * 1000 * one.n_tokens).all()


def test_empty_and_untrained(spark):
    assert ppm.scores(cases.empty(spark)).count() == 0
    held_out = next(i for i in range(100) if held(i))
    r = ppm.scores(cases.frame(spark, [(held_out, "a b")])).collect()[0]
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0)
    assert abs(r.score + 4 * math.log10(255)) < 1e-9


def expected_scores(pairs, order):
    model = Brute([t for d, t in pairs if not held(d)], order)
    return sorted((d, round(sum(model.log10(model.seq(t), p) for p in range(order, len(model.seq(t)))), 2)) for d, t in pairs)


def test_default_parameters_keep_every_gram(spark):
    """More than 100,000 distinct grams of 5 bytes, with the parameters of the query."""
    rng = np.random.default_rng(5)
    pairs = [(i, "".join(rng.choice(list("abcdefghijklmnop \u00e9"), 5000))) for i in range(30)]
    assert len({t[i:i + 5] for d, t in pairs if not held(d) for i in range(len(t) - 4)}) > 100_000
    got = ppm.scores(cases.frame(spark, pairs)).collect()
    assert sorted((r.doc_id, round(r.score, 2)) for r in got) == expected_scores(pairs, 4)


def test_slices_add_up_to_the_whole_model(spark):
    pairs = [(i, t) for i, (_, t) in enumerate(cases.rows(3, 40))]
    docs = cases.frame(spark, pairs)
    trained = ppm.train(docs, order=3, max_nodes=700)
    sizes = [len(trained.slice(i).keys[3]) for i in range(len(trained.ranges))]
    whole = ppm.train(docs, order=3)
    assert len(sizes) > 2 and len(whole.ranges) == 1 and sum(sizes) == len(whole.slice(0).keys[3])
    got = ppm.scores(docs, order=3, max_nodes=700).collect()
    assert sorted((r.doc_id, round(r.score, 2)) for r in got) == expected_scores(pairs, 3)
