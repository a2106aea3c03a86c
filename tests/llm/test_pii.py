import hashlib
import random
import re

import numpy as np

from seepage.llm import pii
from seepage.llm.tagger import KINDS, Tagger, pack, tags_of
from tests.llm import cases

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(s))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), k, (kind, m.start(), m.end())))
    return [x for *_, x in sorted(out)]


def card(rng):
    d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if luhn(d + c))


def planted(rng):
    return rng.choice([f"{rng.choice(['ann', 'bob.x', 'c_d'])}{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)),
                       card(rng), f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"])


def prose(seed, n=150):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(10, 60))]
        for _ in range(rng.randrange(0, 3)):
            w.insert(rng.randrange(len(w)), planted(rng))
        if rng.random() < 0.3:
            w.insert(rng.randrange(len(w)), rng.choice(["1984", "v2.1", "x@", "a1b2c3d4", "10%"]))
        out.append(" ".join(w))
    return out


def test_base_spans_against_plain_patterns():
    rng = random.Random(1)
    odd = ["a@b", "a@b.c@d.e", "@a.b", "x..y@-.-", "1.2.3.4.5.6.7.8", "999.1.1.1", "01.002.0255.9", "1.2.3.", "4111 1111-1111 1111", "4111  1111", "+1-", "+12 (3", "++123456789", "+1 2 3 4 5 6 7 8 9 x",
           "9" * 5000, "0" * 20, "é1.2.3.4é", "１.2.3.4", "a@b.c." + "d" * 50]
    odd += ["".join(rng.choice("0123456789.-+ ()@ab") for _ in range(rng.randrange(1, 80))) for _ in range(600)]
    for t in odd + prose(2, 30) + [x or "" for x in cases.ODD]:
        assert pii.base_spans(t) == brute(t), t


def test_reconcile_is_the_best_choice():
    rng = random.Random(3)
    for _ in range(200):
        base = [("ip", 10, 20)] * (rng.random() < 0.5)
        props = {("card", a, a + rng.randrange(3, 12)): rng.choice([1.0, 2.0, 3.5]) for a in rng.sample(range(40), 6)}
        got = pii.reconcile(base, props)
        free = [(s, v) for s, v in props.items() if not any(s[1] < b and a < s[2] for _, a, b in base)]
        best = 0.0
        for pick in range(1 << len(free)):
            some = [free[i] for i in range(len(free)) if pick >> i & 1]
            if all(x[0][2] <= y[0][1] or y[0][2] <= x[0][1] for i, x in enumerate(some) for y in some[:i]):
                best = max(best, sum(v for _, v in some))
        assert set(base) <= set(got)
        added = [s for s in got if s not in base]
        assert abs(sum(props[s] for s in added) - best) < 1e-9
        assert all(x[2] <= y[1] for x, y in zip(got, got[1:]))


def test_grid_holds_every_trigger():
    rng = random.Random(5)
    for _ in range(100):
        t = "".join(rng.choice("a" * 60 + "1@") for _ in range(rng.randrange(1, 400)))
        starts = pii.grid(t, 32)
        assert starts == [s for s in range(0, len(t), 16) if re.search("[0-9@]", t[s:s + 32])]


def test_gradient():
    tagger = Tagger(hidden=3, width=4)
    codes, mask = pack(["ab 1", "x@y.z"])
    gold = np.zeros(codes.shape, np.int64)
    gold[:5, 1] = tags_of(5, [("email", 0, 5)])
    _, grad = tagger.loss(codes, mask, gold)
    rng = np.random.default_rng(1)
    for key, g in grad.items():
        at = tuple(rng.integers(0, n) for n in g.shape) if key != "e" else (codes[0, 0], 1)
        was = tagger.p[key][at]
        tagger.p[key][at] = was + 1e-5
        up = tagger.loss(codes, mask, gold)[0]
        tagger.p[key][at] = was - 1e-5
        down = tagger.loss(codes, mask, gold)[0]
        tagger.p[key][at] = was
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4, key


def test_held_out_accuracy_of_the_tagger(spark):
    tagger = pii.train(pii.clean_docs(cases.frame(spark, list(enumerate(prose(7, 250))))))
    hit = made = real = 0
    for t in prose(8, 80):
        want = set(pii.base_spans(t))
        got = set()
        for at, spans in zip(pii.grid(t, 96), tagger.decode([t[a:a + 96] for a in pii.grid(t, 96)]) if pii.grid(t, 96) else []):
            got |= {(k, at + a, at + b) for k, a, b, _ in spans if not (a == 0 and at) and not (b == 96 and at + 96 < len(t))}
        hit, made, real = hit + len(want & got), made + len(got), real + len(want)
    assert hit >= 0.85 * real and hit >= 0.8 * made


def test_query_rows(spark):
    pairs = cases.with_null_id(cases.rows(1, 10) + [(800 + i, t) for i, t in enumerate(prose(9, 30))] + [(900, prose(1, 1)[0] * 200)])
    got = pii.find_pii(cases.frame(spark, pairs), max_windows=60).collect()
    told = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
    want = [(d, *(sum(s[0] == k for s in brute(t)) for k in KINDS), hashlib.sha256(told(brute(t)).encode()).hexdigest()) for d, t in pairs]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        t = next(t for d, t in pairs if d == r.doc_id and told(brute(t)) in (r.spans, told(brute(t))))
        if r.doc_id not in (3, None):
            assert set(told(brute(t)).split(",")) - {""} <= set(r.spans.split(","))


def test_without_labels_and_empty(spark):
    got = pii.find_pii(cases.frame(spark, [(1, "no numbers"), (2, "1 or 2")])).collect()
    assert [(r.n_added, r.spans) for r in got] == [(0, ""), (0, "")]
    assert pii.find_pii(cases.empty(spark)).count() == 0


def test_mails_against_the_pattern():
    """The linear search finds what the pattern does, on texts of little else than its characters."""
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    rng = random.Random(12)
    for _ in range(4000):
        t = "".join(rng.choice("ab.@-_ %é") for _ in range(rng.randrange(30)))
        assert pii._mails(t) == [("email", *m.span()) for m in mail.finditer(t)], t


def test_long_runs_before_an_at_are_linear():
    import time
    began = time.time()
    for t in ("a" * 1_000_000 + "@", "a." * 500_000 + "@b", "a@" * 500_000, "x@" + "b-" * 500_000, "x@" + "b." * 500_000):
        pii._mails(t)
    assert time.time() - began < 10
