import random

from seepage.llm import lines
from tests.llm import cases


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(pairs):
    places = {}
    for i, t in pairs:
        for no, line in enumerate((t or "").split("\n")):
            if cases.WORD.search(line) and i is not None:
                places.setdefault(line, set()).add((i, no))
    first = {line: min(p) for line, p in places.items()}
    gone = {line: any(first[o] < first[line] and near(o, line) for o in first if o != line) for line in first}
    return {(p, line): gone[line] or p != first[line] for line, ps in places.items() for p in ps}


def line_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab cdé") for _ in range(rng.randrange(1, 60))) for _ in range(25)]
    pool = list(base)
    for _ in range(120):
        s = rng.choice(pool)
        at = rng.randrange(len(s) + 1)
        op = rng.randrange(3)
        pool.append(s[:at] + rng.choice("abé x") * (op != 1) + s[at + (op != 0):])
    pool += ["", "aaaa", "aaa", "aaaaa", "a", "b", "ab", " \t"]
    docs, k = [], 0
    while k < len(pool):
        n = rng.randrange(1, 6)
        docs.append("\n".join(pool[k:k + n]))
        k += n
    order = list(range(len(docs)))
    rng.shuffle(order)
    return list(zip(order, docs))


def test_against_brute_force(spark):
    for seed in (1, 2):
        pairs = line_rows(seed) + [(10_000, None), (10_001, "")]
        want = brute(pairs)
        got = {(r.doc_id, r.no): r.removed for r in lines.removed_lines(cases.frame(spark, pairs)).collect()}
        assert got == {p: v for (p, _), v in want.items()}
        assert sum(want.values()) > 40


def test_odd_rows(spark):
    pairs = cases.with_null_id(cases.rows(n=15))
    got = {(r.doc_id, r.no): r.removed for r in lines.removed_lines(cases.frame(spark, pairs)).collect() if r.doc_id not in (None, 3)}
    assert got == {p: v for (p, _), v in brute(pairs).items() if p[0] != 3}
    assert not any(r.removed for r in lines.removed_lines(cases.frame(spark, pairs)).where("doc_id IS NULL").collect())


def test_dedup_keeps_columns(spark):
    docs = cases.frame(spark, [(1, "one line\nother line\n\n"), (2, "one lime\nthird"), (3, None)])
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "one line\nother line\n\n", 2: "third", 3: None}


def test_empty(spark):
    assert lines.removed_lines(cases.empty(spark)).count() == 0
