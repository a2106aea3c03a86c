import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seepage.llm import mixing
from tests.llm import cases


def table(spark, n=300, seed=2):
    """Domain 'a' is short English, 'b' long German, 'c' either."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        d = "abc"[rng.integers(0, 3)] if i % 3 else "a"
        long = d == "b" or (d == "c" and rng.random() < 0.5)
        rows.append((i, " ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(40, 60) if long else rng.integers(4, 8))), "de" if long else "en", d, 1))
        if rng.random() < 0.5:
            labels.append((i, 1, 0))
    return (spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def brute(rows, labelled, targets, lowest=0.0, cap=4.0, size=1.0, gap=1e-3):
    """Naive Bayes, own domains of labelled rows, and accelerated projected gradient, one document at a time."""
    names = mixing.FEATURES
    own = [r for i, r in enumerate(rows) if i in labelled]
    domains = sorted({r["domain"] for r in own})
    post = []
    for i, r in enumerate(rows):
        if i in labelled:
            post.append(np.array([float(d == r["domain"]) for d in domains]))
            continue
        s = []
        for d in domains:
            mine = [x for x in own if x["domain"] == d]
            v = math.log((len(mine) + 1) / (len(own) + len(domains)))
            for k in names:
                v += math.log((sum(x[k] == r[k] for x in mine) + 1) / (len(mine) + len({x[k] for x in own}) + 1))
            s.append(v)
        e = np.exp(np.array(s) - max(s))
        post.append(e / e.sum())
    post, tok = np.array(post), np.array([r["tokens"] for r in rows], float)
    w = tok / tok.sum()
    aim = np.array([targets.get(d, 0.0) for d in domains])
    aim = size * aim / aim.sum()
    h = (post * w[:, None]).T @ post
    norm = np.linalg.inv(h + (1e-6 * np.trace(h) / len(aim) + 1e-30) * np.eye(len(aim)))
    r = y = np.full(len(rows), min(max(size, lowest), cap))
    speed, gaps = 1.0, []
    while True:
        gaps.append(np.abs((w * r) @ post - aim).sum())
        if gaps[-1] <= gap / 2 or (len(gaps) > 10 and min(gaps[-10:]) > 0.99 * min(gaps[:-10])) or len(gaps) == 60:
            return r, gaps, aim
        speed = 1.0 if len(gaps) > 1 and gaps[-1] > gaps[-2] else speed
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        new = np.clip(y - post @ (norm @ ((w * y) @ post - aim)), lowest, cap)
        y, r, speed = new + (speed - 1) / faster * (new - r), new, faster


def features(docs, labels):
    return mixing._labelled(mixing._features(docs, "f"), labels, "f")


@pytest.mark.parametrize("how", [{}, {"lowest": 1.0, "size": 1.5}, {"lowest": 0.5, "cap": 1.5}])
def test_rates_against_brute_force(spark, how):
    """The default path, and bounds that leave a gap."""
    docs, labels = table(spark)
    targets = {"a": 0.2, "b": 0.5, "c": 0.3}
    out = mixing.with_rates(docs, labels, targets=targets, **how)
    name = out.columns[-1]
    got = {r.doc_id: r[name] for r in out.collect()}
    d = mixing._features(docs, "f").orderBy("doc_id").collect()
    want, gaps, _ = brute([r.f.asDict() for r in d], {r.doc_id for r in labels.collect()}, targets, **how)
    assert len(got) == len(want) and max(abs(got[i].rate - w) for i, w in enumerate(want)) < 1e-5
    assert abs(got[0].gap - gaps[-1]) < 1e-4 and gaps[-1] < gaps[0]
    assert how or got[0].gap <= 1e-3


def test_kept_rows_and_columns(spark):
    docs = cases.frame(spark, cases.with_null_id(cases.rows(3, 40)))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    out = mixing.mix(docs, labels, steps=5)
    assert out.columns == docs.columns
    assert 0 < out.count() <= 4 * docs.count()
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(docs, labels, steps=5).collect()))
    more = mixing.mix(docs, labels, lowest=1.0, size=1.5)
    assert set(map(str, more.collect())) == set(map(str, docs.collect()))


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert mixing.with_rates(cases.frame(spark, cases.rows(1, 10, long=False)), none, steps=3).count() > 0
    assert mixing.mix(cases.empty(spark), none).count() == 0


def hot(spark, n=600):
    """Texts that hardly tell their source, and one source with half of them."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        d = "hot" if i % 2 else "xyz"[rng.integers(0, 3)]
        rows.append((i, " ".join(["w"] * int(rng.integers(3, 60) + 3 * (d == "hot"))), ["en", "de", "fr"][rng.integers(0, 3)], d, 1))
    return (spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame([(i, 1, 0) for i in range(0, n, 5)] + [(i, 1, 0) for i in range(1, n, 5)], "doc_id bigint, quality int, toxic int"))


def tempered(rated):
    got = {r.domain: (r.n_tokens, r.n_out) for r in mixing.shares(rated).collect()}
    aim = {d: math.sqrt(t) for d, (t, _) in got.items()}
    all_in, all_out, all_aim = (sum(x) for x in ([t for t, _ in got.values()], [t for _, t in got.values()], aim.values()))
    return (sum(abs(t / all_in - aim[d] / all_aim) for d, (t, _) in got.items()), sum(abs(t / all_out - aim[d] / all_aim) for d, (_, t) in got.items()))


def test_fit_reaches_its_targets(spark):
    docs, labels = hot(spark)
    rows = features(docs, labels)
    cells, _, history, left = mixing.fit(rows, "f")
    tokens = {r.domain: r.t for r in rows.groupBy("f.domain").agg({"f.tokens": "sum"}).toDF("domain", "t").collect()}
    aim = np.sqrt([tokens[x] for x in sorted(tokens)])
    aim /= aim.sum()
    c = cells.toPandas()
    totals = (c.tokens * c.rate).to_numpy() @ np.array(c.posterior.tolist()) / c.tokens.sum()
    gap = np.abs(totals - aim).sum()
    assert abs(gap - left) < 1e-6 and gap <= 1e-3 and (c.rate >= 0).all() and (c.rate <= 4).all()
    assert history[0] > 0.1


def test_unreachable_targets_are_reported(spark):
    docs, labels = hot(spark, 100)
    with pytest.warns(UserWarning, match="target weights"):
        _, _, _, left = mixing.fit(features(docs, labels), "f", targets={"x": 1.0})
    assert left > 0.5


def test_mix_comes_nearer_and_drops_nothing(spark):
    """What comes out is nearer the targets than what goes in; copies follow the rates."""
    docs, labels = hot(spark)
    out = mixing.with_rates(docs, labels, lowest=1.0, size=1.5)
    rows = [(r.doc_id, r[out.columns[-1]]) for r in out.collect()]
    assert all(int(m.rate) <= m.copies <= int(m.rate) + 1 and m.copies >= 1 for _, m in rows)
    assert abs(sum(m.tokens * (m.copies - m.rate) for _, m in rows)) < 0.05 * sum(m.tokens for _, m in rows)
    before, after = tempered(out)
    assert after < 0.6 * before
    mixed = mixing.mix(docs, labels, lowest=1.0, size=1.5)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({i: m.copies for i, m in rows})


def test_thinning_comes_nearer(spark):
    docs, labels = hot(spark)
    before, after = tempered(mixing.with_rates(docs, labels))
    assert after < 0.6 * before


def test_texts_are_read_once(spark, monkeypatch):
    seen = []
    write = mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, n: seen.append(df) or write(df, n))
    docs, labels = hot(spark, 100)
    seen.append(mixing.with_rates(docs, labels))
    reads = [d for d in seen if "split(" in d._jdf.queryExecution().optimizedPlan().toString()]
    assert len(reads) == 1


def test_labelled_ids_by_broadcast_or_shuffle(spark, monkeypatch):
    """The same rows whether the labelled ids fit their bound or not; within it no text is shuffled for them."""
    docs = spark.createDataFrame([(i, "word " * (1 + i % 9), "en", f"s{i % 3}") for i in range(60)] + [(None, "none", "en", "s1")], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i,) for i in range(0, 60, 4)] + [(None,), (4,)], "doc_id bigint")
    got = []
    for bound in (mixing.MAX_BROADCAST_IDS, 0):
        monkeypatch.setattr(mixing, "MAX_BROADCAST_IDS", bound)
        d = mixing._labelled(mixing._features(docs, "m"), labels, "m")
        got.append(sorted((str(r.doc_id), r.m.labelled, r.m.tokens) for r in d.collect()))
    assert got[0] == got[1] and sum(x[1] for x in got[0]) == 15 and len(got[0]) == 61
