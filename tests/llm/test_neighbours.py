import math

import numpy as np
import pytest

from seepage.llm import neighbours
from seepage.llm.common import table

SCHEMA = "vec_id bigint, embedding array<float>, label int, v int, words string"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def brute(rows, every=20, k=20):
    """All products, in the operator's order of summation."""
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    n = [len(v) for _, v in good]
    good = [(i, v) for i, v in good if len(v) == max(set(n), key=lambda x: (n.count(x), x))]
    out = []
    for i, q in {(i, tuple(v)) for i, v in good if i % every == 0}:
        found = sorted((-float((v[None] * np.array(q)[None]).sum(axis=1)[0]), j) for j, v in good if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def data(n=900, dims=70, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    return [(i, (centres[rng.integers(6)] + rng.standard_normal(dims) * rng.choice([0.2, 1.0])).astype(np.float32).tolist()) for i in range(n)]


def odd(dims=70):
    rows = data()
    rows += [(None, rows[1][1]), (901, None), (902, [0.0] * dims), (903, [None] + [1.0] * (dims - 1)), (904, [math.nan] * dims), (905, [math.inf] + [1.0] * (dims - 1)), (920, [1.0, 2.0]), (921, [])]
    rows += [(i, rows[7][1]) for i in range(1000, 1100)]  # many ties
    return rows + [(40, rows[3][1]), rows[60], rows[60], (50, rows[51][1]), (-20, rows[2][1])]


@pytest.mark.parametrize("parts", [(16_384, 16), (100, 3)])
def test_recall_and_scores(spark, monkeypatch, parts):
    """In one part, which is searched exactly, and in several, by codes and bounds."""
    monkeypatch.setattr(neighbours, "FIRST", parts[0])
    monkeypatch.setattr(neighbours, "GROWTH", parts[1])
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rows = odd()
    got = neighbours.nearest(frame(spark, rows))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got, want = sorted(map(tuple, got.collect())), brute(rows)
    if parts[0] > 1000:
        assert got == want
    else:
        assert len(got) == len(want) and {(i, j, s) for i, _, j, s in got} <= {(i, j, s) for i, _, j, s in brute(rows, k=2000)}
        assert len({(i, j) for i, _, j, _ in got} & {(i, j) for i, _, j, _ in want}) >= 0.99 * len({(i, j) for i, _, j, _ in want})


def test_bounds_hold(spark):
    """Products above estimate and bound are as rare as three standard deviations say, and few rows pass."""
    x = np.array([v for _, v in data(4000, 64)])
    space = neighbours.Space(x[:500].mean(axis=0))
    words, scale, slack = space.codes(x)
    q = x[::50]
    most = neighbours._estimates(words, scale, slack, space.planes(q), 64, 3.0)
    exact = x @ q.T
    assert (exact > most + 1e-9).mean() < 0.004
    least = np.sort(exact, axis=0)[-20]
    assert (most >= least).mean() < 0.25
    assert ((most >= least) & (exact >= least)).sum() >= 0.995 * (exact >= least).sum()


def test_several_broadcasts(spark):
    rows = data(300, 16)
    assert sorted(map(tuple, neighbours.nearest(frame(spark, rows), every=3, query_bytes=2000).collect())) == brute(rows, every=3)


def test_fewer_than_k_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (20, [-1.0, 0.0])]
    assert sorted(map(tuple, neighbours.nearest(frame(spark, rows)).collect())) == brute(rows) and len(brute(rows)) == 4
    assert neighbours.nearest(frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, [(1, [0.0]), (20, None)])).count() == 0


def test_registered_query(spark):
    got = sorted(map(tuple, neighbours.op12_nearest(spark, SF).collect()))
    assert got == brute([(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()])
