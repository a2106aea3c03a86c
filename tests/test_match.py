import random
import re

import pytest

from seepage.functions.similarity import window_hit
from seepage.operators import gramscan
from seepage.operators.match import anchors, distinct_values, event_columns, leak_matches, prefix_trigrams, probe_tables
from tests.helpers import brute_match, fps_df, sim, writes_df
from tests.test_plans import formatted


def run(spark, fps, writes):
    m = leak_matches(writes_df(spark, writes), fps_df(spark, fps))
    return event_columns(m).collect()


def want_of(fps, writes):
    return {(wid, f, k) for wid, c, target, _, _ in writes for wt, f, v in fps if wt != target and (k := brute_match(c.encode(), v.encode()))}


def got_of(spark, fps, writes):
    return {(e.write_id, e.secret_field, e.match_kind) for e in run(spark, fps, writes)}


PIN = "mauve/otter:7731-quartz~lantern"


def test_event_of_a_value_in_another_root(spark):
    ev = run(spark, [("trees/north", "QUEUE_AUTH", PIN)], [(31, f"amqp_open('{PIN}', retries=2)", "trees/south", "trees/south/q.lua", 915)])
    assert len(ev) == 1
    e = ev[0]
    assert (e.source_worktree, e.target_worktree, e.target_path, e.match_kind, e.target_agent_pid) == ("trees/north", "trees/south", "trees/south/q.lua", "exact", 915)
    assert (e.secret_field, e.severity, e.source_agent_pid, e.write_id) == ("QUEUE_AUTH", "secret", 0, 31)


@pytest.mark.parametrize("root, value, content", [
    ("trees/south", PIN, f"x {PIN}"),        # in the root's own write
    ("trees/north", "7 bytes", "7 bytes"),   # too short to be matched
    ("trees/north", PIN, PIN[::-1]),
    ("trees/north", PIN, ""),
])
def test_silent(spark, root, value, content):
    assert run(spark, [(root, "QUEUE_AUTH", value)], [(1, content, "trees/south", "p", 0)]) == []


def test_last_byte_changed_needs_21_bytes(spark):
    fps = [("a", "LONG", PIN[:21]), ("a", "SHORT", PIN[:20])]
    assert got_of(spark, fps, [(1, "= " + PIN[:20] + "#", "b", "p", 0)]) == {(1, "LONG", "fuzzy"), (1, "SHORT", "exact")}
    assert got_of(spark, fps, [(1, "= " + PIN[:19] + "#", "b", "p", 0)]) == set()


def test_each_value_of_each_root_once(spark):
    fps = [("a", "ONE", PIN), ("a", "TWO", "sable-heron-0042"), ("c", "THREE", "not in there at all"), ("c", "FOUR", PIN)]
    got = got_of(spark, fps, [(5, f"{PIN} sable-heron-0042 {PIN}", "b", "p", 0)])
    assert got == {(5, "ONE", "exact"), (5, "TWO", "exact"), (5, "FOUR", "exact")}


def test_sets_of_trigrams(spark):
    """Rotations of a repetitive value, contents shorter than a value, other bytes than ASCII."""
    fps = [("a", "ROT", "xyzxyzxyzxyz"), ("a", "ROT2", "xyzxyzxyzxyz"), ("a", "WHOLE", "éàü-0123456789-straße"), ("a", "ONE", "zzzzzzzzz")]
    writes = [(1, "yzxyzxyzxyzx", "b", "p", 0), (2, "éàü-0123456789-straß", "b", "p", 0), (3, "xyzxyzxyzxyz.", "b", "p", 0), (4, "zzz", "b", "p", 0), (5, "zz", "b", "p", 0)]
    assert got_of(spark, fps, writes) == want_of(fps, writes)
    assert {(1, "ROT", "fuzzy"), (1, "ROT2", "fuzzy"), (3, "ROT", "exact"), (4, "ONE", "fuzzy")} <= want_of(fps, writes)


def random_case(seed, n_values, n_writes, alpha="abcdef0123", top=30):
    rnd = random.Random(seed)
    values = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(8, top))) for _ in range(n_values)]
    fps = [(f"wt-{i % 3}", f"F{i}", v) for i, v in enumerate(values)]
    writes = []
    for wid in range(n_writes):
        v = rnd.choice(values)
        i = rnd.randrange(len(v))
        c = [lambda: "x" * rnd.randint(0, 5) + v + "y", lambda: v[:i] + "Z" + v[i + 1:], lambda: v[:-1], lambda: v[1:] + v[:1] + " " + rnd.choice(values),
             lambda: "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 60)))][wid % 5]()
        writes.append((wid, c, f"wt-{wid % 4}", f"/w/{wid}", 0))
    return fps, writes


def test_random_parity_with_brute_force(spark):
    fps, writes = random_case(7, 25, 60)
    writes += [(100 + w[0], *w[1:]) for w in writes[:20]]  # copies of contents
    want = want_of(fps, writes)
    assert got_of(spark, fps, writes) == want and {k for _, _, k in want} == {"exact", "fuzzy"}


def test_long_content_windows_parity(spark, monkeypatch):
    """Contents of many segments; the scan's buffer ends inside values."""
    monkeypatch.setattr(gramscan, "_SEGMENT", 500)
    rnd = random.Random(23)
    alpha = "abcdefghij0123456789"
    values = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(20, 60))) for _ in range(12)]
    values += ["xyz" * 8, "ab" * 12]  # repetitive values: few distinct trigrams
    fps = [(f"wt-{i % 2}", f"V{i}", v) for i, v in enumerate(values)]
    writes = []
    for wid in range(30):
        body = [rnd.choice(alpha) for _ in range(rnd.randint(200, 3000))]
        v = rnd.choice(values)
        mutated = list(v)
        for _ in range(wid % 3):  # 0, 1 or 2 changed bytes
            mutated[rnd.randrange(len(v))] = "Q"
        at = rnd.randrange(len(body))
        body[at:at] = mutated if wid % 4 else list(v[3:] + v[:3])
        writes.append((wid, "".join(body), "wt-9", f"/w/{wid}", 0))
    want = want_of(fps, writes)
    assert got_of(spark, fps, writes) == want and len(want) > 10


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    """No probe table or candidate fits a broadcast: the same result, and the contents are read
    once to find candidates, however many values there are."""
    from seepage.operators import broadcast as B
    rnd = random.Random(3)
    values = ["-----BEGIN KEY-----" + "".join(rnd.choice("abcdef0123") for _ in range(rnd.randint(8, 40))) for _ in range(20)]
    fps = [(f"wt-{i % 2}", f"F{i}", v) for i, v in enumerate(values)]
    writes = [(i, "-" * rnd.randint(0, 50) + (v if i % 3 else v[:-1] + "Z") + "-" * 9, "wt-9", f"/w/{i}", 0) for i, v in enumerate(values)]
    one = sorted(map(str, run(spark, fps, writes)))
    monkeypatch.setattr(B, "MAX_BROADCAST_ROWS", 7)
    B.release()
    seen = []
    make = gramscan.scan
    monkeypatch.setattr(gramscan, "scan", lambda *a: seen.append(make(*a)) or seen[-1])
    assert sorted(map(str, run(spark, fps, writes))) == one and len(one) == 20
    assert len(seen) == 1


def test_large_probe_is_joined_by_a_shuffle_of_thin_rows(spark, monkeypatch):
    from seepage.operators import broadcast as B
    from seepage.operators.match import candidates
    fps, writes = random_case(5, 30, 10)
    monkeypatch.setattr(B, "MAX_BROADCAST_ROWS", 7)
    monkeypatch.setattr(B, "MAX_BROADCAST_BYTES", 99)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        probes = probe_tables(fps_df(spark, fps))
        txt = formatted(candidates(writes_df(spark, writes).selectExpr("unhex(sha2(content_bin, 256)) AS _ch", "content_bin"), probes))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert txt.count("MapInArrow") >= 1 and "SortMergeJoin" in txt
    exchanges = [p for p in txt.split("\n\n") if re.match(r"\(\d+\) Exchange", p.strip())]
    assert exchanges and not any("content_bin" in p for p in exchanges)


def test_common_beginnings_are_not_anchors(spark):
    """The anchor of a value lies where values differ; there is one for each value."""
    fps = [("wt-a", f"F{i}", "-----BEGIN RSA PRIVATE KEY-----" + f"{i * 7919:09d}") for i in range(200)]
    g = anchors(distinct_values(fps_df(spark, fps))).collect()
    assert len(g) == 200 and min(r.off for r in g) >= 20 and all(len(r.g) == 8 for r in g)


def test_prefixes_hold_two_of_any_match(spark):
    """T - m + 2 trigrams for each value, and how many of them a match holds."""
    values = ["abcdefgh", "aaaaaaaaa", "ababababab", PIN]
    rows = prefix_trigrams(distinct_values(fps_df(spark, [("w", str(i), v) for i, v in enumerate(values)]))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.vid, []).append(r)
    for own in by.values():
        v = next(v for v in values if len(v) == own[0].vlen and len({v[i:i + 3] for i in range(len(v) - 2)}) >= len(own))
        t = len({v[i:i + 3] for i in range(len(v) - 2)})
        slack = t - -(-9 * t // 10)
        assert sorted(r.idx for r in own) == list(range(1, min(t, slack + 2) + 1)) and {r.need for r in own} == {min(t, slack + 2) - slack}


def test_filters_pass_what_they_hold(spark):
    """Every stored gram passes; others hardly do."""
    fps, _ = random_case(1, 60, 0, top=60)
    probes = probe_tables(fps_df(spark, fps))
    content = "".join(v for _, _, v in fps).encode()
    own = gramscan.Scan(probes.filters, (gramscan.EXACT, gramscan.FUZZY))
    found = {b["kind"][0].as_py(): b for b in own._rows([b"h"], [len(content)], [0], content)}
    keys = {k: {r.key for r in probes.probe.collect() if r.kind == k} for k in (0, 1)}
    assert keys[0] <= set(found[0]["key"][0].as_py()) and keys[1] <= set(found[1]["key"][0].as_py())
    rnd = random.Random(2)
    noise = bytes(rnd.randrange(256) for _ in range(200_000))
    passed = sum(len(b["pos"][0]) for b in own._rows([b"h"], [len(noise)], [0], noise) if b["kind"][0].as_py() == 0)
    assert passed < 400


def test_window_test_against_sets(spark):
    rnd = random.Random(9)
    for _ in range(400):
        v = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(8, 30))) if rnd.random() < 0.5 else bytes(rnd.choice(b"abcdefgh") for _ in range(rnd.randint(8, 30)))
        c = bytearray(v * 2 if rnd.random() < 0.3 else bytes(rnd.choice(b"abcdefgh") for _ in range(rnd.randint(0, 40))) + v + b"xx")
        for _ in range(rnd.randrange(3)):
            c[rnd.randrange(len(c))] = rnd.choice(b"abQ")
        c = bytes(c[:rnd.randint(0, len(c))]) if rnd.random() < 0.2 else bytes(c)
        lo, hi = rnd.randint(0, 20), rnd.randint(0, 60)
        n, size = len(c), len(v)
        want = sim(c, v) >= 0.9 if n < size else any(sim(c[i:i + size], v) >= 0.9 for i in range(lo, min(n - size, hi) + 1))
        assert window_hit(c, v, lo, hi) == want, (c, v, lo, hi)
