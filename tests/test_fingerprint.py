import re

from pyspark.sql import functions as F

from seepage import api
from seepage.operators.fingerprint import fingerprints
from seepage.operators.roots import actor_per_root, measured_roots, owner_root


def fp(spark, files, roots):
    f = spark.createDataFrame(files, "path string, content string")
    r = spark.createDataFrame([(x,) for x in roots], "path string")
    return fingerprints(f, r).collect()


ENV = ("DB_TOKEN=super-secret-token-1234567890\n# a comment\nDEBUG=true\nEMPTY=\n"
       'QUOTED="quoted-value-abcdefgh"\n')


def test_env_file(spark):
    got = {r.field: r for r in fp(spark, [("/r/wt-a/.env", ENV)], ["/r/wt-a"])}
    assert set(got) == {"DB_TOKEN", "DEBUG", "QUOTED"}
    assert got["DB_TOKEN"].classification == "secret"
    assert got["DB_TOKEN"].value == "super-secret-token-1234567890"
    assert got["QUOTED"].value == "quoted-value-abcdefgh"


def test_key_blob_and_pruning(spark):
    blob = "-----BEGIN RSA PRIVATE KEY-----\nMIIEowIBAAKCAQEA...\n-----END RSA PRIVATE KEY-----\n"
    got = fp(spark, [("/r/wt-a/id_rsa", blob), ("/r/wt-a/.git/config.env", "LEAK=should-not-be-scanned-12345678"),
                     ("/r/build/.env", "A=bbbbbbbbbbbb"), ("/r/wt-a/.envrc", "A=b")], ["/r/wt-a", "/r/build"])
    assert [(r.field, r.classification) for r in got] == [("id_rsa", "secret")]


def test_nested_roots_fingerprint_once_per_root(spark):
    got = fp(spark, [("/r/wt-1/.env", "A_TOKEN=abcdefghijkl")], ["/r", "/r/wt-1", "/r/wt-10"])
    assert sorted(r.worktree for r in got) == ["/r", "/r/wt-1"]


def test_longest_prefix_owner_and_actor(spark):
    roots = spark.createDataFrame([("/repo",), ("/repo/wt-1",), ("/repo/wt-10",)], "path string")
    w = spark.createDataFrame([(1, "/repo/wt-10/x"), (2, "/repo/wt-1/y"), (3, "/repo/z"), (4, "/other/a"),
                               (5, "/repo/wt-1")], "id long, path string")
    got = {r.id: r.owner for r in owner_root(w, "path", roots).collect()}
    assert got == {1: "/repo/wt-10", 2: "/repo/wt-1", 3: "/repo", 5: "/repo/wt-1"}
    procs = spark.createDataFrame([(10, 2, "/repo/wt-1/a"), (11, 1, "/repo/wt-1"), (12, 3, "/repo/q")],
                                  "pid long, ord long, cwd string")
    got = {r.worktree: r.agent_pid for r in actor_per_root(procs, roots).collect()}
    assert got == {"/repo": 12, "/repo/wt-1": 11, "/repo/wt-10": 0}


def test_other_domains(spark):
    from seepage.operators.match import other_domain_counts
    from tests.helpers import fps_df, writes_df
    f = fps_df(spark, [("wt-a", "A", "aaaaaaaaaa"), ("wt-a", "B", "bbbbbbbbbb"), ("wt-b", "C", "cccccccccc"),
                       ("wt-c", "D", "short")])
    w = writes_df(spark, [(1, "x", "wt-b", "/p", 0), (2, "y", "wt-z", "/q", 0)])
    got = {r.target_worktree: r.n_candidates for r in other_domain_counts(w, f).collect()}
    assert got == {"wt-b": 2, "wt-z": 3}


def test_promote_unknown_hook_and_api(spark):
    from seepage import api
    files = spark.createDataFrame([("/r/a/.env", "PLAIN=opaque-token-with-no-field-signal\nDB_TOKEN=abcdefghijkl\n")],
                                  "path string, content string")
    roots = spark.createDataFrame([("/r/a",), ("/r/b",)], "path string")
    s = api.scan(files, roots)
    assert {(r.field, r.classification) for r in s["fingerprints"].collect()} == {
        ("PLAIN", "unknown"), ("DB_TOKEN", "secret")}
    promoted = fingerprints(files, spark.createDataFrame([("/r/a",)], "path string"),
                            promote=lambda df: df.withColumn("classification", F.lit("secret")))
    assert {r.classification for r in promoted.collect()} == {"secret"}
    writes = spark.createDataFrame([(1, None, "/r/b/x.txt", "use abcdefghijkl here")],
                                   "write_id long, ts timestamp_ntz, path string, content string")
    ev = api.leaks(writes, files, roots).collect()
    assert [(e.source_worktree, e.target_worktree, e.match_kind) for e in ev] == [("/r/a", "/r/b", "exact")]
    assert s["totals"].first().n_fingerprints == 2


def test_values_that_are_not_utf8_keep_their_bytes(spark):
    """Latin-1, an invalid pair and a white-space byte that is none on its own."""
    import hashlib
    from seepage import api
    raw = b"PASSWORD=caf\xe9-secret-12345\r\n\xa0K=\xff\xfe-abcdefgh\n\xc2\xa0Q = \"\xc2\xa0x\xe9\xe9yyyyyy\"\xe3\x80\x80\n"
    files = spark.createDataFrame([("/r/a/.env", bytearray(raw))], "path string, content binary")
    roots = spark.createDataFrame([("/r/a",), ("/r/b",)], "path string")
    values = [b"caf\xe9-secret-12345", b"\xff\xfe-abcdefgh", b"\xc2\xa0x\xe9\xe9yyyyyy"]
    got = fingerprints(files, roots).orderBy("ord").collect()
    assert [r.value_hash for r in got] == [hashlib.sha256(v).hexdigest()[:16] for v in values]
    assert [bytes(r.value_bin) for r in got] == values
    writes = spark.createDataFrame([(i, None, "/r/b/x.txt", bytearray(b"xx " + v + b" yy")) for i, v in enumerate(values)],
                                   "write_id long, ts timestamp_ntz, path string, content binary")
    assert sorted((e.write_id, e.match_kind) for e in api.leaks(writes, files, roots).collect()) == [(0, "exact"), (1, "exact"), (2, "exact")]


def test_pid_zero_does_not_hide_a_later_process(spark):
    roots = spark.createDataFrame([("/r/a",), ("/r/b",)], "path string")
    procs = spark.createDataFrame([(0, 1, "/r/a"), (7, 2, "/r/a/x"), (9, 3, "/r/a"), (0, 4, "/r/b")], "pid long, ord long, cwd string")
    assert {r.worktree: r.agent_pid for r in actor_per_root(procs, roots).collect()} == {"/r/a": 7, "/r/b": 0}


def test_model_sees_unknown_values_only(spark):
    """What the model says of unknown values counts; others keep their class, also those that are not UTF-8."""
    from seepage.operators.promote import LinearScorer, promoter
    env = b"DB_TOKEN=11111111111111111111\nDEBUG=true\nPIN=99887766554433221100998877\nWORDS=just some plain words\nRAW=\xff\xfe99887766554433221100\n"
    files = spark.createDataFrame([("/r/a/.env", bytearray(env))], "path string, content binary")
    roots = spark.createDataFrame([("/r/a",)], "path string")
    before = {r.field: r.classification for r in fingerprints(files, roots).collect()}
    after = {r.field: r.classification for r in fingerprints(files, roots, promoter(LinearScorer())).collect()}
    assert before == {"DB_TOKEN": "secret", "DEBUG": "config", "PIN": "unknown", "WORDS": "unknown", "RAW": "unknown"}
    assert after == before | {"PIN": "secret", "RAW": "secret"}
    state = promoter(lambda fields, values: ["state" if f == b"WORDS" else "unknown" for f in fields])
    assert {r.field: r.classification for r in fingerprints(files, roots, state).collect()} == before | {"WORDS": "state"}


def test_many_chained_roots_and_no_broadcast(spark, monkeypatch):
    """400 roots below one another, more depths than there are joins for; the shuffled way agrees."""
    from seepage.operators import broadcast as B
    paths = ["/" + "/".join(f"d{j}" for j in range(i + 1)) for i in range(400)]
    roots = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = spark.createDataFrame([(i, paths[i] + "/f", "content") for i in range(0, 400, 37)] + [(-1, "/other", "x"), (-2, None, "x")], "id long, path string, content string")
    want = {i: paths[i] for i in range(0, 400, 37)}
    assert {r.id: r.owner for r in owner_root(rows, "path", roots).collect()} == want
    B.release()
    monkeypatch.setattr(B, "MAX_BROADCAST_ROWS", 0)
    assert {r.id: r.owner for r in owner_root(rows, "path", roots).collect()} == want
    B.release()


def test_many_roots_in_one_root(spark):
    """No row grows with the children of a root, and rows are neither copied nor shuffled for their owner."""
    from tests.test_plans import formatted
    roots = spark.range(200_000).selectExpr("concat('/top/c', id) AS path").union(spark.createDataFrame([("/top",)], "path string"))
    rows = spark.createDataFrame([(1, "/top/c77/x"), (2, "/top/zz/c77/x"), (3, "/top/c200000"), (4, "/top"), (5, "/topper/c77"), (6, "/top/c199999")], "id long, path string")
    got = owner_root(rows, "path", roots)
    assert {r.id: r.owner for r in got.collect()} == {1: "/top/c77", 2: "/top", 3: "/top", 4: "/top", 6: "/top/c199999"}
    txt = formatted(got)
    assert txt.count("BroadcastHashJoin LeftOuter") >= 2 and "SortMergeJoin" not in txt and "Generate" not in txt
    assert not [t for t in measured_roots(roots)[0].dtypes if "array" in t[1]]


def test_roots_beyond_the_bound_shuffle_no_contents(spark, monkeypatch):
    """Fingerprints, owners and matches are the same, and no exchange has a content."""
    from seepage.operators import broadcast as B
    from tests.test_plans import formatted
    roots = spark.createDataFrame([("/r/a",), ("/r/a/deep",), ("/r/b",), ("/r/build",)], "path string")
    files = spark.createDataFrame([("/r/a/deep/.env", "TOK=lemon-kestrel-190283\nX=1\n"), ("/r/a/.git/.env", "TOK=never-seen-value-1\n"), ("/r/b/id_rsa", " key-material-55512 \n"),
                                   ("/r/build/.env", "TOK=also-never-seen-2\n"), ("/q/.env", "TOK=outside-of-roots-3\n"), ("/r/b/.env", "OWN=quince-tapir-4471\n")], "path string, content string")
    writes = spark.createDataFrame([(1, None, "/r/b/x", "say lemon-kestrel-190283", "write"), (2, None, "/r/a/y", "key-material-55512 quince-tapir-4471", "write"), (3, None, "/q/z", "lemon-kestrel-190283", "write"),
                                    (4, None, "/r/a/node_modules/y", "key-material-55512", "write"), (5, None, "/r/a/deep/w", "quince-tapir-4471 lemon-kestrel-190283", "write")],
                                   "write_id long, ts timestamp, path string, content string, kind string")
    procs = spark.createDataFrame([(11, 1, "/r/a/deep/src"), (12, 2, "/r/a"), (13, 3, "/r/b")], "pid long, ord long, cwd string")
    cols = ["worktree", "path", "ord", "field", "value_hash"]
    f1, e1 = sorted(map(str, fingerprints(files, roots).select(cols).collect())), sorted(map(str, api.leaks(writes, files, roots, procs).collect()))
    B.release()
    monkeypatch.setattr(B, "MAX_BROADCAST_ROWS", 0)
    fps, ev = fingerprints(files, roots).select(cols), api.leaks(writes, files, roots, procs)
    assert sorted(map(str, fps.collect())) == f1 and len(f1) == 6
    assert sorted(map(str, ev.collect())) == e1 and len(e1) == 6
    for df in (fps, ev):
        for part in formatted(df).split("\n\n"):
            if re.match(r"\(\d+\) Exchange", part.strip()):
                assert "content" not in part, part
    B.release()
