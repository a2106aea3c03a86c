import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from seepage import api
from seepage.functions.constants import EVENT_KEYS
from seepage.operators import rollups as R
from seepage.operators.fingerprint import fingerprints_from_tree
from seepage.sources.files import read_files
from seepage.sources.trail import append_leak_events, read_leak_events
from seepage.sources.worktrees import worktrees_from_listing


def parse(spark, text):
    df = spark.createDataFrame([(1, text)], "listing_id long, text string")
    return sorted(worktrees_from_listing(df).collect(), key=lambda r: r.path)


def test_porcelain_three_blocks(spark):
    text = ("worktree /repo\nHEAD 0000000000000000000000000000000000000000\nbranch refs/heads/main\n\n"
            "worktree /repo-wt-b\nHEAD 1111111111111111111111111111111111111111\nbranch refs/heads/feature/b\n\n"
            "worktree /repo-wt-c\nHEAD 2222222222222222222222222222222222222222\ndetached\n\n")
    got = parse(spark, text)
    assert [r.path for r in got] == ["/repo", "/repo-wt-b", "/repo-wt-c"]
    assert [r.branch for r in got] == ["refs/heads/main", "refs/heads/feature/b", ""]
    assert got[0].head == "0" * 40


def test_porcelain_unterminated_and_bare(spark):
    assert [(r.path, r.branch) for r in parse(spark, "worktree /repo\nHEAD abc\nbranch refs/heads/main")] == [
        ("/repo", "refs/heads/main")]
    got = parse(spark, "worktree /repo\nbare\n")
    assert len(got) == 1 and got[0].bare


def test_trail_round_trip_and_missing(spark):
    d = tempfile.mkdtemp(prefix="seepage-trail-")
    rows = [("2026-08-06 01:00:00", "/r/wt-a", 0, "/r/wt-a/.env", "DB_TOKEN", "/r/wt-b", 0,
             "/r/wt-b/src/config.txt", "exact", "secret"),
            ("2026-08-06 01:01:00.5", "/r/wt-a", 0, "/r/wt-a/.env", "DB_TOKEN", "/r/wt-b", 7,
             "/r/wt-b/x.txt", "fuzzy", "secret")]
    ev = spark.createDataFrame(rows, ", ".join(f"{k} {'long' if 'pid' in k else 'string'}" for k in EVENT_KEYS))
    ev = ev.withColumn("timestamp", F.to_timestamp("timestamp"))
    append_leak_events(ev, os.path.join(d, "trail"))
    back = sorted(read_leak_events(spark, os.path.join(d, "trail")).collect(), key=lambda r: r.timestamp)
    assert [r.timestamp for r in back] == ["2026-08-06T01:00:00Z", "2026-08-06T01:01:00.5Z"]
    assert [r.target_agent_pid for r in back] == [0, 7]
    with pytest.warns(UserWarning, match="no audit trail found"):
        none = read_leak_events(spark, os.path.join(d, "absent"))
    assert none.count() == 0
    roots = spark.createDataFrame([("/r/wt-a",), ("/r/wt-z",)], "path string")
    head = api.report(none, roots)["header"].first()
    assert (head.n_events, head.n_worktrees) == (0, 2) and head.notice.startswith("No cross-worktree leaks")
    head = api.report(read_leak_events(spark, os.path.join(d, "trail")), roots)["header"].first()
    assert (head.n_events, head.n_worktrees, head.notice) == (2, 3, None)


def test_secret_tree_source(spark):
    root = tempfile.mkdtemp(prefix="seepage-tree-")
    os.makedirs(os.path.join(root, "sub", ".git"))
    os.makedirs(os.path.join(root, "node_modules"))
    files = {".env": "DB_TOKEN=super-secret-token-1234567890\nDEBUG=true\n",
             "_u.env": "A_KEY=abcdefghijklmnopqrstuvwxyz012345\n", "sub/x.key": "KEYDATA\n",
             "sub/.git/config.env": "LEAK=xxxxxxxxxxxx\n", "node_modules/.env": "B=1\n", "sub/readme.md": "no"}
    for rel, text in files.items():
        with open(os.path.join(root, rel), "w") as fh:
            fh.write(text)
    rows = read_files(spark, [root])
    assert api.scan(rows, spark.createDataFrame([(root,)], "path string"))["totals"].first().n_fingerprints == 4
    assert sorted(os.path.relpath(r.path, root) for r in rows.collect()) == [".env", "_u.env", "sub/x.key"]
    fps = fingerprints_from_tree(rows).collect()
    assert sorted(r.field for r in fps) == ["A_KEY", "DB_TOKEN", "DEBUG", "x.key"]


def test_tree_source_roots_with_commas_nested_and_deep(spark):
    base = tempfile.mkdtemp(prefix="seepage-tree-")
    root = os.path.join(base, "b,c")
    deep = os.path.join(root, *[f"d{i}" for i in range(12)])
    os.makedirs(deep)
    for d in (root, deep, os.path.dirname(deep)):
        with open(os.path.join(d, ".env"), "w") as fh:
            fh.write("A_TOKEN=abcdefghijkl\n")
    inner = os.path.join(root, "d0")
    for splits in ("1", "3", "64"):
        from seepage.sources.files import SecretTreeSource
        spark.dataSource.register(SecretTreeSource)
        df = spark.read.format("secret_tree").option("roots", json.dumps([root, inner])).option("splits", splits).load()
        got = sorted((r.worktree, os.path.relpath(r.path, base)) for r in df.collect())
        files = [os.path.relpath(os.path.join(d, ".env"), base) for d in (root, deep, os.path.dirname(deep))]
        assert got == sorted([(root, f) for f in files] + [(inner, f) for f in files[1:]])


def test_flat_directory_in_many_tasks(spark, monkeypatch):
    """Pieces by the hash of names; the driver reads a bounded number of names, also of a wide level."""
    from pyspark import TaskContext

    from seepage.sources.files import SecretTreeReader
    root = tempfile.mkdtemp(prefix="seepage-flat-")
    for i in range(3000):
        open(os.path.join(root, f"s{i}.env" if i % 3 else f"n{i}.txt"), "w").write(f"A_TOKEN=value-{i:08d}\n")
    for i in range(200):
        os.makedirs(os.path.join(root, f"d{i}"))
        open(os.path.join(root, f"d{i}", ".env"), "w").write("B_TOKEN=abcdefghijkl\n")
    rows = read_files(spark, [root], splits=16)
    want = {os.path.join(root, f"s{i}.env") for i in range(3000) if i % 3} | {os.path.join(root, f"d{i}", ".env") for i in range(200)}
    got = [r.path for r in rows.collect()]
    assert len(got) == len(want) and set(got) == want
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 3 * len(want) / 16
    seen = []
    reader = SecretTreeReader({"roots": json.dumps([root]), "splits": "16"})
    some = reader._some
    monkeypatch.setattr(reader, "_some", lambda d: seen.append(some(d)) or seen[-1])
    assert len(reader.partitions()) <= 2 * 16 and sum(map(len, seen)) <= 16 * 17


def events(spark, *fields):
    rows = [("2026-01-01 00:00:00", "/r/a", 0, "/r/a/.env", f, "/r/b", 0, "/r/b/x", "exact", "secret") for f in fields]
    ev = spark.createDataFrame(rows, ", ".join(f"{k} {'long' if 'pid' in k else 'string'}" for k in EVENT_KEYS))
    return ev.withColumn("timestamp", F.to_timestamp("timestamp"))


def fields_of(spark, path):
    return sorted(r.secret_field for r in read_leak_events(spark, path).collect())


def test_a_batch_is_there_as_a_whole_or_not_at_all(spark):
    """A batch that fails half-way leaves the trail as it was; its attempt's files are not read."""
    path = os.path.join(tempfile.mkdtemp(prefix="seepage-trail-"), "trail")
    append_leak_events(events(spark, "ONE", "TWO"), path)
    before = read_leak_events(spark, path)
    bad = events(spark, *[f"F{i}" for i in range(40)]).repartition(8)
    bad = bad.withColumn("secret_field", F.when(F.col("secret_field") == "F7", F.raise_error(F.lit("lost"))).otherwise(F.col("secret_field")))
    with pytest.raises(Exception, match="lost"):
        append_leak_events(bad, path, "batch-1")
    # an attempt whose driver died before the rename: part files, and a manifest under a hidden name
    half = os.path.join(path, "parts", "half")
    events(spark, "HALF").selectExpr(*EVENT_KEYS).write.json(half)
    open(os.path.join(path, "_manifest", ".batch-1.x"), "w").write("parts/half")
    assert fields_of(spark, path) == ["ONE", "TWO"] and before.count() == 2
    append_leak_events(events(spark, "THREE"), path, "batch-1")
    assert fields_of(spark, path) == ["ONE", "THREE", "TWO"]


def test_a_batch_written_again_replaces_itself(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="seepage-trail-"), "trail")
    append_leak_events(events(spark, "A", "B"), path, "batch-0")
    append_leak_events(events(spark, "C"), path, "batch-1")
    append_leak_events(events(spark, "A2"), path, "batch-0")
    assert fields_of(spark, path) == ["A2", "C"]


def test_plain_json_lines_are_a_trail(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="seepage-trail-"), "trail.jsonl")
    with open(path, "w") as fh:
        fh.write('{"secret_field": "K", "target_agent_pid": 5}\n\n{"secret_field": "L"}\n')
    assert fields_of(spark, path) == ["K", "L"]


def test_a_read_trail_is_ordered_by_time(spark):
    """Trailing zeros are dropped in the text, so the text order is another one."""
    path = os.path.join(tempfile.mkdtemp(prefix="seepage-trail-"), "trail")
    rows = [(ts, "/r/a", 0, "/r/a/.env", f, "/r/b", 0, "/r/b/x", "exact", "secret")
            for ts, f in (("2026-01-01 00:00:00.5", "second"), ("2026-01-01 00:00:00", "first"), ("2026-01-01 00:00:01.25", "third"))]
    ev = spark.createDataFrame(rows, ", ".join(f"{k} {'long' if 'pid' in k else 'string'}" for k in EVENT_KEYS))
    append_leak_events(ev.withColumn("timestamp", F.to_timestamp("timestamp")), path)
    back = read_leak_events(spark, path)
    assert [r.field for r in api.report(back)["ranked"].orderBy("rn").collect()] == ["first", "second", "third"]
    roots = spark.createDataFrame([("/r/b",)], "path string")
    m = api.trail_map(roots, back)
    assert [r.edge_text.split("   ")[1] for r in m["edges"].orderBy("trail_pos").collect()] == ["first=secret", "second=secret", "third=secret"]
    assert [(r.pos, r.path) for r in m["nodes"].orderBy("pos").collect()] == [(1, "/r/b"), (2, "/r/a")]
    assert [r.summary[:22] for r in R.event_summary(back).orderBy("trail_pos").collect()] == ["[2026-01-01T00:00:00Z]"] * 2 + ["[2026-01-01T00:00:01Z]"]
