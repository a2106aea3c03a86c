import os
import tempfile

from pyspark.sql import functions as F

from seepage.operators import rollups as R
from seepage.operators.fingerprint import as_match_side, fingerprints
from seepage.operators.match import event_columns, leak_matches
from seepage.plans.jobs import owned_writes
from seepage.streaming.leak_stream import run_leak_stream
from seepage.sources.trail import read_leak_events

TRAIL = "trail_pos long, timestamp timestamp, source_worktree string, source_agent_pid long, source_path string, " \
        "secret_field string, target_worktree string, target_agent_pid long, target_path string, " \
        "match_kind string, severity string"


def trail(spark, rows):
    full = [(i, None, s, 0, s + "/.env", f, t, 0, t + "/x", k, sev) for i, (s, t, f, k, sev) in enumerate(rows)]
    return spark.createDataFrame(full, TRAIL)


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("k"))
    got = R.number_rows(df, ["k"], "rn", partitions=7).select("k", "rn").collect()
    assert sorted((r.rn, r.k) for r in got) == [(i + 1, i) for i in range(5000)]


def test_ranked_report_stable_by_severity(spark):
    t = trail(spark, [("/r/a", "/r/b", "F1", "exact", "state"), ("/r/a", "/r/c", "F2", "exact", "secret"),
                      ("/r/b", "/r/c", "F3", "fuzzy", "config"), ("/r/c", "/r/a", "F4", "exact", "secret")])
    got = [(r.rn, r.field) for r in R.ranked_report(t).orderBy("rn").collect()]
    assert got == [(1, "F2"), (2, "F4"), (3, "F3"), (4, "F1")]
    row = R.ranked_report(t).where("rn = 1").first()
    assert row.row_text == "| 1 | r/a | r/c | F2 | exact | secret |"
    s = R.report_sentence(t).first()
    assert (s.total, s.secrets) == (4, 2) and s.sentence.startswith("Detected 4 cross-worktree leak event(s); 2 at")


def test_map_nodes_order(spark):
    roots = spark.createDataFrame([("/r/b",), ("/r/a",)], "path string")
    t = trail(spark, [("/x/s1", "/r/a", "F", "exact", "secret"), ("/r/b", "/x/t1", "F", "exact", "secret"),
                      ("/x/t1", "/x/s0", "F", "exact", "secret")])
    got = [(r.pos, r.path) for r in R.map_nodes(roots, t).orderBy("pos").collect()]
    assert got == [(1, "/r/a"), (2, "/r/b"), (3, "/x/s1"), (4, "/x/t1"), (5, "/x/s0")]


def test_stream_matches_batch(spark):
    roots = spark.createDataFrame([("/r/a",), ("/r/b",)], "path string")
    files = spark.createDataFrame([("/r/a/.env", "DB_TOKEN=super-secret-token-1234567890\n")], "path string, content string")
    fps = fingerprints(files, roots)
    actors = spark.createDataFrame([("/r/a", 0), ("/r/b", 4242)], "worktree string, agent_pid long")
    rows = [(i, None, f"/r/b/f{i}.txt", "x super-secret-token-1234567890 y" if i % 2 else "nothing here", "write")
            for i in range(20)]
    writes = spark.createDataFrame(rows, "write_id long, ts timestamp_ntz, path string, content string, kind string")
    batch = event_columns(leak_matches(owned_writes(writes, roots, actors), as_match_side(fps)))
    d = tempfile.mkdtemp(prefix="seepage-stream-")
    writes.repartition(3).write.parquet(os.path.join(d, "log"))
    q = run_leak_stream(spark, os.path.join(d, "log"), fps, roots, actors, os.path.join(d, "trail"),
                        os.path.join(d, "ckpt"))
    q.awaitTermination()
    streamed = read_leak_events(spark, os.path.join(d, "trail"))
    key = lambda r: (r.target_path, r.source_path, r.match_kind, r.target_agent_pid)
    assert sorted(map(key, streamed.collect())) == sorted(map(key, batch.collect()))
    assert streamed.count() == 10


def test_stream_releases_what_a_batch_keeps(spark):
    from seepage.operators import broadcast as B
    roots = spark.createDataFrame([("/r/a",), ("/r/b",)], "path string")
    files = spark.createDataFrame([("/r/a/.env", "DB_TOKEN=super-secret-token-1234567890\n")], "path string, content string")
    actors = spark.createDataFrame([("/r/a", 0), ("/r/b", 4242)], "worktree string, agent_pid long")
    d = tempfile.mkdtemp(prefix="seepage-stream-")
    for i in range(5):
        rows = [(i, None, f"/r/b/f{i}.txt", "x super-secret-token-1234567890 y", "write" if i % 2 == 0 else "remove")]
        spark.createDataFrame(rows, "write_id long, ts timestamp_ntz, path string, content string, kind string").coalesce(1).write.mode("append").parquet(os.path.join(d, "log"))
    B.release()
    held = []
    from seepage.streaming import leak_stream as L
    real = L.append_leak_events

    def counted(ev, path, batch=None):
        real(ev, path, batch)
        held.append(spark.sparkContext._jsc.getPersistentRDDs().size())

    L.append_leak_events = counted
    try:
        q = run_leak_stream(spark, os.path.join(d, "log"), fingerprints(files, roots), roots, actors, os.path.join(d, "trail"),
                            os.path.join(d, "ckpt"), max_files_per_trigger=1)
        q.awaitTermination()
    finally:
        L.append_leak_events = real
    assert len(held) == 5 and len(set(held)) == 1
    assert read_leak_events(spark, os.path.join(d, "trail")).count() == 3
    B.release()


def test_watch_over_a_growing_tree(spark):
    """Files that are there, come and change, each once; what the batch job says of the same contents."""
    import time

    from seepage.sources.tree_stream import written_files
    base = tempfile.mkdtemp(prefix="seepage-watch-")
    put = lambda rel, text: (os.makedirs(os.path.dirname(f"{base}/{rel}"), exist_ok=True), open(f"{base}/{rel}", "w").write(text))
    put("a/.env", "TOK=saffron-ibis-66120\n")
    put("b/.env", "KEY_B=umber-lynx-80417\n")
    put("b/node_modules/x.txt", "saffron-ibis-66120")
    put("b/one.txt", "saffron-ibis-66120")
    put("a/deep/two.txt", "nothing")
    roots = spark.createDataFrame([(f"{base}/{r}",) for r in ("a", "b", "a/deep")], "path string")
    files = spark.createDataFrame([(f"{base}/a/.env", "TOK=saffron-ibis-66120\n"), (f"{base}/b/.env", "KEY_B=umber-lynx-80417\n")], "path string, content string")
    fps, actors = fingerprints(files, roots), spark.createDataFrame([(f"{base}/b", 5)], "worktree string, agent_pid long")

    def run():
        stream = written_files(spark, [f"{base}/a", f"{base}/b"], since_ns=0, settle_ms=0, splits=3)
        run_leak_stream(spark, stream, fps, roots, actors, f"{base}/trail", f"{base}/ckpt").awaitTermination()
        return sorted((os.path.relpath(r.target_path, base), r.secret_field, r.target_agent_pid) for r in read_leak_events(spark, f"{base}/trail").collect())

    first = run()
    assert first == [("b/one.txt", "TOK", 5)]
    assert run() == first  # nothing was written meanwhile
    time.sleep(0.05)
    put("a/deep/two.txt", "umber-lynx-80417 saffron-ibis-66120")
    put("b/new/three.txt", "see saffron-ibis-66120")
    put("b/one.txt", "saffron-ibis-66120 again")
    assert run() == sorted(first + [("a/deep/two.txt", "KEY_B", 0), ("a/deep/two.txt", "TOK", 0), ("b/new/three.txt", "TOK", 5), ("b/one.txt", "TOK", 5)])


def test_numbering_keeps_no_wide_rows(spark):
    """Positions in order, ties and one key that most rows share included; nothing wide is checkpointed."""
    from tests.test_plans import formatted
    rows = [(None if i % 50 == 0 else (7 if i % 3 else i % 11), f"t{i % 40}", "wide " * 20) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, t string, row_text string")
    got = R.number_rows(df, ["k", F.col("t")], "rn", partitions=9)
    assert got.columns == ["k", "t", "row_text", "rn"]
    found = sorted((r.rn, r.k, r.t) for r in got.collect())
    assert [x[0] for x in found] == list(range(1, 3001))
    assert [x[1:] for x in found] == sorted(((k, t) for k, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    txt = formatted(got)
    assert "row_text" not in "".join(p for p in txt.split("\n\n") if "Scan ExistingRDD" in p and "checkpoint" in p.lower())
    assert R.number_rows(df.where("k > 99"), ["k"], "rn").count() == 0


def test_a_hot_key_is_cut_into_ranges(spark):
    df = spark.range(4000).selectExpr("CAST(1 AS INT) AS k", "id")
    got = R.number_rows(df, ["k"], "rn", partitions=8)
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert sorted(r.rn for r in got.collect()) == list(range(1, 4001)) and "Exchange hashpartitioning(_part" in got._jdf.queryExecution().executedPlan().toString()
    assert len(sizes) > 1 or spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
