"""Work that must not grow with ranges, or sit in one task, or be done twice."""

import random

from pyspark.sql import functions as F

from seepage.operators import rollups as R
from seepage.operators.fingerprint import content_text, fingerprints, spread
from seepage.operators.match import other_domain_counts
from tests.helpers import fps_df
from tests.test_plans import formatted


def test_place_is_the_number_of_cuts_not_above_the_key(spark):
    rnd = random.Random(4)
    for n in (1, 2, 7, 8, 33):
        cuts = sorted((rnd.randrange(20), rnd.choice("ab")) for _ in range(n - 1))
        rows = [(rnd.randrange(-1, 22), rnd.choice("ab")) for _ in range(60)]
        c = spark.createDataFrame([(cuts,)], "c array<struct<a:int,b:string>>")
        df = spark.createDataFrame(rows, "a int, b string").crossJoin(c)
        got = df.select("a", "b", R._place(F.struct("a", "b"), F.col("c"), n).alias("p")).collect()
        assert [r.p for r in got] == [sum(x <= (r.a, r.b) for x in cuts) for r in got] and len(got) == 60


def test_a_key_is_computed_once_a_row(spark):
    """The order's expressions are no part of what is done for each cut."""
    df = spark.range(50).select("id", F.concat(F.lit("k"), F.col("id")).alias("t"))
    out = R.number_rows(df, [F.sha2("t", 256)], "rn", 16)
    plan = formatted(out)
    assert "filter(" not in plan and "aggregate(" in plan
    want = [r.id for r in df.orderBy(F.sha2("t", 256)).collect()]
    assert [r.id for r in out.orderBy("rn").collect()] == want


def test_files_of_one_scan_are_dealt_over_the_tasks(spark):
    files = spark.createDataFrame([(f"/r/a/f{i}/.env", f"K{i}=value-{i:08d}") for i in range(200)] + [("/r/a/x.txt", "K=no"), (None, "K=no")],
                                  "path string, content string").coalesce(1)
    roots = spark.createDataFrame([("/r/a",)], "path string")
    assert spread(content_text(files)).select(F.spark_partition_id().alias("p")).distinct().count() >= 4
    got = fingerprints(files, roots).select("field", F.spark_partition_id().alias("p")).collect()
    assert len({r.field for r in got}) == len(got) == 200 and len({r.p for r in got}) >= 4


def test_counts_and_total_from_one_reading(spark):
    fps = fps_df(spark, [("a", "A", "12345678"), ("a", "B", "123456789"), ("b", "C", "short"), ("c", "D", "abcdefgh")])
    targets = spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "target_worktree string")
    out = other_domain_counts(targets, fps)
    assert "InMemoryTableScan" in formatted(out)
    assert {tuple(r) for r in out.collect()} == {("a", 1), ("b", 3), ("z", 3)}
    assert {tuple(r) for r in other_domain_counts(targets, fps.limit(0)).collect()} == {("a", 0), ("b", 0), ("z", 0)}
