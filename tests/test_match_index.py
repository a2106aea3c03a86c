"""Matching with the scan's index and without: same results; copies of a content are tested once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seepage.operators import broadcast as B
from seepage.operators import gramscan, match
from seepage.operators.match import candidates, leak_matches, probe_tables
from tests.helpers import fps_df, writes_df
from tests.test_match import got_of, random_case, want_of


@pytest.mark.parametrize("index_row", [32, 1 << 40])
@pytest.mark.parametrize("hits", [1 << 20, 3])
def test_parity_with_brute_force(spark, monkeypatch, index_row, hits):
    monkeypatch.setattr(match, "_INDEX_ROW", index_row)
    monkeypatch.setattr(gramscan, "_HITS", hits)
    monkeypatch.setattr(gramscan, "_SEGMENT", 40)  # windows lie across segments
    fps, writes = random_case(11, 25, 50, alpha="abc01", top=50)
    fps += [("wt-0", "R", "abcabcabcabc"), ("wt-1", "Z", "zzzzzzzzz"), ("wt-1", "N", "8 bytes!")]
    writes += [(80, "bcabcabcabca" * 9, "b", "p", 0), (81, "zzz", "b", "p", 0), (82, "0" * 95 + fps[0][2][:-1] + "Q" + "0" * 70, "b", "p", 0)]
    want = want_of(fps, writes)
    assert got_of(spark, fps, writes) == want and {k for _, _, k in want} == {"exact", "fuzzy"}


def test_candidates_do_not_grow_with_contents_times_values(spark):
    """Values that share one common trigram with a content are no rows outside the scan."""
    fps = fps_df(spark, [("a", f"F{i}", f"{i * 7919 % 10**9:09d}-{i * 104729 % 10**9:09d}") for i in range(400)])
    writes = writes_df(spark, [(i, f"{i * 6007 % 10**9:09d} {i * 15485863 % 10**9:09d}", "b", "p", 0) for i in range(200)])
    probes = probe_tables(fps, ("fuzzy",))
    contents = writes.select(F.unhex(F.sha2("content_bin", 256)).alias("_ch"), F.col("write_id").alias("_rep"), "content_bin")
    with_index = gramscan.scan(contents, probes.filters, probes.kinds, probes.index).count()
    joined = gramscan.scan(contents, probes.filters, probes.kinds).join(probes.probe.select("key"), "key").count()
    assert with_index == candidates(contents, probes).count() < joined / 5


def test_copies_of_a_content_are_tested_once(spark, monkeypatch):
    tested = spark.sparkContext.accumulator(0)
    test = match.fuzzy_window_udf.func

    @F.pandas_udf("boolean")
    def counted(content, value, lo, hi):
        tested.add(int(np.sum([c is not None for c in content])))
        return test(content, value, lo, hi)

    monkeypatch.setattr(match, "fuzzy_window_udf", counted)
    value = "mauve/otter:7731-quartz~lantern"
    rows = [(None if i in (7, 17) else i, f"= {value[:-1]}#", "b", f"p{i}", 0) for i in range(40)]
    m = leak_matches(writes_df(spark, rows), fps_df(spark, [("a", "K", value)])).collect()
    # one of each write_id, as before; None is one
    assert sorted(r.write_id for r in m if r.write_id is not None) == [i for i in range(40) if i not in (7, 17)] and len(m) == 39
    assert {r.match_kind for r in m} == {"fuzzy"} and tested.value == 1
