"""Scale properties of the physical plans, guarded against regressions."""

import contextlib
import io
import re

import __spark_entry__ as E
from seepage.plans import catalog
from tests.conftest import SF

SKIP = {"leak_stream", "trail_round_trip", "report_from_trail"}  # these run their own write/stream jobs


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_no_pairwise_joins_anywhere(spark):
    for name, fn in catalog.queries().items():
        if name in SKIP:
            continue
        txt = formatted(fn(spark, SF))
        assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", txt), name


def test_documents_scan_is_pruned(spark):
    txt = formatted(E.queries()["doc_leak_events"](spark, SF))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", txt))
    assert schemas and all(set(s.split(",")) <= {"doc_id:bigint", "text:string", "source:string"} for s in schemas)


def test_contents_are_never_shuffled_or_kept(spark):
    """Contents stay in the scan's stage: no exchange and no kept relation has them."""
    for name in ("leak_events", "exact_leaks", "fuzzy_leaks", "doc_leak_events"):
        for part in formatted(E.queries()[name](spark, SF)).split("\n\n"):
            if re.match(r"\(\d+\) (Exchange|InMemoryRelation|InMemoryTableScan|Sort\b)", part.strip()):
                assert "content_bin" not in part and "text#" not in part, (name, part)
