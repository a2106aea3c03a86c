"""Driver contract on sf0.001: entry() schema, and Spark vs DuckDB oracle on
the cheaper catalogue entries (the full gate runs in tools/check_oracle.py)."""

import duckdb

import __spark_entry__ as E
from seepage.plans.tables import TABLES
from tests.conftest import SF

CHEAP = ["worktrees_parse", "fingerprints", "classify_rules", "actor_per_root", "write_owner",
         "trigram_similarity", "leak_events", "severity_summary", "ranked_report", "map_nodes",
         "doc_fingerprints", "doc_exact_leaks"]


def test_entry_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["write_id", "timestamp", "source_worktree", "source_agent_pid", "source_path",
                          "secret_field", "target_worktree", "target_agent_pid", "target_path", "match_kind",
                          "severity"]
    assert df.count() > 0


def test_every_query_has_oracle_or_reason():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 30


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


def test_oracle_parity_sf0001(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in CHEAP:
        df = E.queries()[name](spark, SF)
        cur = con.execute(E.oracle_sql()[name])
        ocols = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(ocols), name
        assert _norm(df.collect(), df.columns) == _norm(cur.fetchall(), ocols), name
