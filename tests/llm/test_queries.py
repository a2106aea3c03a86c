"""The registered queries: SQL parity, native plans, the pipeline's contract."""

import duckdb
import pytest

import corpus_pipeline
from seepage.llm import catalog, lines, mixing, rules
from seepage.llm.common import table
from tests.llm import cases

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_parity(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(catalog.oracle_sql()[name])
    assert sorted(d[0] for d in cur.description) == cols
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["op1_line_dedup", "op6_quality_rules", "op8_mixing", "op10_chat_format"])
def test_native_plans_run_no_python(spark, name, monkeypatch):
    seen = []
    for module in (lines, rules, mixing):
        write = module.written
        monkeypatch.setattr(module, "written", lambda df, n, write=write: seen.append(df) or write(df, n))
    seen.append(catalog.queries()[name](spark, SF))
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "ExternalRDD"))


def test_every_operator_has_one_query():
    assert all(isinstance(x, str) for x in catalog.oracle_sql().values()) and set(catalog.oracle_sql()) < set(catalog.queries())
    numbers = [int(k[2:].split("_")[0]) for k in catalog.queries()]
    assert numbers == list(range(1, len(numbers) + 1))


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "source_mixing", "token_output"]
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns
        if stage is corpus_pipeline.source_mixing:  # repeats rows, and loses none
            assert out.exceptAll(docs).join(docs, docs.columns, "left_anti").count() == 0 and docs.exceptAll(out).count() == 0
        else:
            assert out.exceptAll(docs).count() == 0
            sizes.append(out.count())
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    got = corpus_pipeline.token_output(spark, docs, SF).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)


def test_pipeline_stages_on_odd_rows(spark):
    d = cases.frame(spark, cases.with_null_id(cases.rows(6, 20)))
    for docs in (d, cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
            stage(spark, docs, SF).count()
        corpus_pipeline.token_output(spark, docs, SF).count()


def test_pipeline_against_its_parts(spark):
    """What run() returns is what the stages' operators say one after the other."""
    from seepage.llm import decontaminate, jaccard
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = table(spark, SF, "labels")
    a = rules.quality_filter(docs, labels).collect()
    b = spark.createDataFrame(a, docs.schema)
    keep = {r.component_id for r in jaccard.jaccard_classes(b).collect()}
    c = b.where(b.doc_id.isin(*keep))
    leak = {r.doc_id for r in decontaminate.leaks(c, table(spark, SF, "benchmark")).collect()}
    d = c.where(~c.doc_id.isin(*leak)) if leak else c
    want = sorted(r.doc_id for r in mixing.mix(d, labels, lowest=1.0, size=1.5).collect())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == want
