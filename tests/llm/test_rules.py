import random
import re

from pyspark.sql import functions as F

from seepage.llm import rules
from tests.llm import cases


def brute(text):
    t = text or ""
    w = cases.WORD.findall(t)
    lines = [x for x in t.split("\n") if cases.WORD.search(x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i:i + 5]), []).append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def odd_texts():
    rng = random.Random(4)
    out = [" ".join(cases.words(rng, rng.randrange(0, 60), 3)) for _ in range(30)]
    out += ["a\nb\na\n\n a\na\r\n", "#*$%&|<> x", "x " * 50, "\n".join(["same line here"] * 5), "a b c d e " * 2 + "tail"]
    return out


def test_counts_against_brute_force(spark):
    pairs = cases.with_null_id(cases.rows(1, 20) + [(700 + i, t) for i, t in enumerate(odd_texts())])
    docs = cases.frame(spark, pairs)
    name = rules.fresh(docs, "quality_stats")
    got = rules.with_stats(docs, name)
    assert got.columns == [*docs.columns, name]
    s = F.col(name)
    rows = got.select("doc_id", *[s[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], rules.base_failed(s)).collect()
    want = [(d, *brute(t)) for d, t in pairs]
    assert sorted((tuple(r) for r in rows), key=str) == sorted(((*x, x[1] < 10 or 100 * x[5] > 20 * x[1]) for x in want), key=str)


def labelled(spark, n=400, noise=0.0):
    rng = random.Random(6)
    pairs, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 60))]
        kind = rng.random()
        if kind < 0.2:
            w = [x + "***" for x in w]
        elif kind < 0.3:
            w = [x.upper() + "!!" for x in w]
        pairs.append((i, " ".join(w)))
        labels.append((i, int((kind >= 0.3) ^ (rng.random() < noise)), 0))
    return cases.frame(spark, pairs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), {i for i, q, _ in labels if not q}


def test_learned_list_rejects_the_labelled_kind_only(spark):
    docs, labels, bad = labelled(spark)
    out = rules.quality_filter(docs, labels)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert len(kept & bad) <= 0.05 * len(bad) and len(kept) >= 400 - len(bad)


def test_rules_are_pruned_and_ordered(spark):
    docs, labels, bad = labelled(spark, noise=0.03)
    d = rules.with_stats(docs, "own")
    found = rules.learn(d.select("doc_id", F.col("own").alias("stats")), labels)
    assert found and all(1 <= len(r) <= 4 for r in found)
    gone = {r.doc_id for r in d.where(rules.verdict(F.col("own"), found).isNotNull()).collect()}
    assert len(gone & bad) >= 0.6 * len(bad) and len(gone - bad) <= 0.1 * len(gone)
    assert str(found[0][0]) in d.select(rules.verdict(F.col("own"), found).alias("v")).where("v IS NOT NULL AND v <> 'base'").groupBy("v").count().orderBy(F.desc("count")).first().v


def test_without_usable_labels_base_rules_decide(spark):
    docs = cases.frame(spark, cases.rows(2, 10))
    for labels in ([], [(1, None, 0)], [(1, 1, 0), (2, 1, 1), (2, 1, 1)]):
        kept = rules.quality_filter(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
        n = sum(not (x[0] < 10 or 100 * x[4] > 20 * x[0]) for x in (brute(t) for _, t in cases.rows(2, 10)))
        assert kept.count() == n


def test_empty(spark):
    assert rules.quality_filter(cases.empty(spark), spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int")).count() == 0


def test_filter_reads_written_statistics(spark):
    """No text function is left in the filter's plan: it would run for every window."""
    docs, labels, _ = labelled(spark, 60)
    plan = rules.quality_filter(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "split(" not in plan and "btrim(" not in plan and "lambda" not in plan
