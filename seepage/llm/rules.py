"""Operator 6, quality rules: base rules and a learned decision list [native].

Statistics of a text (null: empty) are built-in functions on its row. The decision
list is learned by sequential covering from labelled rows, of which Spark only returns
counts by (statistic, threshold bin):

* grow: from the rejected label's rows not yet covered, add the threshold condition
  (statistic >= t or < t, t from that statistic's fixed grid) with the best FOIL gain
  on the growing rows, until no accepted row is covered or nothing gains;
* prune: cut the conjunction to the prefix with the best (p - n) / (p + n) on the
  pruning rows (every third label by hash);
* keep the rule if its precision on the pruning rows reaches ``min_precision`` and it
  covers ``min_rows`` rejected ones there; remove what it covers and go on, else stop.

The rules become one ordered CASE expression; the first that holds rejects the text.

Defined results: null and empty texts have no words, so they fail the base rules; no
labels, null labels only, or labels of one kind: no learned rule, base rules alone decide;
repeated rows each get their own result, and repeated labels count as often as they occur;
empty table: no rows; further columns stay as they are, whatever their names. A text is
one row, so a very long text costs its own task n log n at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm.common import WORD_GAP, fresh, table, written

GAPS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHARE = (1, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900)
_COUNT = (1, 2, 3, 5, 8, 12, 20, 30, 50, 100, 200, 500, 1000, 2000, 5000, 10000)
#: Statistic: the grid its thresholds come from. Shares are per thousand.
GRIDS: dict[str, tuple[int, ...]] = {
    "n_words": _COUNT,
    "symbol_share": _SHARE,
    "repeat_share": _SHARE,
    "dup_line_share": _SHARE,
    "upper_share": _SHARE,
    "shout_share": _SHARE,
    "distinct_share": _SHARE,
    "digit_share": _SHARE,
    "line_words": (1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 50, 100),
    "word_length": (20, 25, 30, 35, 40, 45, 50, 55, 60, 70, 80, 100, 150),  # tenths of a character
}


@dataclass(frozen=True)
class Condition:
    stat: str
    at_least: bool
    value: int

    def column(self, stats: Column) -> Column:
        c = stats[self.stat]
        return c >= self.value if self.at_least else c < self.value

    def __str__(self) -> str:
        return f"{self.stat}{'>=' if self.at_least else '<'}{self.value}"


Rule = tuple[Condition, ...]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once: a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that are found twice or more. Hashes tell
    whether there are any; what counts then is the windows' words themselves."""
    last = F.size(words) - (WINDOW - 1)

    def exact(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("w"), i.alias("i")))
        def found(s: Column) -> Column:
            n = F.size(s)
            def twice(e: Column, k: Column) -> Column:
                return ((k > 0) & (e["w"] == F.get(s, k - 1)["w"])) | ((k < n - 1) & (e["w"] == F.get(s, k + 1)["w"]))
            at = F.sort_array(F.transform(F.filter(s, twice), lambda e: e["i"]))
            return _let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))
        return _let(F.sort_array(windows), found)

    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    def counted(h: Column) -> Column:
        return _let(hashed(h), lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(exact(words)))

    return F.when(last < 2, F.lit(0)).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), counted))


def _per_mille(part: Column, whole: Column) -> Column:
    return F.coalesce((part * 1000 / F.nullif(whole, F.lit(0))), F.lit(0.0))


def with_stats(docs: DataFrame, name: str) -> DataFrame:
    """Adds one struct column ``name`` with the contract's counts and the learner's statistics."""
    text, words, lines, counts = (fresh(docs, f"{name}_{x}") for x in ("text", "words", "lines", "counts"))
    t = F.col(text)
    d = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    trimmed = F.btrim(t, F.lit(GAPS))
    d = d.withColumn(words, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP)))
    d = d.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(GAPS)) != ""))
    w, ln = F.col(words), F.col(lines)
    d = d.withColumn(counts, F.struct(
        F.size(w).cast("bigint").alias("n_words"), _without(t, GAPS).cast("bigint").alias("word_chars"),
        (F.length(t) - _without(t, SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("bigint").alias("n_dup_lines"),
        _repeated_words(w).cast("bigint").alias("n_repeat_words"), F.size(ln).cast("bigint").alias("n_lines"),
        F.size(F.array_distinct(w)).alias("n_distinct"), (F.length(t) - _without(t, _UPPER)).alias("n_upper"),
        (F.length(t) - _without(t, "!?")).alias("n_shout"), (F.length(t) - _without(t, "0123456789")).alias("n_digits")))
    c = F.col(counts)
    d = d.withColumn(name, F.struct(
        *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        _per_mille(c["n_symbols"], c["word_chars"]).alias("symbol_share"), _per_mille(c["n_repeat_words"], c["n_words"]).alias("repeat_share"),
        _per_mille(c["n_dup_lines"], c["n_lines"]).alias("dup_line_share"), _per_mille(c["n_upper"], c["word_chars"]).alias("upper_share"),
        _per_mille(c["n_shout"], c["word_chars"]).alias("shout_share"), _per_mille(c["n_distinct"], c["n_words"]).alias("distinct_share"),
        _per_mille(c["n_digits"], c["word_chars"]).alias("digit_share"),
        F.coalesce(c["n_words"] / F.nullif(c["n_lines"], F.lit(0)), F.lit(0.0)).alias("line_words"),
        F.coalesce(c["word_chars"] * 10 / F.nullif(c["n_words"], F.lit(0)), F.lit(0.0)).alias("word_length")))
    return d.drop(text, words, lines, counts)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (stats["n_repeat_words"] * 100 > stats["n_words"] * 20)


def _covers(rule: Rule, stats: Column) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(stats)
    return out


def _foil(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(stats: DataFrame, labels: DataFrame, min_precision: float = 0.9, min_rows: int = 5,
          max_rules: int = 8, max_conditions: int = 4) -> list[Rule]:
    """The decision list from stats (doc_id, stats) and labels (doc_id, quality; 0 rejects)."""
    s, names = F.col("stats"), list(GRIDS)
    rows = stats.where(~base_failed(s)).join(labels.select("doc_id", "quality").where("quality IS NOT NULL"), "doc_id")
    # A statistic's bin b means: exactly b of its thresholds are reached. All that the learner reads are counts of equal bin vectors.
    def bin_of(k: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in GRIDS[k]]), lambda x: x <= s[k])).alias(k)
    bins = [bin_of(k) for k in names]
    cells = rows.select(*bins, (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"))
    cells = written(cells.groupBy(*names, "bad", "prune").count(), "quality-cells")

    def of(c: Condition) -> Column:  # the same condition on bins
        reached = F.col(c.stat) >= GRIDS[c.stat].index(c.value) + 1
        return reached if c.at_least else ~reached

    def where(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & of(c)
        return out

    def left(done: list[Rule], prune: bool) -> DataFrame:
        out = cells.where(F.col("prune") == prune)
        for r in done:
            out = out.where(~where(r))
        return out

    bad, good = F.sum(F.when(F.col("bad"), F.col("count")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("count"))).alias("n")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_conditions:
            pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(k).alias("b")) for i, k in enumerate(names)])).alias("x")
            got = left(rules, False).where(where(rule)).select(pairs, "bad", "count").groupBy("x.k", "x.b").agg(bad, good).collect()
            by: dict[int, dict[int, tuple[int, int]]] = {}
            for r in got:
                by.setdefault(r.k, {})[r.b] = (r.p, r.n)
            p0, n0 = (sum(v[i] for v in by.get(0, {}).values()) for i in (0, 1))
            if not p0 or not n0:
                break
            best: tuple[float, Condition | None] = (1e-9, None)
            for i, k in enumerate(names):
                for j, value in enumerate(GRIDS[k]):
                    p, n = (sum(v[m] for b, v in by.get(i, {}).items() if b > j) for m in (0, 1))
                    for at_least, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
                        gain = _foil(pp, nn, p0, n0)
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(k, at_least, value))
            if best[1] is None:
                break
            rule += (best[1],)
        if not rule:
            break
        sums = [x for i in range(1, len(rule) + 1) for x in (F.sum(F.when(F.col("bad") & where(rule[:i]), F.col("count")).otherwise(0)).alias(f"p{i}"), F.sum(F.when(~F.col("bad") & where(rule[:i]), F.col("count")).otherwise(0)).alias(f"n{i}"))]
        got = left(rules, True).agg(*sums).first()
        worth = [((got[f"p{i}"] or 0), (got[f"n{i}"] or 0)) for i in range(1, len(rule) + 1)]
        keep = max(range(len(rule)), key=lambda i: ((worth[i][0] - worth[i][1]) / max(1, sum(worth[i])), worth[i][0], -i))
        p, n = worth[keep]
        if p < min_rows or p < min_precision * (p + n):
            break
        rules.append(rule[:keep + 1])
    return rules


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null."""
    out = F.when(base_failed(stats), F.lit("base"))
    for r in rules:
        out = out.when(_covers(r, stats), F.lit(" and ".join(map(str, r))))
    return out


def quality_filter(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without those that the base rules or the learned list reject. The statistics are
    written with their rows first: a filter on them as expressions would be moved below the
    projections, and split the whole text again for every window of it."""
    name = fresh(docs, "quality_stats")
    d = written(with_stats(docs, name), "quality-rows")
    rules = learn(d.select("doc_id", F.col(name).alias("stats")), labels, **how)
    return d.where(verdict(F.col(name), rules).isNull()).drop(name)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(with_stats(docs, "stats").select("doc_id", "stats"), "quality-stats")
    rule = verdict(F.col("stats"), learn(stats, table(spark, sf_dir, "labels")))
    return stats.select("doc_id", *[f"stats.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                        base_failed(F.col("stats")).alias("base_failed"), rule.isNull().alias("kept"), rule.alias("rule"))
