"""Operator 8, mixing sources to target weights with soft membership [native].

Labelled table: the rows of ``documents`` that ``labels`` covers; their domain is the source they
name. A naive Bayes classifier with add-one smoothing over binned statistics (language, length,
lines, non-ASCII and upper-case shares) gives every other document a posterior over domains; its
counts come from one aggregation. A labelled document belongs to its domain alone. Documents of
equal bins and equal label have equal posteriors, so they form cells (at most the product of the
bin counts times the domains and one, however many documents there are), which the fit works on.

Fit: projected gradient on the least squares of the expected totals. With w_c a cell's share of the
tokens, p_c its posterior and t(r) = sum_c w_c r_c p_c, rates lowest <= r <= cap minimise
|t(r) - size * target|^2 in the norm of (H + e)^-1, H = sum_c w_c p_c p_c', e a millionth of H's mean
eigenvalue: distances count as much as it costs to close them, so the step 1 is always short
enough and nearly equal posteriors do not slow the descent. Gradients are taken in the metric
weighted by tokens, with Nesterov's momentum, and each step is one aggregation of the cells
to 2 n sums for n domains; the iterates stay in the cells, which are written every ``BETWEEN``
steps. The fit ends when the gap (L1 distance of t(r) from size * target) is at most ``gap``, when the
last ten steps came less than a hundredth nearer than those before (what the bounds leave), or after
``steps``.
What remains is the result's ``gap``, with a warning if more than ``gap``. Targets default to the
tempered shares share^temper / sum.

``cap`` (4) bounds how often a document is repeated: data repeated up to about four times is known
to serve a model nearly as well as new data, and further repeats do not. ``lowest`` (0) bounds how
far a document can be thinned. ``copies`` is floor(rate), and one more with the rate's fraction as
probability, by a hash of id and text. ``mix`` returns each row as often as its copies say.

Defined results: null texts are empty texts of 0 tokens, null sources and languages are the empty
name; without labelled rows the domains of all documents train the classifier and no document is
of its domain alone; languages that no labelled row has are one unseen language; targets naming
unknown domains have nothing to act on; repeated rows are documents of their own; rows of a null
doc_id are unlabelled; empty table: no rows; further columns stay, whatever their names. Rates are
rounded to 6 digits.
"""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm.common import WORD_GAP, fresh, table, written

GAPS = " \t\n\x0b\f\r"
FEATURES = ("lang", "length", "lines", "non_ascii", "upper")
#: More domains, or more values of features in the labelled table, than this are an error: the driver holds a sum for each.
MAX_DOMAINS, MAX_VALUES = 1000, 10_000
#: Up to this many cells their rates are broadcast to the documents; beyond it the join shuffles.
MAX_BROADCAST_CELLS = 200_000
#: Up to this many labelled ids are broadcast to the documents; beyond it the join shuffles.
MAX_BROADCAST_IDS = 1_000_000
#: Steps between two writings of the cells with their iterates.
BETWEEN = 12


def _features(docs: DataFrame, name: str, domain: str = "source") -> DataFrame:
    """Adds a struct column: tokens, domain, the bins, and a number in [0, 1) from id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(GAPS))
    tokens = F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_GAP))).cast("bigint")
    chars = F.greatest(F.length(text), F.lit(1))
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    log2 = lambda c: F.floor(F.log2(c + F.lit(1))).cast("int")
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text), F.lit(1 << 30)) / float(1 << 30)
    return docs.withColumn(name, F.struct(
        tokens.alias("tokens"), F.coalesce(F.col(domain), F.lit("")).alias("domain"), u.alias("u"),
        lang.alias("lang"), log2(tokens).alias("length"),
        log2(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("lines"),
        F.floor((F.octet_length(text) - F.length(text)) * 20 / chars).cast("int").alias("non_ascii"),
        F.floor((F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) * 10 / chars).cast("int").alias("upper")))


def _labelled(d: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """The struct column with one more field: whether ``labels`` covers the row. Written, so
    that the texts are read once, whatever follows."""
    own = fresh(d, "labelled_id")
    ids = labels.select(F.col("doc_id").alias(own)).where(F.col(own).isNotNull()).distinct()
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    d = d.join(ids, d["doc_id"] == F.col(own), "left")
    return written(d.withColumn(name, F.col(name).withField("labelled", F.col(own).isNotNull())).drop(own), "mixing")


def _literal(value, kind: str) -> Column:
    """A nested constant: parsed once, as its argument is a literal."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"struct<v:{kind}>")["v"]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class Classifier:
    """Counts of the labelled table; ``posterior`` is the column expression."""

    def __init__(self, labelled: DataFrame):
        f = F.col("f")
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), f[k].cast("string").alias("v")) for i, k in enumerate(FEATURES)])).alias("x")
        counts = labelled.select(f["domain"].alias("domain"), pairs).groupBy("domain", "x.k", "x.v").count()
        n = counts.agg(F.count_distinct("domain").alias("d"), F.count_distinct(F.struct("k", "v")).alias("v")).first()
        if n.d > MAX_DOMAINS or n.v > MAX_VALUES:
            raise ValueError(f"{n.d} domains, at most {MAX_DOMAINS}; {n.v} values of features, at most {MAX_VALUES}")
        rows = counts.collect()
        self.domains = sorted({r.domain for r in rows})
        at = {d: i for i, d in enumerate(self.domains)}
        size = [0] * len(at)
        count: list[dict[str, list[int]]] = [{} for _ in FEATURES]
        for r in rows:
            count[r.k].setdefault(r.v, [0] * len(at))[at[r.domain]] += r["count"]
            size[at[r.domain]] += r["count"] if r.k == 0 else 0
        total = sum(size)
        self.langs = sorted(count[0])
        self.prior = [math.log((n + 1) / (total + len(at))) for n in size]
        self.logs = [{v: [math.log((n + 1) / (size[i] + len(c) + 1)) for i, n in enumerate(by)] for v, by in c.items()} for c in count]
        self.unseen = [[math.log(1 / (size[i] + len(c) + 1)) for i in range(len(at))] for c in count]

    def cell(self, f: Column, labelled: Column) -> Column:
        """What decides a row's posterior: places (from 1, 0 for none) of language and own domain, and the bins."""
        place = lambda names, x: F.coalesce(F.array_position(_literal(names, "array<string>"), x), F.lit(0))
        return F.struct(place(self.langs, f["lang"]).alias("lang"), *[f[k].alias(k) for k in FEATURES[1:]],
                        F.when(labelled, place(self.domains, f["domain"])).otherwise(F.lit(0)).alias("alone"))

    def posterior(self, cell: Column) -> Column:
        bins = {k: cell[k].cast("string") for k in FEATURES}
        bins["lang"] = F.try_element_at(_literal(["", *self.langs], "array<string>"), cell["lang"].cast("int") + 1)
        bins["lang"] = F.when(cell["lang"] > 0, bins["lang"])
        sums = _literal(self.prior, "array<double>")
        for k, logs, unseen in zip(FEATURES, self.logs, self.unseen):
            one = F.coalesce(F.try_element_at(_literal(logs, "map<string,array<double>>"), bins[k]), _literal(unseen, "array<double>"))
            sums = F.zip_with(sums, one, lambda a, b: a + b)
        def normal(s: Column) -> Column:
            e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
            return F.transform(F.array(e), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y)))[0]
        alone = F.transform(F.sequence(F.lit(1), F.lit(max(1, len(self.domains)))), lambda i: (i == cell["alone"]).cast("double"))
        return F.when(cell["alone"] > 0, alone).otherwise(F.transform(F.array(sums), normal)[0])


def fit(rows: DataFrame, name: str, targets: dict[str, float] | None = None, temper: float = 0.5, size: float = 1.0, lowest: float = 0.0,
        cap: float = 4.0, gap: float = 1e-3, steps: int = 60) -> tuple[DataFrame, Column, list[float], float]:
    """(cells: cell, tokens, posterior, rate; the column that names a row's cell; the gap before each
    step; the remaining gap) for rows with the struct column ``name`` of _labelled."""
    if not 0 <= lowest <= cap:
        raise ValueError("rates need 0 <= lowest <= cap")
    f = F.col(name)
    labelled = f["labelled"]
    known = Classifier(rows.where(labelled).select(f.alias("f")))
    if not known.domains:
        known, labelled = Classifier(rows.select(f.alias("f"))), F.lit(False)
    cell, n = known.cell(f, labelled), len(known.domains)
    cells = rows.select(cell.alias("cell"), f["tokens"].alias("tokens")).groupBy("cell").agg(F.sum("tokens").alias("tokens"))
    if not n:
        return cells.select("cell", "tokens", F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate")), cell, [], 0.0
    cells = written(cells.select("*", known.posterior(F.col("cell")).alias("posterior")), "cells")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    if targets is None:
        shares = rows.groupBy(f["domain"].alias("domain")).agg(F.sum(f["tokens"]).alias("t")).join(rows.sparkSession.createDataFrame([(d,) for d in known.domains], "domain string"), "domain", "left_semi")
        targets = {r.domain: (r.t / total) ** temper for r in shares.collect() if r.t}
    scale = sum(targets.get(d, 0.0) for d in known.domains) or 1.0
    aim = size * np.array([targets.get(d, 0.0) / scale for d in known.domains])
    cells, history = _descend(cells, aim, total, min(max(size, lowest), cap), lowest, cap, gap, steps)
    # One rate a cell: few rows, bounded by the product of the bins.
    cells = written(cells.select("cell", "tokens", "posterior", F.round("r", 6).alias("rate")), "rates")
    left = float(np.abs(_totals(cells, n, total, "rate")[0] - aim).sum())
    if left > gap:
        warnings.warn(f"expected totals stay {left:.4f} (L1) from the target weights; asked for {gap}")
    return cells, cell, history, left


def _totals(cells: DataFrame, n: int, total: float, *rates: str) -> list[np.ndarray]:
    """The expected totals at each rate column."""
    x = cells.agg(*[F.sum(F.col("tokens") / total * F.col(r) * F.col("posterior")[i]) for r in rates for i in range(n)]).first()
    return [np.array([v or 0.0 for v in x[k * n:(k + 1) * n]]) for k in range(len(rates))]


def _descend(cells: DataFrame, aim: np.ndarray, total: float, start: float, lowest: float, cap: float,
             gap: float, steps: int) -> tuple[DataFrame, list[float]]:
    """(cells with the fitted rates as column r, the gap before each step)."""
    n = len(aim)
    each = [F.sum(F.col("tokens") / total * F.col("p") * F.col("posterior")[j]) for j in range(n)]
    second = np.zeros((n, n))
    for x in cells.select("tokens", "posterior", F.posexplode("posterior").alias("i", "p")).groupBy("i").agg(*each).collect():
        second[x[0]] = [v or 0.0 for v in x[1:]]
    norm = np.linalg.inv(second + (1e-6 * np.trace(second) / n + 1e-30) * np.eye(n))
    kept = cells.withColumns({"r": F.lit(start), "y": F.lit(start)})
    now, moves, history = kept, [], []
    speed = 1.0
    for _ in range(steps):
        at_r, at_y = _totals(now, n, total, "r", "y")
        history.append(float(np.abs(at_r - aim).sum()))
        if history[-1] <= gap / 2 or (len(history) > 10 and min(history[-10:]) > 0.99 * min(history[:-10])):
            break
        if len(history) > 1 and history[-1] > history[-2]:
            speed = 1.0  # momentum that leads away starts again
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        moves.append([*(norm @ (at_y - aim)).tolist(), (speed - 1) / faster])
        speed = faster
        now = kept.withColumn("s", _moved(moves, n, lowest, cap)).withColumns({"r": F.col("s")["r"], "y": F.col("s")["y"]}).drop("s")
        if len(moves) == BETWEEN:
            kept, moves = written(now, "iterates"), []
            now = kept
    return now, history


def _moved(moves: list[list[float]], n: int, lowest: float, cap: float) -> Column:
    """(r, y) of a cell after the moves, each a direction of n numbers and a momentum:
    r' = y - posterior . direction within [lowest, cap]; y' = r' + momentum (r' - r)."""
    def step(s: Column, move: Column) -> Column:
        r = F.least(F.greatest(s["y"] - _dot(F.col("posterior"), F.slice(move, 1, n)), F.lit(float(lowest))), F.lit(float(cap)))
        return F.transform(F.array(r), lambda v: F.struct(v.alias("r"), (v + F.get(move, F.lit(n)) * (v - s["r"])).alias("y")))[0]
    return F.aggregate(_literal(moves, "array<array<double>>"), F.struct(F.col("r").alias("r"), F.col("y").alias("y")), step)


def _rated(d: DataFrame, name: str, **how) -> DataFrame:
    """d, of _labelled, with its struct column as tokens, domain, rate, copies, kept, gap."""
    own_cell, own_rate, at = (fresh(d, x) for x in ("fitted_cell", "fitted_rate", "mixing_cell"))
    cells, cell, _, left = fit(d, name, **how)
    rates = cells.select(F.col("cell").alias(own_cell), F.col("rate").alias(own_rate))
    if rates.count() <= MAX_BROADCAST_CELLS:
        rates = F.broadcast(rates)
    f, r = F.col(name), F.col(own_rate)
    out = d.withColumn(at, cell).join(rates, F.col(at) == F.col(own_cell), "left")
    copies = (F.floor(r) + (f["u"] < r - F.floor(r)).cast("int")).cast("int")
    return out.withColumn(name, F.struct(f["tokens"].alias("tokens"), f["domain"].alias("domain"), r.alias("rate"), copies.alias("copies"), (copies > 0).alias("kept"), F.lit(left).alias("gap"))).drop(at, own_cell, own_rate)


def with_rates(docs: DataFrame, labels: DataFrame, domain: str = "source", **how) -> DataFrame:
    """docs with one more struct column, the last: tokens, domain, rate, copies, kept, gap."""
    name = fresh(docs, "mixing_stats")
    return _rated(_labelled(_features(docs, name, domain), labels, name), name, **how)


def mix(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs, each row as often as its copies say. With ``lowest`` 1 no row is lost: ``size`` says how many
    times the tokens come out, and the copies above the first go where they bring the totals nearer."""
    d = with_rates(docs, labels, **how)
    name = d.columns[-1]
    every = F.explode(F.array_repeat(F.lit(1), F.col(name)["copies"])).alias(fresh(d, "copy"))
    return d.select(*[d[c] for c in docs.columns], every).drop(fresh(d, "copy"))


def shares(rated: DataFrame) -> DataFrame:
    """domain, n_tokens, n_out: the tokens that went in, and those of the copies that come out,
    by the domain that the rows name themselves."""
    m = F.col(rated.columns[-1])
    return rated.groupBy(m["domain"].alias("domain")).agg(F.sum(m["tokens"]).alias("n_tokens"), F.sum(m["tokens"] * m["copies"]).alias("n_out"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    d = _rated(_labelled(_features(docs, "mixing").drop("text"), table(spark, sf_dir, "labels"), "mixing"), "mixing")
    m = F.col("mixing")
    return d.select("doc_id", m["domain"].alias("domain"), m["tokens"].alias("n_tokens"), m["rate"].alias("rate"), m["copies"].alias("copies"), m["kept"].alias("kept"), m["gap"].alias("gap"))
