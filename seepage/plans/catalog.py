"""Query catalogue: name -> Spark query (spark, sf_dir) -> DataFrame, and the
DuckDB oracle SQL for the same name. No query outputs a raw value or content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seepage.functions import columns as C
from seepage.functions import constants as K
from seepage.operators import rollups as R
from seepage.operators.broadcast import hold
from seepage.operators.fingerprint import (as_match_side, blob_entries, content_text, env_entries,
                                           fingerprints, promote_unknown, secret_files)
from seepage.operators.match import other_domain_counts
from seepage.operators.promote import LinearScorer, promoter
from seepage.operators.roots import files_in_roots, in_ignored_dir, owner_root
from seepage.plans import jobs
from seepage.plans import oracle as O
from seepage.plans.documents import doc_fingerprints, doc_leaks
from seepage.plans.fixtures import fixture
from seepage.plans.tree import write_tree
from seepage.session import scratch_path
from seepage.sources.files import read_files
from seepage.sources.trail import append_leak_events, read_leak_events, redacted_inventory
from seepage.sources.worktrees import worktrees_from_listing

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def fx(spark, sf, name) -> DataFrame:
    return fixture(spark, sf, name)


W = O.with_
EVENT_COLS = list(K.EVENT_KEYS)


# --- S4, O2 -----------------------------------------------------------------------

_PARSE_SQL = W([O.fx("listings_fx"),
                "lp AS (SELECT listing_id, pos, regexp_replace(parts[pos + 1], '\\r+$', '') AS line FROM "
                "(SELECT listing_id, parts, unnest(range(len(parts))) AS pos FROM "
                "(SELECT listing_id, string_split(text, chr(10)) AS parts FROM listings_fx)))",
                "lb AS (SELECT *, sum(CASE WHEN line = '' OR prefix(line, 'worktree ') THEN 1 ELSE 0 END) "
                "OVER (PARTITION BY listing_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM lp)",
                "lr AS (SELECT *, row_number() OVER (PARTITION BY listing_id, block ORDER BY pos) AS rk FROM lb WHERE block > 0)",
                f"lg AS (SELECT listing_id, block, "
                f"max(CASE WHEN rk = 1 AND prefix(line, 'worktree ') THEN {O.trim_ws('substr(line, 10)')} END) AS path, "
                f"arg_max({O.trim_ws('substr(line, 6)')}, pos) FILTER (WHERE prefix(line, 'HEAD ')) AS head, "
                f"arg_max({O.trim_ws('substr(line, 8)')}, pos) FILTER (WHERE prefix(line, 'branch ')) AS branch, "
                f"bool_or(line = 'bare') AS bare FROM lr GROUP BY listing_id, block)"],
               "SELECT listing_id, path, coalesce(head, '') AS head, coalesce(branch, '') AS branch, bare "
               "FROM lg WHERE path IS NOT NULL AND path <> ''")


@register("worktrees_parse", _PARSE_SQL)
def worktrees_parse(spark, sf):
    return worktrees_from_listing(fx(spark, sf, "listings_fx"))


@register("worktrees_sorted", W([O.fx("worktrees_fx")],
          "SELECT path, branch, row_number() OVER (ORDER BY path) AS pos FROM worktrees_fx"))
def worktrees_sorted(spark, sf):
    return R.number_rows(fx(spark, sf, "worktrees_fx"), ["path"], "pos").select("path", "branch", "pos")


# --- J1, F1, F2, F3 ------------------------------------------------------------------

@register("files_in_roots", W(O.ctes_files(), "SELECT worktree, path FROM fir"))
def q_files_in_roots(spark, sf):
    return files_in_roots(fx(spark, sf, "files_fx"), fx(spark, sf, "worktrees_fx")).select("worktree", "path")


@register("files_pruned", W(O.ctes_files(), "SELECT worktree, path FROM fpr"))
def files_pruned(spark, sf):
    f = files_in_roots(fx(spark, sf, "files_fx"), fx(spark, sf, "worktrees_fx"))
    return f.where(~in_ignored_dir(F.col("worktree"), F.col("path"))).select("worktree", "path")


def _secret_files(spark, sf):
    return secret_files(content_text(fx(spark, sf, "files_fx")), fx(spark, sf, "worktrees_fx"))


@register("secret_files", W(O.ctes_files(), "SELECT worktree, path, kind FROM sfk"))
def q_secret_files(spark, sf):
    return _secret_files(spark, sf).select("worktree", "path", "kind")


# --- P1-P6, P11 ----------------------------------------------------------------------

@register("env_entries", W(O.ctes_fps(),
          f"SELECT worktree, path, ord, field, {O.vhash('value')} AS value_hash FROM env_fp WHERE value <> ''"))
def q_env_entries(spark, sf):
    e = env_entries(_secret_files(spark, sf))
    return e.select("worktree", "path", "ord", "field", C.value_hash(F.col("value").cast("binary")).alias("value_hash"))


@register("blob_entries", W(O.ctes_fps(),
          f"SELECT worktree, path, field, {O.vhash('value')} AS value_hash FROM blob_fp WHERE value <> ''"))
def q_blob_entries(spark, sf):
    b = blob_entries(_secret_files(spark, sf))
    return b.select("worktree", "path", "field", C.value_hash(F.col("value").cast("binary")).alias("value_hash"))


@register("fingerprints", W(O.ctes_fps(),
          "SELECT worktree, path, ord, field, value_hash, classification, masked FROM fps"))
def q_fingerprints(spark, sf):
    return jobs.fx_fingerprints(spark, sf).select("worktree", "path", "ord", "field", "value_hash",
                                                  "classification", "masked")


@register("classify_rules", W([O.fx("classify_fx")],
          f"SELECT case_id, field, {O.classify('value', 'field')} AS classification, "
          f"{O.severity(O.classify('value', 'field'))} AS severity FROM classify_fx"))
def classify_rules(spark, sf):
    c = fx(spark, sf, "classify_fx")
    cls = C.classify(F.col("value"), F.col("field"))
    return c.select("case_id", "field", cls.alias("classification"), C.severity(cls).alias("severity"))


@register("normalized_inventory", W(O.ctes_fps(),
          "SELECT replace(replace(lower(field), '-', '_'), '.', '_') AS normalized_field, classification, "
          "count(*) AS n FROM fps GROUP BY 1, 2"))
def q_normalized_inventory(spark, sf):
    return R.normalized_inventory(jobs.fx_fingerprints(spark, sf))


@register("promote_unknown", W(O.ctes_fps(), "SELECT field, classification, count(*) AS n FROM fps GROUP BY 1, 2"))
def q_promote_unknown(spark, sf):
    fps = promote_unknown(jobs.fx_fingerprints(spark, sf), None)
    return fps.groupBy("field", "classification").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


_POINTS = ("2 * strlen(value) + 3 * strlen(regexp_replace(value, '[^0-9]', '', 'g')) - strlen(regexp_replace(value, '[^a-z]', '', 'g')) "
           "+ 2 * strlen(regexp_replace(value, '[^A-Z]', '', 'g')) - 10 * strlen(regexp_replace(value, '[^ ]', '', 'g'))")


@register("promoted_by_model", W(O.ctes_fps(),
          f"SELECT worktree, path, ord, field, CASE WHEN classification = 'unknown' AND {_POINTS} >= 60 THEN 'secret' ELSE classification END AS classification FROM fps"))
def promoted_by_model(spark, sf):
    """V1 with a scorer in place: it sees the unknown values, and what it names changes its class."""
    fps = fingerprints(fx(spark, sf, "files_fx"), fx(spark, sf, "worktrees_fx"), promoter(LinearScorer()))
    return fps.select("worktree", "path", "ord", "field", "classification")


@register("files_from_tree", W(O.ctes_files(),
          f"SELECT worktree, path, {O.vhash('content')} AS content_hash FROM sfk"))
def files_from_tree(spark, sf):
    """The roots' trees are walked; as J1, F1 and F2 say of the same files."""
    base = write_tree(fx(spark, sf, "files_fx"))
    roots = [r.path for r in fx(spark, sf, "worktrees_fx").select("path").collect()]  # S1's argument is a list
    below = lambda c: F.substr(c, F.lit(len(base) + 1))
    return read_files(spark, [base + r for r in roots]).select(below(F.col("worktree")).alias("worktree"), below(F.col("path")).alias("path"), C.value_hash(F.col("content")).alias("content_hash"))


# --- A1, A2, S5, J3 ------------------------------------------------------------------

@register("actor_per_root", W([O.fx("worktrees_fx")] + O.ctes_actors(), "SELECT worktree, agent_pid FROM actors"))
def q_actor_per_root(spark, sf):
    return jobs.fx_actors(spark, sf)


@register("inventory_by_root", W(O.ctes_fps() + O.ctes_actors(),
          "SELECT a.worktree, a.agent_pid, CAST(count(f.worktree) AS BIGINT) AS n_fingerprints "
          "FROM actors a LEFT JOIN fps f ON f.worktree = a.worktree GROUP BY a.worktree, a.agent_pid"))
def q_inventory_by_root(spark, sf):
    return R.inventory_by_root(jobs.fx_fingerprints(spark, sf), fx(spark, sf, "worktrees_fx"),
                               jobs.fx_actors(spark, sf))


@register("inventory_totals", W(O.ctes_fps(),
          "SELECT (SELECT count(*) FROM worktrees_fx) AS n_worktrees, (SELECT count(*) FROM fps) AS n_fingerprints"))
def q_inventory_totals(spark, sf):
    return R.inventory_totals(jobs.fx_fingerprints(spark, sf), fx(spark, sf, "worktrees_fx"))


@register("inventory_redacted", W(O.ctes_fps(), "SELECT path, field, value_hash, classification FROM fps"))
def q_inventory_redacted(spark, sf):
    fps = hold(jobs.fx_fingerprints(spark, sf).select("worktree", "path", "ord", "field", "value_hash", "classification"))
    return redacted_inventory(fps.orderBy(*R.inventory_order(fps)))


@register("inventory_ordered", W(O.ctes_fps(),
          "SELECT row_number() OVER (ORDER BY worktree, string_split(path, '/'), ord) AS pos, worktree, path, ord, value_hash FROM fps"))
def q_inventory_ordered(spark, sf):
    """O3 as data: the position of every entry in inventory order."""
    fps = hold(jobs.fx_fingerprints(spark, sf).select("worktree", "path", "ord", "value_hash"))  # read for the cuts, the counts and the rows
    return R.number_rows(fps, R.inventory_order(fps), "pos").select("pos", "worktree", "path", "ord", "value_hash")


# --- J2, F5, J4 -----------------------------------------------------------------------

@register("write_owner", W(O.ctes_fps() + O.ctes_actors() + O.ctes_writes(), "SELECT write_id, target_worktree FROM ow"))
def write_owner(spark, sf):
    return jobs.fx_owned_writes(spark, sf, with_pid=False).select("write_id", "target_worktree")


@register("write_routing", W([O.fx("worktrees_fx"), O.fx("writes_fx"),
          "wo AS (SELECT w.write_id, w.path, coalesce(w.content, '') AS content, arg_max(r.path, length(r.path)) AS root "
          "FROM writes_fx w LEFT JOIN worktrees_fx r ON w.path = r.path OR starts_with(w.path, r.path || '/') "
          "GROUP BY w.write_id, w.path, w.content)"],
          "SELECT CASE WHEN root IS NULL THEN 'unowned' WHEN " + O.ignored("root", "path") +
          " THEN 'ignored_dir' WHEN strlen(content) = 0 THEN 'empty' ELSE 'matched' END AS route, count(*) AS n "
          "FROM wo GROUP BY 1"))
def write_routing(spark, sf):
    """F5/J2/F1 accounting: every write lands in exactly one route. Owned
    writes are routed map-side; 'unowned' = all writes minus owned ones, from
    partial counts only (no join, no shuffle of write rows)."""
    w = fx(spark, sf, "writes_fx").select("write_id", "path", F.coalesce("content", F.lit("")).alias("content"))
    owned = owner_root(w, "path", fx(spark, sf, "worktrees_fx"), "root")
    route = (F.when(in_ignored_dir(F.col("root"), F.col("path"), F.col("root_base")), F.lit("ignored_dir"))
              .when(F.octet_length("content") == 0, F.lit("empty")).otherwise(F.lit("matched")))
    tagged = owned.select(route.alias("route")).unionByName(w.select(F.lit("__all").alias("route")))
    c = tagged.groupBy("route").agg(F.count(F.lit(1)).cast("bigint").alias("n"))  # at most 4 rows
    total = F.sum(F.when(F.col("route") == "__all", F.col("n"))).over(Window.partitionBy())
    owned_n = F.sum(F.when(F.col("route") != "__all", F.col("n"))).over(Window.partitionBy())
    c = c.withColumn("_unowned", total - owned_n)
    unowned = c.where(F.col("route") == "__all").select(F.lit("unowned").alias("route"), F.col("_unowned").alias("n"))
    return c.where(F.col("route") != "__all").select("route", "n").unionByName(unowned).where(F.col("n") > 0)


@register("other_domain_counts", W(O.ctes_fps() + O.ctes_actors() + O.ctes_writes(),
          f"SELECT t.target_worktree, CAST(count(f.worktree) AS BIGINT) AS n_candidates FROM "
          f"(SELECT DISTINCT target_worktree FROM ow) t LEFT JOIN fps f ON f.worktree <> t.target_worktree "
          f"AND f.vlen >= {K.MIN_MATCH_LEN} GROUP BY t.target_worktree"))
def q_other_domain_counts(spark, sf):
    """J4 + F4: fingerprints each receiving root is matched against."""
    fps = as_match_side(jobs.fx_fingerprints(spark, sf))
    targets = jobs.fx_owned_writes(spark, sf, with_pid=False)
    return other_domain_counts(targets, fps)


# --- P12, P13 ---------------------------------------------------------------------------

@register("trigram_similarity", W([O.fx("pairs_fx"),
          f"tp AS (SELECT case_id, {O.trigram_list('a')} AS ta, {O.trigram_list('b')} AS tb FROM pairs_fx)",
          "ti AS (SELECT case_id, len(list_intersect(ta, tb)) AS inter, len(ta) + len(tb) - len(list_intersect(ta, tb)) AS union_size FROM tp)"],
          "SELECT case_id, CAST(inter AS INTEGER) AS inter, CAST(union_size AS INTEGER) AS union_size, "
          "(union_size = 0 OR 10 * inter >= 9 * union_size) AS is_similar FROM ti"))
def trigram_similarity(spark, sf):
    p = fx(spark, sf, "pairs_fx")
    ta, tb = C.trigrams(F.col("a").cast("binary")), C.trigrams(F.col("b").cast("binary"))
    t = p.select("case_id", F.size(F.array_intersect(ta, tb)).alias("inter"),
                 F.size(F.array_union(ta, tb)).alias("union_size"))
    return t.withColumn("is_similar", (F.col("union_size") == 0) | C.jaccard_hit(F.col("inter"), F.col("union_size")))


# --- J5, J6, J7, J8, P7, P10 ---------------------------------------------------------------

_LEAK_COLS_SQL = ("SELECT m.wid AS write_id, m.worktree AS source_worktree, m.path AS source_path, "
                  "f.field AS secret_field, w.target_worktree FROM {src} m JOIN ow w ON w.write_id = m.wid "
                  "JOIN fps f ON f.worktree = m.worktree AND f.path = m.path AND f.ord = m.ord")


def _leak_cols(df: DataFrame) -> DataFrame:
    return df.select("write_id", F.col("fp_worktree").alias("source_worktree"),
                     F.col("fp_path").alias("source_path"), "secret_field", "target_worktree")


@register("exact_leaks", W(O.fixture_match_ctes(), _LEAK_COLS_SQL.format(src="m_exact")))
def exact_leaks(spark, sf):
    return _leak_cols(jobs.fx_matches(spark, sf, ("exact",)))


@register("fuzzy_leaks", W(O.fixture_match_ctes(), _LEAK_COLS_SQL.format(src="m_fuzzy")))
def fuzzy_leaks(spark, sf):
    return _leak_cols(jobs.fx_matches(spark, sf, ("fuzzy",)))


def _events_text(ev: DataFrame) -> DataFrame:
    return ev.withColumn("timestamp", C.rfc3339_nano(F.col("timestamp")))


@register("leak_events", W(O.fixture_events_ctes(), "SELECT * FROM events_out"))
def leak_events(spark, sf):
    return _events_text(jobs.fx_leak_events(spark, sf))


@register("event_summary", W(O.fixture_events_ctes(),
          "SELECT write_id, format('[{}] {}:{} -> {}:{}  field={}  kind={}  severity={}', "
          f"{O.rfc_sec('ts')}, source_worktree, source_path, target_worktree, target_path, secret_field, "
          "match_kind, severity) AS summary FROM events_raw"))
def q_event_summary(spark, sf):
    ev = jobs.fx_leak_events(spark, sf)
    return R.event_summary(ev, "write_id")


# --- A3, A4, A5, O1, P8, P9, P14 (report side, over a trail) -----------------------------

_TRAIL = [O.fx("trail_fx")]


@register("severity_summary", W(_TRAIL,
          f"SELECT severity, count(*) AS n, CAST({O.sev_rank('severity')} AS BIGINT) AS severity_rank "
          f"FROM trail_fx GROUP BY severity"))
def severity_summary(spark, sf):
    return R.count_by_severity(fx(spark, sf, "trail_fx"))


@register("report_sentence", W(_TRAIL + [
          "a AS (SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'secret') AS secrets FROM trail_fx)"],
          f"SELECT total, secrets, format({O.q(K.SUMMARY_HEAD_FMT.replace('%d', '{}'))}, total, secrets) || "
          f"CASE WHEN secrets > 0 THEN {O.q(K.SENTENCE_ANY_SECRET)} ELSE {O.q(K.SENTENCE_NO_SECRET)} END AS sentence FROM a"))
def q_report_sentence(spark, sf):
    return R.report_sentence(fx(spark, sf, "trail_fx"))


@register("report_header", W(_TRAIL + [O.fx("worktrees_fx"),
          "p AS (SELECT path FROM worktrees_fx UNION SELECT source_worktree FROM trail_fx UNION SELECT target_worktree FROM trail_fx)"],
          f"SELECT (SELECT count(*) FROM trail_fx) AS n_events, (SELECT count(*) FROM p) AS n_worktrees, "
          f"CASE WHEN (SELECT count(*) FROM trail_fx) = 0 THEN {O.q(K.EMPTY_TRAIL_NOTICE)} END AS notice"))
def q_report_header(spark, sf):
    return R.report_header(fx(spark, sf, "worktrees_fx"), fx(spark, sf, "trail_fx"))


_SRC, _TGT = O.short_path("source_worktree"), O.short_path("target_worktree")


@register("ranked_report", W(_TRAIL + [
          f"rk AS (SELECT *, row_number() OVER (ORDER BY {O.sev_rank('severity')}, trail_pos) AS rn FROM trail_fx)"],
          f"SELECT rn, {_SRC} AS source, {_TGT} AS target, secret_field AS field, match_kind AS match, severity, "
          f"format('| {{}} | {{}} | {{}} | {{}} | {{}} | {{}} |', rn, {_SRC}, {_TGT}, secret_field, match_kind, severity) AS row_text FROM rk"))
def q_ranked_report(spark, sf):
    return R.ranked_report(fx(spark, sf, "trail_fx"))


@register("map_edges", W(_TRAIL,
          f"SELECT trail_pos, format('  {{}} ──{{}}──▶ {{}}   {{}}={{}}', {_SRC}, match_kind, {_TGT}, secret_field, severity) "
          f"AS edge_text FROM trail_fx"))
def q_map_edges(spark, sf):
    return R.map_edges(fx(spark, sf, "trail_fx"))


@register("map_edges_rollup", W(_TRAIL,
          f"SELECT source_worktree AS source, target_worktree AS target, count(*) AS n, "
          f"CASE min({O.sev_rank('severity')}) WHEN 0 THEN 'secret' WHEN 1 THEN 'config' WHEN 2 THEN 'state' ELSE 'other' END "
          f"AS worst_severity FROM trail_fx GROUP BY 1, 2"))
def q_map_edges_rollup(spark, sf):
    return R.map_edges_rollup(fx(spark, sf, "trail_fx"))


@register("map_nodes", W(_TRAIL + [O.fx("worktrees_fx"),
          "nk AS (SELECT path, 0 AS grp, path AS skey, NULL::BIGINT AS nkey FROM worktrees_fx "
          "UNION ALL SELECT source_worktree, 1, NULL, 2 * trail_pos FROM trail_fx "
          "UNION ALL SELECT target_worktree, 1, NULL, 2 * trail_pos + 1 FROM trail_fx)",
          "nf AS (SELECT path, min(struct_pack(grp := grp, skey := skey, nkey := nkey)) AS k FROM nk GROUP BY path)"],
          f"SELECT row_number() OVER (ORDER BY k.grp, k.skey NULLS FIRST, k.nkey NULLS FIRST) AS pos, path, "
          f"{O.short_path('path')} AS label FROM nf"))
def q_map_nodes(spark, sf):
    return R.map_nodes(fx(spark, sf, "worktrees_fx"), fx(spark, sf, "trail_fx"))


@register("map_node_count", W(_TRAIL + [O.fx("worktrees_fx")],
          "SELECT count(DISTINCT path) AS n_nodes FROM (SELECT path FROM worktrees_fx UNION ALL "
          "SELECT source_worktree FROM trail_fx UNION ALL SELECT target_worktree FROM trail_fx)"))
def q_map_node_count(spark, sf):
    return R.count_nodes(fx(spark, sf, "worktrees_fx"), fx(spark, sf, "trail_fx"))


# --- S2, S3 -------------------------------------------------------------------------------

@register("trail_round_trip", W(O.fixture_events_ctes(), "SELECT * EXCLUDE (write_id) FROM events_out"))
def trail_round_trip(spark, sf):
    path = scratch_path(spark, "trail")
    append_leak_events(jobs.fx_leak_events(spark, sf), path)
    return read_leak_events(spark, path).select(*EVENT_COLS)


_BACK = ("back AS (SELECT *, row_number() OVER (ORDER BY timestamp, target_path, source_worktree, source_path, secret_field, match_kind) "
         "AS pos FROM trail_fx)")


@register("report_from_trail", W(_TRAIL + [_BACK,
          f"ranked AS (SELECT *, row_number() OVER (ORDER BY {O.sev_rank('severity')}, pos) AS rn FROM back)"],
          f"SELECT 'rank' AS kind, rn AS pos, format('| {{}} | {{}} | {{}} | {{}} | {{}} | {{}} |', rn, {_SRC}, {_TGT}, secret_field, match_kind, severity) AS line FROM ranked "
          f"UNION ALL SELECT 'edge', pos, format('  {{}} ──{{}}──▶ {{}}   {{}}={{}}', {_SRC}, match_kind, {_TGT}, secret_field, severity) FROM back "
          f"UNION ALL SELECT 'summary', pos, format('[{{}}] {{}}:{{}} -> {{}}:{{}}  field={{}}  kind={{}}  severity={{}}', {O.rfc_sec('timestamp')}, source_worktree, "
          f"source_path, target_worktree, target_path, secret_field, match_kind, severity) FROM back"))
def report_from_trail(spark, sf):
    """S3, S2, then O1, A5 and P10 on what was read back."""
    path = scratch_path(spark, "trail")
    append_leak_events(fx(spark, sf, "trail_fx").drop("trail_pos"), path)
    t = hold(R.positioned(read_leak_events(spark, path)))  # numbered once, read by the ranking (three times), edges and summaries
    out = R.ranked_report(t).select(F.lit("rank").alias("kind"), F.col("rn").alias("pos"), F.col("row_text").alias("line"))
    for kind, df in (("edge", R.map_edges(t)), ("summary", R.event_summary(t))):
        out = out.unionByName(df.toDF("pos", "line").withColumn("kind", F.lit(kind)))
    return out


# --- ST1, ST2 -------------------------------------------------------------------------------

@register("leak_stream", W(O.fixture_events_ctes(), "SELECT * EXCLUDE (write_id) FROM events_out"))
def leak_stream(spark, sf):
    from seepage.streaming.leak_stream import run_fixture_stream
    return run_fixture_stream(spark, sf).select(*EVENT_COLS)


# --- documents lane ---------------------------------------------------------------------

@register("doc_fingerprints", W(O.doc_ctes(),
          "SELECT doc_id, source, ord, field, value_hash, classification FROM dfps"))
def q_doc_fingerprints(spark, sf):
    from seepage.plans.tables import table
    return doc_fingerprints(table(spark, sf, "documents")).select(
        "doc_id", "source", "ord", "field", "value_hash", "classification")


_DOC_MATCH = O.doc_ctes() + O.ctes_match("dw", "doc_id", "source", "dfps", ["doc_id", "source", "ord"], "source")
_DOC_COLS = ("SELECT m.wid AS doc_id, w.source, m.doc_id AS source_doc_id, m.source AS source_domain, "
             "m.ord AS source_ord, f.field, '{kind}' AS match_kind FROM {src} m JOIN dw w ON w.doc_id = m.wid "
             "JOIN dfps f ON f.doc_id = m.doc_id AND f.ord = m.ord")


@register("doc_exact_leaks", W(_DOC_MATCH, _DOC_COLS.format(src="m_exact", kind="exact")))
def doc_exact_leaks(spark, sf):
    return doc_leaks(spark, sf, ("exact",))


@register("doc_fuzzy_leaks", W(_DOC_MATCH, _DOC_COLS.format(src="m_fuzzy", kind="fuzzy")))
def doc_fuzzy_leaks(spark, sf):
    return doc_leaks(spark, sf, ("fuzzy",))


@register("doc_leak_events", W(_DOC_MATCH, "SELECT * FROM (" + _DOC_COLS.format(src="m_exact", kind="exact") +
          " UNION ALL " + _DOC_COLS.format(src="m_fuzzy", kind="fuzzy") + ")"))
def doc_leak_events(spark, sf):
    """J7 on the documents table: exact else fuzzy, one row per (doc, fingerprint)."""
    return doc_leaks(spark, sf, ("exact", "fuzzy"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
