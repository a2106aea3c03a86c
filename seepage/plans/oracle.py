"""DuckDB SQL for the correctness gate, written from the definitions (theta
joins on starts_with, contains, brute-force windows) rather than from the
Spark algorithms, so the two sides check each other."""

from __future__ import annotations

from seepage.functions import constants as K
from seepage.functions.columns import SECRET_FILE_RE_RE2
from seepage.plans.documents import ASSIGN_RE, EDIT_RE
from seepage.plans.fixtures import fixture_sql
from seepage.plans.tables import oracle_names

N = oracle_names()
WS = "(" + " || ".join(f"chr({ord(c)})" for c in K.WS_CHARS) + ")"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim_ws(x: str) -> str:
    return f"trim({x}, {WS})"


def basename(x: str) -> str:
    return f"string_split(rtrim({x}, '/'), '/')[-1]"


def short_path(x: str) -> str:
    parts = f"string_split(rtrim(coalesce({x}, ''), '/'), '/')"
    return (f"(CASE WHEN coalesce({x}, '') = '' THEN '?' WHEN len({parts}) <= 2 THEN array_to_string({parts}, '/') "
            f"ELSE array_to_string({parts}[-2:], '/') END)")


def classify(value: str, field: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({field}, {q(f)}) AND regexp_matches({value}, {q(v)}) THEN {q(c)}"
                    for f, v, c in K.CLASS_RULES)
    return f"(CASE {arms} ELSE 'unknown' END)"


def severity(c: str) -> str:
    return (f"(CASE WHEN {c} IN ('secret', 'unknown') THEN 'secret' WHEN {c} = 'config' THEN 'config' "
            f"WHEN {c} = 'state' THEN 'state' ELSE 'secret' END)")


def sev_rank(s: str) -> str:
    return f"(CASE {s} WHEN 'secret' THEN 0 WHEN 'config' THEN 1 WHEN 'state' THEN 2 ELSE 3 END)"


def mask(v: str) -> str:
    return (f"(CASE WHEN length({v}) <= 4 THEN repeat('*', length({v})) "
            f"WHEN length({v}) <= 12 THEN left({v}, 2) || repeat('*', length({v}) - 2) "
            f"ELSE left({v}, 6) || '…' || right({v}, 4) END)")


def vhash(v: str) -> str:
    return f"substr(sha256({v}), 1, 16)"


def rfc_nano(ts: str) -> str:
    return f"(regexp_replace(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z')"


def rfc_sec(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def fx(name: str) -> str:
    return f"{name} AS ({fixture_sql(name, N)})"


IGN = "[" + ", ".join(q(d) for d in K.IGNORED_DIRS) + "]"


def ignored(root: str, path: str) -> str:
    rel = f"string_split(substr({path}, length({root}) + 2), '/')"
    return f"list_has_any(list_concat([{basename(root)}], list_slice({rel}, 1, len({rel}) - 1)), {IGN})"


def env_style(name: str) -> str:
    return f"(lower({name}) = '.env' OR suffix(lower({name}), '.env') OR prefix(lower({name}), '.env.'))"


# --- CTE chains -----------------------------------------------------------------

def ctes_files() -> list:
    return [fx("worktrees_fx"), fx("files_fx"),
            "fir AS (SELECT r.path AS worktree, f.path, f.content FROM files_fx f JOIN worktrees_fx r "
            "ON f.path = r.path OR starts_with(f.path, r.path || '/'))",
            f"fpr AS (SELECT * FROM fir WHERE NOT {ignored('worktree', 'path')})",
            f"sfl AS (SELECT worktree, path, content, {basename('path')} AS name FROM fpr "
            f"WHERE regexp_matches({basename('path')}, {q(SECRET_FILE_RE_RE2)}))",
            f"sfk AS (SELECT worktree, path, content, name, CASE WHEN {env_style('name')} THEN 'env' ELSE 'blob' END AS kind FROM sfl)"]


def ctes_fps() -> list:
    v = "v0"
    unq = (f"CASE WHEN length({v}) >= 2 AND ((prefix({v}, '\"') AND suffix({v}, '\"')) OR "
           f"(prefix({v}, '''') AND suffix({v}, ''''))) THEN substr({v}, 2, length({v}) - 2) ELSE {v} END")
    return ctes_files() + [
        "env_split AS (SELECT worktree, path, string_split(content, chr(10)) AS parts FROM sfk WHERE kind = 'env')",
        "env_lines AS (SELECT worktree, path, ord, parts[ord + 1] AS raw FROM "
        "(SELECT worktree, path, parts, unnest(range(len(parts))) AS ord FROM env_split))",
        f"env_t AS (SELECT worktree, path, ord, {trim_ws('raw')} AS line FROM env_lines)",
        "env_i AS (SELECT worktree, path, ord, line, instr(line, '=') AS idx FROM env_t "
        "WHERE line <> '' AND NOT prefix(line, '#'))",
        f"env_kv AS (SELECT worktree, path, ord, {trim_ws('substr(line, 1, idx - 1)')} AS field, "
        f"{trim_ws('substr(line, idx + 1)')} AS v0 FROM env_i WHERE idx > 1)",
        f"env_fp AS (SELECT worktree, path, CAST(ord AS INTEGER) AS ord, field, {unq} AS value FROM env_kv)",
        f"blob_fp AS (SELECT worktree, path, 0 AS ord, name AS field, {trim_ws('content')} AS value FROM sfk WHERE kind = 'blob')",
        "fp0 AS (SELECT * FROM env_fp WHERE value <> '' UNION ALL SELECT * FROM blob_fp WHERE value <> '')",
        f"fps AS (SELECT worktree, path, ord, field, value, strlen(value) AS vlen, {vhash('value')} AS value_hash, "
        f"{classify('value', 'field')} AS classification, {mask('value')} AS masked FROM fp0)",
    ]


def ctes_actors() -> list:
    return [fx("procs_fx"),
            "proc_own AS (SELECT p.pid, p.ord, arg_max(r.path, length(r.path)) AS worktree FROM procs_fx p JOIN worktrees_fx r "
            "ON p.cwd = r.path OR starts_with(p.cwd, r.path || '/') WHERE coalesce(p.cwd, '') <> '' AND p.pid <> 0 GROUP BY p.pid, p.ord)",
            "proc_first AS (SELECT worktree, arg_min(pid, ord) AS agent_pid FROM proc_own GROUP BY worktree)",
            "actors AS (SELECT r.path AS worktree, CAST(coalesce(pf.agent_pid, 0) AS BIGINT) AS agent_pid "
            "FROM (SELECT DISTINCT path FROM worktrees_fx) r LEFT JOIN proc_first pf ON pf.worktree = r.path)"]


def ctes_writes() -> list:
    return [fx("writes_fx"),
            "w_own AS (SELECT w.write_id, arg_max(r.path, length(r.path)) AS target_worktree FROM writes_fx w JOIN worktrees_fx r "
            "ON w.path = r.path OR starts_with(w.path, r.path || '/') GROUP BY w.write_id)",
            "ow0 AS (SELECT w.write_id, w.ts, w.path AS target_path, o.target_worktree, coalesce(w.content, '') AS content "
            "FROM writes_fx w JOIN w_own o ON o.write_id = w.write_id)",
            f"ow AS (SELECT ow0.*, coalesce(a.agent_pid, 0) AS target_agent_pid FROM ow0 LEFT JOIN actors a ON a.worktree = ow0.target_worktree "
            f"WHERE strlen(content) > 0 AND NOT {ignored('target_worktree', 'target_path')})"]


def trigram_list(x: str) -> str:
    return f"list_distinct(list_transform(range(0, strlen({x}) - 2), lambda i: substr(hex(encode({x})), 2 * i + 1, 6)))"


def ctes_match(writes: str, wid: str, wdom: str, fps: str, fkey: list, fdom: str) -> list:
    """Generic exact / fuzzy matching over writes(wid, wdom, content) and
    fps(fkey..., fdom, value, vlen). Produces m_exact and m_fuzzy (wid, fkey...).
    Byte trigrams are 6-hex-digit slices of the hex text (computed once per row)."""
    fk = ", ".join(f"f.{k}" for k in fkey)
    fk_plain = ", ".join(fkey)
    on_p = " AND ".join(f"o.{k} = p.{k}" for k in fkey)
    on_vn = " AND ".join(f"vn.{k} = p.{k}" for k in fkey)
    vt_keys = ", ".join("m_vt." + k for k in fkey)
    win = "list_distinct(list_transform(range(s, s + vlen - 2), lambda j: substr(ch, 2 * j + 1, 6)))"
    return [
        f"m_pairs AS (SELECT w.{wid} AS wid, {fk}, w.content, f.value, f.vlen FROM {writes} w JOIN {fps} f "
        f"ON f.{fdom} <> w.{wdom} AND f.vlen >= {K.MIN_MATCH_LEN})",
        f"m_exact AS (SELECT wid, {fk_plain} FROM m_pairs WHERE contains(content, value))",
        # count filter: a match needs >= ceil(0.9 T) of the value's trigrams in the content
        f"m_wh AS (SELECT {wid} AS wid, hex(encode(content)) AS ch, strlen(content) AS n FROM {writes})",
        f"m_wt AS (SELECT DISTINCT wid, substr(ch, 2 * i + 1, 6) AS tri FROM "
        f"(SELECT wid, ch, unnest(range(0, n - 2)) AS i FROM m_wh))",
        f"m_wn AS (SELECT wid, count(*) AS nct FROM m_wt GROUP BY wid)",
        f"m_vh AS (SELECT {fk_plain}, hex(encode(value)) AS vh, vlen FROM {fps} WHERE vlen >= {K.MIN_MATCH_LEN})",
        f"m_vt AS (SELECT DISTINCT {fk_plain}, substr(vh, 2 * i + 1, 6) AS tri FROM "
        f"(SELECT {fk_plain}, vh, unnest(range(0, vlen - 2)) AS i FROM m_vh))",
        f"m_vn AS (SELECT {fk_plain}, count(*) AS nvt, list(tri) AS vtl FROM m_vt GROUP BY {fk_plain})",
        f"m_ov AS (SELECT m_wt.wid, {vt_keys}, count(*) AS inter FROM m_wt JOIN m_vt ON m_wt.tri = m_vt.tri "
        f"GROUP BY m_wt.wid, {vt_keys})",
        f"m_cand AS (SELECT p.*, o.inter, vn.nvt, vn.vtl, wn.nct, wh.ch, wh.n FROM m_pairs p "
        f"JOIN m_ov o ON o.wid = p.wid AND {on_p} JOIN m_vn vn ON {on_vn} "
        f"JOIN m_wn wn ON wn.wid = p.wid JOIN m_wh wh ON wh.wid = p.wid "
        f"WHERE 10 * o.inter >= 9 * vn.nvt AND NOT contains(p.content, p.value))",
        f"m_fuzzy AS (SELECT wid, {fk_plain} FROM m_cand WHERE CASE WHEN n < vlen "
        f"THEN 10 * inter >= 9 * (nct + nvt - inter) ELSE "
        f"list_bool_or(list_transform(range(0, n - vlen + 1), lambda s: "
        f"10 * len(list_intersect({win}, vtl)) >= 9 * (len({win}) + nvt - len(list_intersect({win}, vtl))))) END)",
    ]


def with_(ctes: list, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def fixture_match_ctes() -> list:
    return ctes_fps() + ctes_actors() + ctes_writes() + ctes_match(
        "ow", "write_id", "target_worktree", "fps", ["worktree", "path", "ord"], "worktree")


def fixture_events_ctes() -> list:
    ev = (
        "ev AS (SELECT m.wid AS write_id, m.worktree, m.path, m.ord, m.kind FROM "
        "(SELECT wid, worktree, path, ord, 'exact' AS kind FROM m_exact UNION ALL "
        "SELECT wid, worktree, path, ord, 'fuzzy' AS kind FROM m_fuzzy) m)",
        f"events_raw AS (SELECT e.write_id, w.ts, e.worktree AS source_worktree, "
        f"CAST(0 AS BIGINT) AS source_agent_pid, e.path AS source_path, f.field AS secret_field, w.target_worktree, "
        f"CAST(w.target_agent_pid AS BIGINT) AS target_agent_pid, w.target_path, e.kind AS match_kind, "
        f"{severity('f.classification')} AS severity "
        f"FROM ev e JOIN ow w ON w.write_id = e.write_id "
        f"JOIN fps f ON f.worktree = e.worktree AND f.path = e.path AND f.ord = e.ord)",
        f"events_out AS (SELECT write_id, {rfc_nano('ts')} AS timestamp, source_worktree, source_agent_pid, source_path, "
        f"secret_field, target_worktree, target_agent_pid, target_path, match_kind, severity FROM events_raw)",
    )
    return fixture_match_ctes() + list(ev)


def doc_ctes() -> list:
    return [
        f"d_ex AS (SELECT doc_id, source, regexp_extract_all(text, {q(ASSIGN_RE)}, 1) AS fs, "
        f"regexp_extract_all(text, {q(ASSIGN_RE)}, 2) AS vs FROM {N['documents']} WHERE text IS NOT NULL)",
        "d_fp0 AS (SELECT doc_id, source, CAST(ord AS INTEGER) AS ord, fs[ord + 1] AS field, vs[ord + 1] AS value FROM "
        "(SELECT doc_id, source, fs, vs, unnest(range(len(fs))) AS ord FROM d_ex))",
        f"dfps AS (SELECT doc_id, source, ord, field, value, strlen(value) AS vlen, {vhash('value')} AS value_hash, "
        f"{classify('value', 'field')} AS classification FROM d_fp0)",
        f"dw AS (SELECT doc_id, source, text AS content FROM {N['documents']} WHERE text IS NOT NULL UNION ALL "
        f"SELECT -1 - doc_id, source || '-fork', regexp_replace(text, {q(EDIT_RE)}, " + q('= "\\1Z"') + f", 'g') FROM {N['documents']} "
        "WHERE contains(text, '=') AND contains(text, '\"'))",
    ]
