"""Fixture relations derived from the driver's tables (no file trees, roots or
process lists exist there). The SQL runs unchanged in Spark and in DuckDB;
``{table}`` placeholders are filled with each side's table names.

Every relation covers its whole base table: roots from region + nation,
files from supplier, writes from all of events, processes from all of customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seepage.plans.tables import spark_names

WORKTREES_FX = """
SELECT '/repo/r' || CAST(r_regionkey AS STRING) AS path, 'refs/heads/r' || CAST(r_regionkey AS STRING) AS branch FROM {region}
UNION ALL
SELECT '/repo/r' || CAST(n_regionkey AS STRING) || '/wt-' || CAST(n_nationkey AS STRING), 'refs/heads/n' || CAST(n_nationkey AS STRING) FROM {nation}
"""

FILES_FX = """
SELECT s_suppkey AS file_id,
  '/repo/r' || CAST(n_regionkey AS STRING) || '/wt-' || CAST(n_nationkey AS STRING) || '/svc' || CAST(s_suppkey AS STRING) ||
  CASE s_suppkey % 8 WHEN 0 THEN '/.env' WHEN 1 THEN '/cfg/app.env' WHEN 2 THEN '/.env.local' WHEN 3 THEN '/keys/id_rsa'
    WHEN 4 THEN '/node_modules/.env' WHEN 5 THEN '/src/main.txt' WHEN 6 THEN '/.ENV' ELSE '/auth.pem' END AS path,
  CASE WHEN s_suppkey % 8 IN (3, 7) THEN
    chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || md5('k' || CAST(s_suppkey AS STRING)) || chr(10) || '-----END RSA PRIVATE KEY-----' || chr(10)
  ELSE
    '# svc ' || CAST(s_suppkey AS STRING) || chr(10) || 'DB_TOKEN=' || md5('tok' || CAST(s_suppkey AS STRING)) || chr(10) ||
    'DEBUG=true' || chr(10) || chr(10) || 'EMPTY=' || chr(10) || ' QUOTED = "' || substr(md5('q' || CAST(s_suppkey AS STRING)), 1, 16) || '"' || chr(13) || chr(10) ||
    'DSN=postgres://svc' || CAST(s_suppkey AS STRING) || '@db:5432/x' || chr(10) || 'SESSION_ID=s-' || CAST(s_suppkey AS STRING) || '-' || substr(md5('s' || CAST(s_suppkey AS STRING)), 1, 12) || chr(10) ||
    'CACHE_KEY=' || md5('c' || CAST(s_suppkey AS STRING)) || chr(10) || 'export PLAIN=' || md5('p' || CAST(s_suppkey AS STRING)) || chr(10) || '=nokey'
  END AS content
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""

WRITES_FX = """
SELECT event_id AS write_id, ts,
  CASE WHEN event_id % 11 = 0 THEN '/tmp/out/f' || CAST(user_id AS STRING) || '.txt'
       WHEN event_id % 13 = 0 THEN '/repo/r' || CAST(n_regionkey AS STRING) || '/build/f.txt'
       WHEN event_id % 17 = 0 THEN '/repo/r' || CAST(n_regionkey AS STRING) || '/notes.md'
       ELSE '/repo/r' || CAST(n_regionkey AS STRING) || '/wt-' || CAST(n_nationkey AS STRING) || '/src/f' || CAST(user_id AS STRING) || '.txt' END AS path,
  CASE event_id % 7
    WHEN 0 THEN 'tok := ' || md5('tok' || CAST(event_id % 100 AS STRING)) || chr(10)
    WHEN 1 THEN 'tok := ' || substr(md5('tok' || CAST(event_id % 100 AS STRING)), 1, 31) || 'Z' || chr(10)
    WHEN 2 THEN substr(md5('tok' || CAST(event_id % 100 AS STRING)), 1, 31)
    WHEN 3 THEN substr(md5('tok' || CAST(event_id % 100 AS STRING)), 1, 15) || 'Z' || substr(md5('tok' || CAST(event_id % 100 AS STRING)), 17, 16)
    WHEN 4 THEN ''
    WHEN 5 THEN 'DEBUG=true' || chr(10)
    ELSE CASE event_id % 5
      WHEN 0 THEN 'x' || chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || md5('k' || CAST(event_id % 100 AS STRING)) || chr(10) || '-----END RSA PRIVATE KEY-----' || chr(10)
      WHEN 1 THEN 'url = "postgres://svc' || CAST(event_id % 100 AS STRING) || '@db:5432/x"'
      WHEN 2 THEN 'sid s-' || CAST(event_id % 100 AS STRING) || '-' || substr(md5('s' || CAST(event_id % 100 AS STRING)), 1, 12)
      ELSE props END END AS content
FROM {events} JOIN {nation} ON n_nationkey = user_id % 25
"""

PROCS_FX = """
SELECT CASE WHEN c_custkey % 5 < 2 THEN CAST(0 AS BIGINT) ELSE CAST(c_custkey AS BIGINT) END AS pid, c_custkey AS ord,
  CASE WHEN c_custkey % 3 = 0 OR n_nationkey % 4 = 0 THEN '/home/u' || CAST(c_custkey AS STRING) || '/work'
       ELSE '/repo/r' || CAST(n_regionkey AS STRING) || '/wt-' || CAST(n_nationkey AS STRING) || '/svc' END AS cwd
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

# Captured porcelain listings, one per supplier: nested/CRLF/locked blocks,
# bare, unterminated, detached, orphan lines, empty path, repeated HEAD.
LISTINGS_FX = """
SELECT s_suppkey AS listing_id,
  'worktree /srv/r' || CAST(s_suppkey AS STRING) || chr(10) || 'HEAD ' || md5('h' || CAST(s_suppkey AS STRING)) || chr(10) ||
  'branch refs/heads/main' || chr(10) || chr(10) ||
  'worktree /srv/r' || CAST(s_suppkey AS STRING) || '-wt-b' || chr(13) || chr(10) || 'HEAD ' || md5('b' || CAST(s_suppkey AS STRING)) || chr(13) || chr(10) ||
  'branch refs/heads/feature/b' || CAST(s_suppkey AS STRING) || chr(10) || 'locked' || chr(10) || chr(10) ||
  CASE s_suppkey % 4
    WHEN 0 THEN 'worktree /srv/r' || CAST(s_suppkey AS STRING) || '-bare' || chr(10) || 'bare' || chr(10)
    WHEN 1 THEN 'worktree /srv/r' || CAST(s_suppkey AS STRING) || '-wt-c' || chr(10) || 'HEAD ' || md5('c' || CAST(s_suppkey AS STRING)) || chr(10) || 'detached'
    WHEN 2 THEN 'HEAD orphan' || chr(10) || 'worktree ' || chr(10) || 'HEAD x' || chr(10) || chr(10) ||
      'worktree /srv/r' || CAST(s_suppkey AS STRING) || '-d' || chr(10) || 'HEAD ' || md5('d' || CAST(s_suppkey AS STRING)) || chr(10) ||
      'HEAD ' || md5('e' || CAST(s_suppkey AS STRING)) || chr(10) || 'branch refs/heads/x' || chr(10) ||
      'worktree /srv/r' || CAST(s_suppkey AS STRING) || '-f' || chr(10) || 'branch refs/heads/f'
    ELSE chr(10) || chr(10) || 'worktree   /srv/r' || CAST(s_suppkey AS STRING) || '-g  ' || chr(10) ||
      'HEAD   ' || md5('g' || CAST(s_suppkey AS STRING)) || '  ' || chr(10) || chr(10)
  END AS text
FROM {supplier}
"""

# (field, value) cases for the ordered classification rules, one per customer:
# every rule, the traps (AUTHOR, long CACHE_KEY, 'True', a trailing newline,
# HOST=localhost) and Unicode case folding (Kelvin sign, long s).
CLASSIFY_FX = """
SELECT c_custkey AS case_id,
  CASE c_custkey % 16
    WHEN 0 THEN 'AWS_ACCESS_KEY_ID' WHEN 1 THEN 'AWS_SECRET_ACCESS_KEY' WHEN 2 THEN 'GITHUB_TOKEN' WHEN 3 THEN 'SLACK_TOKEN'
    WHEN 4 THEN 'id_rsa' WHEN 5 THEN 'DSN' WHEN 6 THEN 'ENDPOINT' WHEN 7 THEN 'PORT' WHEN 8 THEN 'DEBUG'
    WHEN 9 THEN 'SESSION_ID' WHEN 10 THEN 'PLAIN' WHEN 11 THEN 'AUTHOR' WHEN 12 THEN 'CACHE_KEY' WHEN 13 THEN 'HOST'
    WHEN 14 THEN 'gh_pat' ELSE CASE WHEN c_custkey % 32 = 15 THEN 'TOKEN' ELSE 'ſLACK_HOOK' END END AS field,
  CASE c_custkey % 16
    WHEN 0 THEN 'AKIA' || upper(substr(md5(c_name), 1, 16))
    WHEN 1 THEN substr(md5(c_name) || md5(c_mktsegment), 1, 40)
    WHEN 2 THEN 'ghp_' || md5(c_name) || 'abcd'
    WHEN 3 THEN 'xoxb-' || CAST(c_custkey AS STRING) || '-' || substr(md5(c_name), 1, 6)
    WHEN 4 THEN '-----BEGIN RSA PRIVATE KEY-----'
    WHEN 5 THEN 'postgres://u:p@h' || CAST(c_custkey AS STRING) || ':5432/db'
    WHEN 6 THEN 'https://example.com/' || CAST(c_custkey AS STRING)
    WHEN 7 THEN CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 32 = 7 THEN chr(10) ELSE '' END
    WHEN 8 THEN CASE WHEN c_custkey % 32 = 8 THEN 'True' ELSE 'true' END
    WHEN 9 THEN 'abc-' || CAST(c_custkey AS STRING)
    WHEN 10 THEN c_name
    WHEN 11 THEN c_name
    WHEN 12 THEN CASE WHEN c_custkey % 32 = 12 THEN md5(c_name) ELSE 'short' END
    WHEN 13 THEN 'localhost'
    WHEN 14 THEN 'ghp_' || md5(c_name) || '0123'
    ELSE 'xoxp-' || substr(md5(c_name), 1, 10) END AS value
FROM {customer}
"""

# Trigram similarity pairs, one per event: equal, last byte changed, middle
# changed, truncated, rotation of a repetitive value, both shorter than 3.
PAIRS_FX = """
SELECT event_id AS case_id,
  CASE event_id % 6 WHEN 4 THEN 'abcabcabc' WHEN 5 THEN 'ab' ELSE m END AS a,
  CASE event_id % 6 WHEN 0 THEN m WHEN 1 THEN substr(m, 1, 31) || 'Z' WHEN 2 THEN substr(m, 1, 15) || 'Z' || substr(m, 17, 16)
    WHEN 3 THEN substr(m, 1, 31) WHEN 4 THEN 'bcabcabca' ELSE 'a' END AS b
FROM (SELECT event_id, md5('a' || CAST(event_id AS STRING)) AS m FROM {events}) t
"""

# A leak trail with every severity and match kind, one event per row of
# events, for the report side (the fixture leaks are all secret).
TRAIL_FX = """
SELECT trail_pos, timestamp, source_worktree, source_agent_pid, source_worktree || '/.env' AS source_path, secret_field,
  target_worktree, target_agent_pid, target_worktree || '/src/f' || CAST(trail_pos AS STRING) || '.txt' AS target_path,
  match_kind, severity
FROM (
  SELECT event_id AS trail_pos, ts AS timestamp,
    CASE WHEN event_id % 9 = 0 THEN '/ext/w' || CAST(user_id % 3 AS STRING)
         ELSE '/repo/r' || CAST(n_regionkey AS STRING) || '/wt-' || CAST(n_nationkey AS STRING) END AS source_worktree,
    CAST(0 AS BIGINT) AS source_agent_pid,
    CASE event_id % 6 WHEN 0 THEN 'DB_TOKEN' WHEN 1 THEN 'DSN' WHEN 2 THEN 'SESSION_ID' WHEN 3 THEN 'API_KEY'
      WHEN 4 THEN 'PORT' ELSE 'CACHE_KEY' END AS secret_field,
    '/repo/r' || CAST((n_regionkey + 1) % 5 AS STRING) ||
      CASE WHEN event_id % 4 = 0 THEN '' ELSE '/wt-' || CAST((n_nationkey + 3) % 25 AS STRING) END AS target_worktree,
    CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS BIGINT) AS target_agent_pid,
    CASE WHEN event_id % 5 = 0 THEN 'fuzzy' ELSE 'exact' END AS match_kind,
    CASE event_id % 6 WHEN 1 THEN 'config' WHEN 4 THEN 'config' WHEN 2 THEN 'state'
      WHEN 5 THEN CASE WHEN event_id % 12 = 5 THEN 'secret' ELSE 'state' END ELSE 'secret' END AS severity
  FROM {events} JOIN {nation} ON n_nationkey = user_id % 25
) t
"""

FIXTURE_SQL = {
    "worktrees_fx": WORKTREES_FX,
    "files_fx": FILES_FX,
    "writes_fx": WRITES_FX,
    "procs_fx": PROCS_FX,
    "listings_fx": LISTINGS_FX,
    "classify_fx": CLASSIFY_FX,
    "pairs_fx": PAIRS_FX,
    "trail_fx": TRAIL_FX,
}


def fixture_sql(name: str, names: dict) -> str:
    return FIXTURE_SQL[name].format(**names)


_PLANS: dict = {}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation as a lazy DataFrame; the analysed plan (not data) is reused
    per session, so parsing and parquet footer reads happen once."""
    key = (id(spark), sf_dir, name)
    if key not in _PLANS:
        _PLANS[key] = spark.sql(fixture_sql(name, spark_names(sf_dir)))
    return _PLANS[key]


def fixtures(spark: SparkSession, sf_dir: str) -> dict:
    return {n: fixture(spark, sf_dir, n) for n in FIXTURE_SQL}


def oracle_ctes(names: dict, which=("worktrees_fx", "files_fx", "writes_fx", "procs_fx")) -> str:
    """'WITH a AS (...), b AS (...)' prefix for oracle queries."""
    return "WITH " + ",\n".join(f"{n} AS ({fixture_sql(n, names)})" for n in which)
