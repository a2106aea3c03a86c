"""These must equal the behaviour being reproduced exactly.

Everything below is data, stated plainly in its natural order. Spark-side
regex forms are derived from these by rule in ``seepage.functions.columns``.
"""

# --- fixed values -----------------------------------------------------------

# Directory names that are never looked into (scan and watch use the same list).
IGNORED_DIRS = (".git", "node_modules", ".next", "dist", "build", "target", ".venv", "venv")

# Secret-bearing file names (shell-glob patterns on the base name; case-sensitive,
# "*" may match the empty string).
SCAN_GLOBS = (
    ".env",
    "*.env",
    ".env.*",
    "*.key",
    "*.pem",
    "*.p12",
    "*.pfx",
    "id_rsa",
    "id_ed25519",
    "id_ecdsa",
    "credentials",
    "credentials.json",
    "*.credentials",
)

# Classification rules in order: (field pattern, value pattern, verdict), RE2
# syntax. The first rule whose two patterns both match decides; else "unknown".
CLASS_RULES = (
    (r"(?i)(token|secret|passwd|password|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth|bearer|jwt)", r".+", "secret"),
    (r"(?i)(aws_access_key_id|access_key)", r"^AKIA[0-9A-Z]{16}$", "secret"),
    (r"(?i)(aws_secret_access_key|secret_access_key)", r"^[A-Za-z0-9/+=]{40}$", "secret"),
    (r"(?i).*", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "secret"),
    (r"(?i)(secret|token|key|credential)", r"^[A-Za-z0-9_\-+/=]{24,}$", "secret"),
    (r"(?i)(github|gh)", r"^(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}$", "secret"),
    (r"(?i)(slack)", r"^xox[abp]-[A-Za-z0-9-]+$", "secret"),
    (r"(?i)(dsn|database_url|db_url)", r"^[a-z]+://.+", "config"),
    (r"(?i)(url|endpoint|host|registry|mirror)", r"^https?://", "config"),
    (r"(?i)(port|timeout|retries|enabled|debug|verbose|tls|ssl)", r"^(true|false|[0-9]+)$", "config"),
    (r"(?i)(session[_-]?id|cache[_-]?key|request[_-]?id|trace[_-]?id|correlation[_-]?id)", r".+", "state"),
)

CLASS_SECRET, CLASS_CONFIG, CLASS_STATE, CLASS_UNKNOWN = "secret", "config", "state", "unknown"
SEV_SECRET, SEV_CONFIG, SEV_STATE = "secret", "config", "state"
MATCH_EXACT, MATCH_FUZZY, MATCH_MODEL = "exact", "fuzzy", "llm_classified"

# Shortest value (bytes) that takes part in matching.
MIN_MATCH_LEN = 8
# Fuzzy threshold: trigram Jaccard >= 9/10, compared as integers.
FUZZY_NUM, FUZZY_DEN = 9, 10

# Unicode white space as trimmed around lines, keys and values:
# \t \n \v \f \r, space, U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028,
# U+2029, U+202F, U+205F, U+3000.
WS_CHARS = ("\t\n\x0b\x0c\r \u0085\u00a0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")

# Leak event record: JSON keys in record order.
EVENT_KEYS = (
    "timestamp",
    "source_worktree",
    "source_agent_pid",
    "source_path",
    "secret_field",
    "target_worktree",
    "target_agent_pid",
    "target_path",
    "match_kind",
    "severity",
)

# Text templates.
SUMMARY_FMT = "[%s] %s:%s -> %s:%s  field=%s  kind=%s  severity=%s"
EDGE_FMT = "  %s ──%s──▶ %s   %s=%s"
REPORT_ROW_FMT = "| %d | %s | %s | %s | %s | %s |"
SENTENCE_ANY_SECRET = ("Secret-grade material crossed a worktree boundary — review the source "
                       "worktrees' secret surfaces and the receiving commits before pushing.")
SENTENCE_NO_SECRET = ("No secret-grade leaks detected; remaining events are config/state drift "
                      "to review at your discretion.")
EMPTY_TRAIL_NOTICE = "No cross-worktree leaks recorded. Start a watch over 2+ worktrees to begin attribution."
MISSING_TRAIL_HINT = "no audit trail found at %s; start a watch first"
SUMMARY_HEAD_FMT = "Detected %d cross-worktree leak event(s); %d at secret severity. "
