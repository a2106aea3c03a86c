"""Column expressions (all JVM-side, no Python UDFs).

Each function takes Column(s) and returns a Column, so the steps compose into
one projection that whole-stage codegen compiles. Text is bytes: lengths and
n-grams work on BINARY (``octet_length``, binary ``substring``), regexes on the
lossless string view of the same bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seepage.functions import constants as K


# --- regex dialect ------------------------------------------------------------
# The fixed patterns are RE2. Java regex differs in three ways that matter
# here: '.' also stops at \r, U+0085, U+2028/9 (fixed by UNIX_LINES, (?d));
# '$' also matches before a final line break (use \z); (?i) folds only ASCII
# (add u for Unicode folding).

def java_regex(pattern: str) -> str:
    p = pattern.replace("(?i)", "(?iu)")
    if p.endswith("$") and not p.endswith("\\$"):
        p = p[:-1] + "\\z"
    return "(?d)" + p


def glob_alternation(globs=K.SCAN_GLOBS) -> str:
    """Shell globs on a base name -> one regex alternation body."""
    out = []
    for g in globs:
        out.append("".join(".*" if ch == "*" else ("\\." if ch == "." else ch) for ch in g))
    return "(" + "|".join(out) + ")"


SECRET_FILE_RE_JAVA = "(?s)^" + glob_alternation() + "\\z"
SECRET_FILE_RE_RE2 = "(?s)^" + glob_alternation() + "$"


def ws_trim(c: Column) -> Column:
    """Trim Unicode white space at both ends (Spark ``trim`` only strips U+0020)."""
    return F.btrim(c, F.lit(K.WS_CHARS))


def byte_view(b: Column) -> Column:
    """A BINARY column as text with one character for each byte; ``from_byte_view``
    is the inverse. String functions that cut at ASCII signs then cut the bytes, and
    bytes that are not UTF-8 stay as they are."""
    return F.decode(b, "ISO-8859-1")


def from_byte_view(c: Column) -> Column:
    return F.encode(c, "ISO-8859-1")


def ws_trim_view(c: Column) -> Column:
    """ws_trim on a byte view: white space is its UTF-8 byte sequence there."""
    ws = "(?:" + "|".join("".join(f"\\x{b:02x}" for b in ch.encode()) for ch in K.WS_CHARS) + ")+"
    return F.regexp_replace(c, f"\\A{ws}|{ws}\\z", "")


def trim_trailing_slash(c: Column) -> Column:
    return F.when(F.regexp_extract(c, r"/+\z", 0) == c, F.lit("")).otherwise(
        F.regexp_replace(c, r"/+\z", ""))


def basename(c: Column) -> Column:
    """Last path element (trailing slashes ignored)."""
    t = trim_trailing_slash(c)
    return F.when(c == "", F.lit(".")).when(t == "", F.lit("/")).otherwise(
        F.element_at(F.split(t, "/"), -1))


def is_secret_file(name: Column) -> Column:
    return name.rlike(SECRET_FILE_RE_JAVA)


def is_env_file(name: Column) -> Column:
    low = F.lower(name)
    return (low == ".env") | low.endswith(".env") | low.startswith(".env.")


def unquote(v: Column) -> Column:
    """Strip one pair of matching single or double quotes."""
    quoted = (F.length(v) >= 2) & (
        (v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'")))
    return F.when(quoted, v.substr(F.lit(2), F.length(v) - 2)).otherwise(v)


def value_hash(value_bin: Column) -> Column:
    """First 16 hex chars of SHA-256 over the bytes."""
    return F.substring(F.sha2(value_bin, 256), 1, 16)


def mask(v: Column) -> Column:
    n = F.length(v)
    return (F.when(n <= 4, F.repeat(F.lit("*"), n))
            .when(n <= 12, F.concat(F.left(v, F.lit(2)), F.repeat(F.lit("*"), n - 2)))
            .otherwise(F.concat(F.left(v, F.lit(6)), F.lit("…"), F.right(v, F.lit(4)))))


def classify(value: Column, field: Column) -> Column:
    """Ordered rules, first hit wins, else 'unknown' (CASE WHEN short-circuits)."""
    out = None
    for fpat, vpat, verdict in K.CLASS_RULES:
        cond = field.rlike(java_regex(fpat)) & value.rlike(java_regex(vpat))
        out = F.when(cond, F.lit(verdict)) if out is None else out.when(cond, F.lit(verdict))
    return out.otherwise(F.lit(K.CLASS_UNKNOWN))


def severity(cls: Column) -> Column:
    return (F.when(cls.isin(K.CLASS_SECRET, K.CLASS_UNKNOWN), F.lit(K.SEV_SECRET))
            .when(cls == K.CLASS_CONFIG, F.lit(K.SEV_CONFIG))
            .when(cls == K.CLASS_STATE, F.lit(K.SEV_STATE))
            .otherwise(F.lit(K.SEV_SECRET)))


def severity_rank(sev: Column) -> Column:
    return (F.when(sev == K.SEV_SECRET, 0).when(sev == K.SEV_CONFIG, 1)
            .when(sev == K.SEV_STATE, 2).otherwise(3))


def short_path(p: Column) -> Column:
    """'' -> '?'; trailing '/' dropped; last two segments."""
    p = F.coalesce(p, F.lit(""))
    parts = F.split(trim_trailing_slash(p), "/")
    return (F.when(p == "", F.lit("?"))
            .when(F.size(parts) <= 2, F.array_join(parts, "/"))
            .otherwise(F.array_join(F.slice(parts, -2, 2), "/")))


def normalize_field(f: Column) -> Column:
    return F.translate(F.lower(f), "-.", "__")


def rfc3339_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rfc3339_nano(ts: Column) -> Column:
    """Timestamp text as in the JSON trail: fraction without trailing zeros."""
    s = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(s, r"\.?0+\z", ""), F.lit("Z"))


def trigrams(b: Column) -> Column:
    """Distinct byte 3-grams of a BINARY column; fewer than 3 bytes -> []."""
    n = F.octet_length(b)
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.substring(b, i + 1, 3))
    return F.when(n >= 3, F.array_distinct(grams)).otherwise(
        F.array().cast("array<binary>"))


def jaccard_hit(inter: Column, union: Column) -> Column:
    """Jaccard >= 9/10 in integers (equal to the float test for these ratios)."""
    return (F.lit(K.FUZZY_DEN) * inter) >= (F.lit(K.FUZZY_NUM) * union)
