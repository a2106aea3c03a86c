"""Randomized tests of the env-line and porcelain parsers.

The inputs are put together from parts whose meaning is known beforehand, so the
expected rows come from the parts, not from a second parser."""

import random

from seepage.operators.fingerprint import env_entries
from seepage.sources.worktrees import worktrees_from_listing

BLANKS = ["", " ", "\t", "\r", "\u3000", "\u00a0 ", "  \t"]
#: line body -> (field, value) or None; white space around it must not matter
ENV_LINES = {
    "A=1": ("A", "1"),
    "key = some value": ("key", "some value"),
    "export B=2": ("export B", "2"),
    "D==x=y": ("D", "=x=y"),
    "Q=\"in quotes\"": ("Q", "in quotes"),
    "Q=' kept blanks '": ("Q", " kept blanks "),
    "Q=\"\"inner\"\"": ("Q", "\"inner\""),
    "Q=\"open": ("Q", "\"open"),
    "Q='": ("Q", "'"),
    "C=v # not a comment": ("C", "v # not a comment"),
    "é=ß\u4e2d": ("é", "ß\u4e2d"),
    "# A=1": None,
    "#": None,
    "": None,
    "no equals sign": None,
    "=value only": None,
    "EMPTY=": None,
    "BLANK=   \t": None,
    "QUOTED_EMPTY=\"\"": None,
}
#: listing block -> (path, head, branch, bare) or None
BLOCKS = {
    "worktree /a\nHEAD 1\nbranch x": ("/a", "1", "x", False),
    "worktree /b/c\r\nHEAD 2\r\ndetached\r": ("/b/c", "2", "", False),
    "worktree   /d e  \nbare": ("/d e", "", "", True),
    "worktree /f\nHEAD 1\nlocked\nHEAD 2\nbranch y\nbranch z": ("/f", "2", "z", False),
    "worktree /g\nbare \nHEADS 1\nbranch": ("/g", "", "", False),
    "worktree \nHEAD 9": None,
    "worktree": None,
    "HEAD 7\nbranch lost\nbare": None,
}


def test_env_lines(spark):
    rnd = random.Random(11)
    rows, want = [], set()
    for i in range(120):
        lines = [rnd.choice(sorted(ENV_LINES)) for _ in range(rnd.randint(0, 9))]
        rows.append((f"/r/{i}.env", "\n".join(rnd.choice(BLANKS) + x + rnd.choice(BLANKS) for x in lines)))
        want |= {(f"/r/{i}.env", k, *ENV_LINES[x]) for k, x in enumerate(lines) if ENV_LINES[x]}
    df = spark.createDataFrame(rows, "path string, content_str string").selectExpr("'/r' AS worktree", "path", "content_str", "'env' AS kind")
    assert {(r.path, r.ord, r.field, r.value) for r in env_entries(df).collect()} == want


def test_porcelain_blocks(spark):
    rnd = random.Random(5)
    rows, want = [], []
    for i in range(150):
        blocks = [rnd.choice(sorted(BLOCKS)) for _ in range(rnd.randint(0, 6))]
        # a blank line ends a block; before a "worktree " line it may be missing
        text = ""
        for b in blocks:
            glue = rnd.choice(["\n\n", "\n\r\n", "\n\n\n"] + ["\n"] * b.startswith("worktree "))
            text += (glue if text else rnd.choice(["", "\n"])) + b
        rows.append((i, text + rnd.choice(["", "\n", "\n\n"])))
        want += [(i, *BLOCKS[b]) for b in blocks if BLOCKS[b]]
    df = spark.createDataFrame(rows, "listing_id long, text string")
    assert sorted((r.listing_id, r.path, r.head, r.branch, r.bare) for r in worktrees_from_listing(df).collect()) == sorted(want)
