"""Randomized parity of the root joins against the plain definition:
root contains path iff path == root or path starts with root + '/'."""

import random

from seepage.operators.roots import files_in_roots, in_ignored_dir, owner_root
from pyspark.sql import functions as F

from seepage.functions.constants import IGNORED_DIRS


def contains(root, path):
    return path == root or path.startswith(root + "/")


def test_owner_and_containment_random(spark):
    rnd = random.Random(17)
    parts = ["a", "b", "bc", "b-1", "b-10", "build", ".git", "src", "x.txt"]
    def rand_path(k):
        return "/" + "/".join(rnd.choice(parts) for _ in range(k))
    roots = sorted({rand_path(rnd.randint(1, 3)) for _ in range(25)})
    paths = [rand_path(rnd.randint(1, 5)) for _ in range(300)] + roots[:5]
    rdf = spark.createDataFrame([(r,) for r in roots], "path string")
    pdf = spark.createDataFrame(list(enumerate(paths)), "id long, path string")
    got = {r.id: r.owner for r in owner_root(pdf, "path", rdf).collect()}
    want = {}
    for i, p in enumerate(paths):
        hits = [r for r in roots if contains(r, p)]
        if hits:
            want[i] = max(hits, key=len)
    assert got == want
    got_all = sorted((r.worktree, r.id) for r in files_in_roots(pdf, rdf).collect())
    want_all = sorted((r, i) for i, p in enumerate(paths) for r in roots if contains(r, p))
    assert got_all == want_all
    # F1 on the owner: basename(root) or a directory below it is ignored
    own = owner_root(pdf, "path", rdf).select(
        "id", in_ignored_dir(F.col("owner"), F.col("path"), F.col("owner_base")).alias("ign")).collect()
    for r in own:
        p, root = paths[r.id], want[r.id]
        dirs = p[len(root) + 1:].split("/")[:-1] if p != root else []
        assert r.ign == (root.rstrip("/").split("/")[-1] in IGNORED_DIRS or any(d in IGNORED_DIRS for d in dirs))
