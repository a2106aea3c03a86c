"""Root containment joins: J1 (every containing root), J2 (longest prefix),
J3 (first actor per root), J8 (target pid), F1 (ignored directories).

A root R contains path P iff P == R or P starts with R + '/'. Equivalently R is
one of P's '/'-cut prefixes (or P itself), and of those only the prefixes with as many
components as some root has count. So containment is an equi-join: no LIKE, no nested
loop, separator-safe by construction, and one join for each number of components that roots
have (two or three of them, as a rule) finds the longest without a group or an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.functions import columns as C
from seepage.functions import constants as K
from seepage.operators.broadcast import bounded_broadcast


def _prefix(path: Column, k: Column) -> Column:
    return F.call_function("substring_index", path, F.lit("/"), k)


def path_prefixes(path: Column) -> Column:
    """All '/'-cut prefixes of the path, the path itself included, '' dropped."""
    n = F.size(F.split(path, "/"))
    pre = F.transform(F.sequence(F.lit(1), n), lambda k: _prefix(path, k))
    return F.filter(pre, lambda x: x != "")


def explode_prefixes(df: DataFrame, path_col: str, out: str = "_anc", keep_array: str | None = None) -> DataFrame:
    """One row per '/'-cut prefix of ``path_col`` (the path itself included).
    ``keep_array`` also keeps the whole prefix array on each row."""
    x = df.where(F.col(path_col).isNotNull()).withColumn("_pre", path_prefixes(F.col(path_col)))
    x = x.select("*", F.explode("_pre").alias(out))
    return x.withColumnRenamed("_pre", keep_array) if keep_array else x.drop("_pre")


def root_paths(roots: DataFrame) -> DataFrame:
    return (roots.select(F.col("path").alias("root"))
                 .where(F.col("root").isNotNull() & (F.col("root") != "")).distinct())


def _components(path: Column) -> Column:
    return F.size(F.split(path, "/"))


#: With more different numbers of components than this, prefixes are exploded instead of one join for each.
MAX_DEPTHS = 24


def measured_roots(roots: DataFrame) -> tuple[DataFrame, bool, list[int]]:
    """(root, depth), broadcast if their measured bytes fit; whether they do; the different depths,
    i.e. numbers of components, deepest first (at most as many as the longest path has)."""
    r = root_paths(roots).withColumn("depth", _components(F.col("root")))
    side, small = bounded_broadcast(r, width=F.octet_length("root") + F.lit(8))
    if not hasattr(side, "_depths"):
        side._depths = sorted((x.depth for x in side.select("depth").distinct().collect()), reverse=True)
    return side, small, side._depths


def owners_of_paths(paths: DataFrame, path_col: str, roots: DataFrame, out: str) -> DataFrame:
    """Beyond the broadcast bound: (path_col, out) for the owned ones of distinct paths, by a shuffle of paths alone."""
    side, _, depths = measured_roots(roots)
    x = _containing(paths.select(path_col).distinct(), path_col, side, depths)
    return x.groupBy(path_col).agg(F.max_by("root", "depth").alias(out))


def owner_root(df: DataFrame, path_col: str, roots: DataFrame, out: str = "owner") -> DataFrame:
    """Add ``out`` = the longest root containing ``path_col`` (and ``out``_base, its
    name); unowned rows drop.

    Roots within the measured bound: for each depth of roots a broadcast join on the path's prefix of
    that many components, and the deepest that hits. Rows stay where they are and as many as
    they were; nothing in a broadcast row grows with the number of roots in a root. Beyond the
    bound the owners of the distinct paths are found by a shuffle of paths, to which ``df`` is joined:
    hand in thin rows then (ids and paths, no contents).
    """
    side, small, depths = measured_roots(roots)
    if small and len(depths) <= MAX_DEPTHS:
        x = df.where(F.col(path_col).isNotNull())
        for d in depths:
            one = side.where(F.col("depth") == d).select(F.col("root").alias(f"_root{d}"))
            x = x.join(F.broadcast(one), _prefix(F.col(path_col), F.lit(d)) == F.col(f"_root{d}"), "left")
        found = F.coalesce(*[F.col(f"_root{d}") for d in depths]) if depths else F.lit(None).cast("string")
        x = x.withColumn(out, found).drop(*[f"_root{d}" for d in depths]).where(F.col(out).isNotNull())
    else:
        by = owners_of_paths(df, path_col, roots, out).withColumnRenamed(path_col, "_path")
        x = df.join(by, df[path_col] == by["_path"]).drop("_path")
    return x.withColumn(out + "_base", C.basename(F.col(out)))


def _containing(df: DataFrame, path_col: str, side: DataFrame, depths: list[int]) -> DataFrame:
    """df with root, depth: a row for each root that contains the path."""
    path = F.col(path_col)
    x = df.where(path.isNotNull())
    if len(depths) > MAX_DEPTHS:
        x = explode_prefixes(x, path_col, "_anc")
    else:
        n = _components(path)
        own = F.array(*[F.when(n >= d, _prefix(path, F.lit(d))) for d in depths] or [F.lit(None).cast("string")])
        x = x.select("*", F.explode(F.filter(own, lambda p: p.isNotNull())).alias("_anc"))
    return x.join(side, x["_anc"] == side["root"]).drop("_anc")


def files_in_roots(files: DataFrame, roots: DataFrame, path_col: str = "path",
                   out: str = "worktree") -> DataFrame:
    """One row per (containing root, file); nested roots each get the file. Beyond the
    broadcast bound ``files`` are shuffled: hand in thin rows then."""
    side, _, depths = measured_roots(roots)
    return _containing(files, path_col, side, depths).drop("depth").withColumnRenamed("root", out)


def in_ignored_dir(root: Column, path: Column, root_base: Column | None = None) -> Column:
    """basename(root) or a directory of the path below root is ignored.
    ``root_base`` may carry the precomputed basename (as J2 adds it)."""
    rel_s = path.substr(F.length(root) + 2, F.length(path))
    parts = F.split(rel_s, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    checked = F.concat(F.array(C.basename(root) if root_base is None else root_base), dirs)
    return F.arrays_overlap(checked, F.array(*[F.lit(d) for d in K.IGNORED_DIRS]))


def actor_per_root(procs: DataFrame, roots: DataFrame) -> DataFrame:
    """Worktree, agent_pid: the first process (listing order) whose cwd's
    longest containing root is the worktree; 0 when none. A pid of 0 says nothing,
    so a later process with a pid counts."""
    p = procs.where(F.col("cwd").isNotNull() & (F.col("cwd") != "") & (F.col("pid") != 0))
    owned = owner_root(p.select("pid", "ord", "cwd"), "cwd", roots, "worktree").drop("worktree_base")
    first = owned.groupBy("worktree").agg(F.min_by("pid", "ord").alias("agent_pid"))
    if measured_roots(roots)[1]:  # one narrower row per root at most, and the roots fit
        first = F.broadcast(first)
    r = root_paths(roots).withColumnRenamed("root", "worktree")
    return (r.join(first, "worktree", "left")
             .select("worktree", F.coalesce("agent_pid", F.lit(0)).cast("bigint").alias("agent_pid")))


def with_target_pid(df: DataFrame, actors: DataFrame, root_col: str = "target_worktree",
                    out: str = "target_agent_pid", small: bool | None = None) -> DataFrame:
    """Look up the root's actor pid (0 when unknown).

    small: whether the actors (one row per root) are known to fit a broadcast,
    as when their roots passed the check; None measures them."""
    a = actors.select(F.col("worktree").alias("_wt"), F.col("agent_pid").alias("_pid"))
    if small is None:
        a = bounded_broadcast(a, width=F.octet_length("_wt") + F.lit(16))[0]
    elif small:
        a = F.broadcast(a)
    return (df.join(a, df[root_col] == a["_wt"], "left")
              .withColumn(out, F.coalesce("_pid", F.lit(0)).cast("bigint"))
              .drop("_wt", "_pid"))
