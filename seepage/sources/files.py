"""S1 read_files(roots): a Python Data Source over file trees.

Spark's file sources skip names starting with '.' or '_' (so '.env' would
never be read). This source lists and reads the trees on the executors. The driver only looks for
places to cut: it takes directories breadth first, one at a time, until there are about
``splits`` pieces, and reads no more than ``splits`` + 1 names of any (at most splits * (splits + 1)
in all, whatever the tree holds). A directory with more names than that becomes ``splits`` pieces
by the hash of its names: each task lists the directory itself and takes the files and subtrees whose
names fall to it, so a flat directory of any size is read by many tasks. Ignored directories are
pruned before descending, the name filter runs before a file is opened, unreadable entries
are skipped, and symlinked directories are not followed. One row per (root, file): nested roots
each see the file, as when each root is walked separately.

    spark.dataSource.register(SecretTreeSource)
    spark.read.format("secret_tree").option("roots", '["/a", "/b"]').load()
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from collections import deque
from itertools import islice

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seepage.functions.columns import glob_alternation
from seepage.functions.constants import IGNORED_DIRS

_NAME_RE = re.compile("(?s)" + glob_alternation() + r"\Z")


class TreePartition(InputPartition):
    """The subtree of ``top`` (deep) or only the files directly in it; of the names in ``top``
    those whose hash leaves ``part`` modulo ``parts``."""

    def __init__(self, root: str, top: str, deep: bool, part: int = 0, parts: int = 1):
        self.root, self.top, self.deep, self.part, self.parts = root, top, deep, part, parts

    def has(self, name: str) -> bool:
        return self.parts == 1 or zlib.crc32(os.fsencode(name)) % self.parts == self.part


class SecretTreeReader(DataSourceReader):
    def __init__(self, options):
        self.roots = [r for r in json.loads(options.get("roots", "[]")) if r]
        self.all_names = options.get("names", "secret") == "all"
        self.splits = int(options.get("splits", "64"))

    def partitions(self):
        parts = []
        for root in self.roots:
            if os.path.basename(root.rstrip("/")) in IGNORED_DIRS:
                continue
            own, todo = [], deque([root])
            while todo and len(own) + len(todo) < self.splits:
                top = todo.popleft()
                found = self._some(top)
                if len(found) > self.splits:
                    own += [TreePartition(root, top, True, i, self.splits) for i in range(self.splits)]
                else:
                    own.append(TreePartition(root, top, False))
                    todo.extend(sorted(e.path for e in found if self._descends(e)))
            parts += own + [TreePartition(root, d, True) for d in todo]
        return parts or [TreePartition("", "", False)]

    def _some(self, d: str) -> list[os.DirEntry]:
        """At most splits + 1 entries, in the order the file system gives them."""
        try:
            with os.scandir(d) as entries:
                return list(islice(entries, self.splits + 1))
        except OSError:
            return []

    def _descends(self, e: os.DirEntry) -> bool:
        """A directory to descend into: no link, no ignored name."""
        try:
            return e.name not in IGNORED_DIRS and e.is_dir(follow_symlinks=False)
        except OSError:
            return False

    def _want(self, name: str) -> bool:
        return self.all_names or _NAME_RE.match(name) is not None

    def _read(self, root: str, path: str):
        try:
            with open(path, "rb") as fh:
                return (root, path, fh.read())
        except OSError:
            return None

    def paths(self, partition: TreePartition):
        """The wanted files of a piece."""
        todo = [partition.top] if partition.root else []
        while todo:
            d = todo.pop()
            try:
                with os.scandir(d) as found:
                    entries = sorted(found, key=lambda e: e.name)
            except OSError:
                continue
            if d == partition.top:
                entries = [e for e in entries if partition.has(e.name)]
            yield from (e.path for e in entries if (e.is_symlink() or not e.is_dir()) and self._want(e.name))
            if partition.deep:
                todo += [e.path for e in reversed(entries) if self._descends(e)]

    def read(self, partition: TreePartition):
        for path in self.paths(partition):
            row = self._read(partition.root, path)
            if row:
                yield row


class SecretTreeSource(DataSource):
    @classmethod
    def name(cls):
        return "secret_tree"

    def schema(self):
        return "worktree string, path string, content binary"

    def reader(self, schema):
        return SecretTreeReader(self.options)


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_files(spark, roots: list[str], splits: int = 64):
    """(worktree, path, content) for every secret-named file under the roots, each cut into about so many tasks."""
    spark.dataSource.register(SecretTreeSource)
    return spark.read.format("secret_tree").option("roots", json.dumps(list(roots))).option("splits", splits).load()
