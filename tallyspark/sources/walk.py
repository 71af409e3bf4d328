"""A Spark data source that walks folders: which files and repositories lie below roots, read on executors.

Options: ``roots`` (a JSON list of folders), ``names`` (a regular expression of file names to take), ``head`` (bytes of each
taken file to bring, at most 128 KiB), ``prune`` (a JSON list of folder names to leave out). Each folder directly below a
root is a partition of its own, so a wide tree is walked by many tasks. Links to folders are never followed; one that leads
out of its root is told as ``symlink-escape``, and a file whose real path lies outside its root isn't read.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD = 128 << 10
#: Folders that hold builds, caches and packages, never repositories of one's own.
PRUNED = (
    ".angular", ".build", ".cache", ".dart_tool", ".gradle", ".mypy_cache", ".next", ".nuxt", ".parcel-cache", ".pnpm",
    ".pytest_cache", ".ruff_cache", ".svelte-kit", ".tox", ".turbo", ".venv", ".yarn", "DerivedData", "Pods", "__pycache__",
    "bower_components", "build", "coverage", "dist", "node_modules", "out", "target", "vendor", "venv",
)
SCHEMA = "root string, path string, kind string, size long, modified_ms long, head binary, common string"


def within(root: str, path: str) -> bool:
    return path == root or path.startswith(root.rstrip("/") + "/")


def common_dir(folder: str) -> str | None:
    """The real folder that holds a repository's objects: of a worktree that of the repository it belongs to."""
    marker = os.path.join(folder, ".git")
    try:
        if os.path.isdir(marker):
            own = os.path.realpath(marker)
        else:
            with open(marker, encoding="utf-8") as f:
                said = f.read(4096).strip()
            if not said.startswith("gitdir:"):
                return None
            own = os.path.realpath(os.path.join(folder, said[len("gitdir:") :].strip()))
        pointer = os.path.join(own, "commondir")
        if os.path.isfile(pointer):
            with open(pointer, encoding="utf-8") as f:
                own = os.path.realpath(os.path.join(own, f.read(4096).strip()))
        return own if os.path.isdir(own) else None
    except (OSError, UnicodeDecodeError):
        return None


class Folder(InputPartition):
    def __init__(self, root: str, path: str, deep: bool):
        super().__init__(None)
        self.root, self.path, self.deep = root, path, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = [os.path.realpath(r) for r in json.loads(options["roots"])]
        self.names, self.head = re.compile(options.get("names", "$^")), min(int(options.get("head", 0)), HEAD)
        self.prune = frozenset(json.loads(options.get("prune", "[]")))

    def partitions(self):
        out = []
        for root in sorted(set(self.roots)):
            out.append(Folder(root, root, False))
            try:
                with os.scandir(root) as entries:
                    out += [Folder(root, e.path, True) for e in sorted(entries, key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and e.name not in self.prune and e.name != ".git"]
            except OSError:
                pass  # the partition of the root tells it
        return out

    def _file(self, root: str, entry: os.DirEntry):
        real = os.path.realpath(entry.path)
        if not within(root, real):
            return (root, entry.path, "symlink-escape", None, None, None, None)
        try:
            told, head = os.stat(real), None
            if self.head:
                with open(real, "rb") as f:
                    head = f.read(self.head)
        except OSError:
            return (root, entry.path, "unreadable", None, None, None, None)
        return (root, real, "file", told.st_size, told.st_mtime_ns // 1_000_000, head, None)

    def read(self, partition):
        root, todo = partition.root, [partition.path]
        while todo:
            folder = todo.pop()
            marker = os.path.join(folder, ".git")
            if os.path.islink(marker):
                yield (root, folder, "symlink-escape", None, None, None, None)
            elif os.path.exists(marker):
                yield (root, folder, "repository", None, None, None, common_dir(folder))
            try:
                with os.scandir(folder) as listed:
                    entries = sorted(listed, key=lambda e: e.name)
            except OSError:
                yield (root, folder, "unreadable", None, None, None, None)
                continue
            for e in entries:
                if e.name == ".git" or e.name in self.prune:
                    continue
                if e.is_dir(follow_symlinks=False):
                    if partition.deep:
                        todo.append(e.path)
                elif e.is_symlink() and (os.path.isdir(e.path) or not os.path.exists(e.path)):
                    if not within(root, os.path.realpath(e.path)) or not os.path.exists(e.path):
                        yield (root, e.path, "symlink-escape", None, None, None, None)
                elif self.names.search(e.name):
                    yield self._file(root, e)


class Walk(DataSource):
    @classmethod
    def name(cls):
        return "ledger_walk"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def files(spark: SparkSession, roots: list[str], names: str, head: int = 0, prune: tuple[str, ...] = ()):
    spark.dataSource.register(Walk)
    return spark.read.format("ledger_walk").options(roots=json.dumps(roots), names=names, head=head, prune=json.dumps(prune)).load()
