"""A folder as a Spark data source that lists level by level.

Planning lists the first levels, until there are enough folders to share out; tasks go on from there.
A folder that the policy ignores is never opened. Links are followed only if the policy says so, and
never out of the root: a link that isn't followed, or that leaves it, is a row with its reason, as is a
folder below the greatest depth. Content is read for files up to the size limit only.
"""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "project_folder"
SCHEMA = "path string, absolute_path string, size_bytes bigint, modified_at timestamp, skip_reason string, content binary"
#: Subtrees that planning looks for, at least, before tasks take over.
SHARES = 64
ESCAPE, DEEP, UNREADABLE = "symlink_escape", "too_deep", "unreadable"


def inside(root: str, path: str) -> bool:
    """``path``, links followed, lies in the real folder ``root`` or is it."""
    try:
        return os.path.commonpath([root, os.path.realpath(path)]) == root
    except ValueError:  # another drive
        return False


@dataclass
class Rules:
    """What a listing needs of a scan policy."""

    root: str
    ignored_directories: frozenset[str]
    ignored_files: tuple[str, ...]
    max_bytes: int
    max_depth: int
    follow_symlinks: bool

    def entries(self, folder: str, depth: int, above: tuple[str, ...] = ()) -> Iterator[tuple[str, str, str | None]]:
        """(kind, path, reason) of what lies directly in ``folder``: ``folder`` to go on with, ``file`` to read, or ``skip``."""
        try:
            with os.scandir(folder) as found:
                listed = sorted(found, key=lambda e: e.name)
        except OSError:
            if depth:
                yield "skip", folder, UNREADABLE
            return
        for entry in listed:
            link = entry.is_symlink()
            if link and not (self.follow_symlinks and inside(self.root, entry.path)):
                yield "skip", entry.path, ESCAPE
            elif entry.is_dir(follow_symlinks=self.follow_symlinks):
                if entry.name in self.ignored_directories:
                    continue
                if depth + 1 > self.max_depth:
                    yield "skip", entry.path, DEEP
                elif not link or os.path.realpath(entry.path) not in above:  # a link to a folder above would never end
                    yield "folder", entry.path, None
            elif entry.is_file(follow_symlinks=self.follow_symlinks) and not any(fnmatch.fnmatch(entry.name, p) for p in self.ignored_files):
                yield "file", entry.path, None

    def row(self, path: str, reason: str | None) -> tuple:
        relative = os.path.relpath(path, self.root).replace(os.sep, "/")
        if reason:
            return relative, path, 0, None, reason, None
        try:
            stat = os.stat(path)
            at, content = datetime.fromtimestamp(stat.st_mtime, UTC), None
            if stat.st_size <= self.max_bytes:
                with open(path, "rb") as f:
                    content = f.read()
        except OSError:
            return relative, path, 0, None, UNREADABLE, None
        return relative, path, stat.st_size, at, None, content


@dataclass
class Share(InputPartition):
    """Files and folders, each with its depth, for one task."""

    files: list[tuple[str, str | None]] = field(default_factory=list)
    folders: list[tuple[str, int]] = field(default_factory=list)


class Reader(DataSourceReader):
    def __init__(self, rules: Rules, shares: int):
        self.rules, self.shares = rules, shares

    def _above(self, folder: str) -> tuple[str, ...]:
        """Real paths of a folder and of those above it up to the root."""
        real = [os.path.realpath(folder)]
        while folder != self.rules.root:
            folder = os.path.dirname(folder)
            real.append(os.path.realpath(folder))
        return tuple(real)

    def partitions(self) -> list[Share]:
        level, depth, files = [self.rules.root], 0, []
        while level and len(level) < self.shares:
            below: list[str] = []
            for folder in level:
                for kind, path, reason in self.rules.entries(folder, depth, self._above(folder)):
                    below.append(path) if kind == "folder" else files.append((path, reason))
            level, depth = below, depth + 1
        out = [Share() for _ in range(max(1, self.shares if level else min(self.shares, -(-len(files) // 100))))]
        for i, file in enumerate(files):
            out[i % len(out)].files.append(file)
        for i, folder in enumerate(level):
            out[i % len(out)].folders.append((folder, depth))
        return out

    def read(self, partition: Share) -> Iterator[tuple]:
        for path, reason in partition.files:
            yield self.rules.row(path, reason)
        left = list(partition.folders)
        while left:
            folder, depth = left.pop()
            for kind, path, reason in self.rules.entries(folder, depth, self._above(folder)):
                if kind == "folder":
                    left.append((path, depth + 1))
                else:
                    yield self.rules.row(path, reason)


class ProjectFolder(DataSource):
    """``spark.read.format("project_folder").option("root", ...).option("policy", <JSON>)``"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        policy = json.loads(self.options["policy"])
        root = os.path.realpath(self.options["root"])
        ignored = frozenset(policy["ignored_directories"]) | frozenset(policy["extra_ignored_directories"])
        rules = Rules(root, ignored, tuple(policy["ignored_files"]), policy["max_bytes"], policy["max_depth"], policy["follow_symlinks"])
        return Reader(rules, int(self.options.get("shares", SHARES)))
