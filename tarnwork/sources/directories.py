"""Directories as a table, through Spark's Python data source interface.

``spark.read.format("directories").load(path)`` lists a tree that all executors see (a mounted project space): a row for
each directory and file with parent, kind, owner, size and time of change.  Each directory below the root is a
partition of its own, so listing is spread; contents are never read.

Options: ``skip`` (names left out, comma-separated, with all that is below them), ``depth`` (levels below the root, no limit by
default).  Defined cases: what cannot be asked has owner unknown, uid -1, size 0 and no time; links are listed and not followed; a
root that is not there is an empty table; unreadable directories have a row and no entries.
"""

from __future__ import annotations

import os
import pwd
import stat
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, parent string, name string, is_directory boolean, owner_uid int, owner_username string, size_bytes long, mtime timestamp, level int"


def local(path: str) -> str:
    """The mounted path of a plain or ``file:`` one."""
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"not a mounted path: {path}")
    return unquote(at.path) if at.scheme else path


def described(path: str, level: int) -> tuple:
    """A path's row, with what can't be asked as unknown."""
    try:
        found = os.lstat(path)
    except OSError:
        return path, os.path.dirname(path), os.path.basename(path), False, -1, "unknown", 0, None, level
    try:
        owner = pwd.getpwuid(found.st_uid).pw_name
    except KeyError:
        owner = "unknown"
    size = 0 if stat.S_ISDIR(found.st_mode) else found.st_size
    at = datetime.fromtimestamp(found.st_mtime, timezone.utc)
    return path, os.path.dirname(path), os.path.basename(path), stat.S_ISDIR(found.st_mode), found.st_uid, owner, size, at, level


def entries(path: str, skip: frozenset[str]) -> list[str]:
    try:
        return sorted(e.path for e in os.scandir(path) if e.name not in skip)
    except OSError:
        return []


class _Below(InputPartition):
    def __init__(self, path: str, level: int, deep: bool) -> None:
        self.path, self.level, self.deep = path, level, deep


class DirectoryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = local(options["path"]).rstrip("/") or "/"
        self.skip = frozenset(s.strip() for s in options.get("skip", "").split(",") if s.strip())
        self.depth = int(options.get("depth", 1 << 30))

    def partitions(self) -> list[InputPartition]:
        """The root's own row, and what is below each of its entries."""
        if not os.path.lexists(self.root):
            return [_Below("", 0, False)]
        first = entries(self.root, self.skip) if self.depth > 0 else []
        return [_Below(self.root, 0, False), *(_Below(p, 1, True) for p in first)]

    def read(self, partition: _Below) -> Iterator[tuple]:
        if not partition.path:
            return
        held = [(partition.path, partition.level)]
        while held:
            path, level = held.pop()
            row = described(path, level)
            yield row
            if partition.deep and row[3] and level < self.depth:
                held += [(p, level + 1) for p in reversed(entries(path, self.skip))]


class DirectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "directories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DirectoryReader:
        return DirectoryReader(self.options)


def directories(spark: SparkSession, path: str, skip: tuple[str, ...] = (), depth: int | None = None) -> DataFrame:
    """A tree's directories and files."""
    spark.dataSource.register(DirectorySource)
    reader = spark.read.format("directories").option("skip", ",".join(skip))
    return (reader if depth is None else reader.option("depth", depth)).load(path)
