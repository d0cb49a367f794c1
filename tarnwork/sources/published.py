"""Tables that are read while their sources change: manifests, versions and a pointer that moves in one step.

A manifest lists a source's files with length and time of change.  A watched table keeps what it loaded as a version
of its own and a small pointer names the one that counts; when the manifest differs, a new version is written beside the old one
and the pointer moves.  A reader that began before goes on with the files it began with; ``sweep`` removes versions that no
one needs any more.

Defined cases: a source that is not there is an empty manifest, and what was loaded before stays; a load that fails
leaves the pointer where it was; two writers never share a version's folder.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.files import located, names, read_text, remove, write_text

MANIFEST = "path string, length long, mtime timestamp"


def manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, length, mtime)`` of the files at or below the paths, without their contents."""
    out = spark.createDataFrame([], MANIFEST)
    for path in paths:
        at, files = located(spark, path)
        if files.exists(at):
            rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            out = out.unionByName(rows.select("path", "length", F.col("modificationTime").alias("mtime")))
    return out


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change)`` of two manifests: added, removed or changed files."""
    both = old.select("path", F.struct("length", "mtime").alias("a")).join(new.select("path", F.struct("length", "mtime").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


class Published:
    """Versions of a table below a folder; ``_current`` names the one that counts."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def current(self) -> str | None:
        told = read_text(self.spark, f"{self.folder}/_current")
        return told.strip() if told else None

    def publish(self, **tables: DataFrame) -> str:
        """Write the tables as a new version, then let the pointer name it."""
        version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        for name, rows in tables.items():
            rows.write.parquet(f"{self.folder}/{version}/{name}")
        write_text(self.spark, f"{self.folder}/_current", version)
        return version

    def table(self, name: str, version: str | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise LookupError(f"nothing is published at {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{version}/{name}")

    def versions(self) -> list[str]:
        return [n for n in names(self.spark, self.folder) if n.startswith("v-")]

    def sweep(self, keep: int = 2) -> list[str]:
        """Remove all but the last ``keep`` versions; the one that counts stays."""
        old = [v for v in self.versions()[: -keep or None] if v != self.current()]
        for version in old:
            remove(self.spark, f"{self.folder}/{version}")
        return old


class Watched:
    """A table loaded from files that may change.

    ``load(spark, source)`` makes the table; it is asked again only if the source's manifest differs from that of the version
    that counts, and at most once in ``interval`` seconds.
    """

    def __init__(self, spark: SparkSession, source: str, load: Callable[[SparkSession, str], DataFrame], folder: str, interval: float = 0.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.spark, self.source, self.load, self.store = spark, source, load, Published(spark, folder)
        self.interval, self.clock, self.checked = interval, clock, -float("inf")

    def table(self) -> DataFrame:
        """The rows that count now; the frame keeps to them whatever is published later."""
        if self.store.current() is None:
            self.force_reload()
        return self.store.table("rows")

    def changes(self) -> DataFrame:
        """What differs between the source as it is and as it was loaded."""
        now = manifest(self.spark, self.source)
        old = self.store.table("manifest") if self.store.current() else now.limit(0)
        return differences(old, now)

    def reload_if_changed(self) -> dict | None:
        """Old and new counts if the source had changed; nothing if not, if it is gone, or if asked too soon."""
        now = self.clock()
        if now - self.checked < self.interval:
            return None
        self.checked = now
        at, files = located(self.spark, self.source)
        if not files.exists(at) or self.changes().isEmpty():
            return None
        return self.force_reload()

    def force_reload(self) -> dict:
        """Load anew and return old and new counts."""
        before = self.store.table("rows").count() if self.store.current() else 0
        self.spark.catalog.refreshByPath(self.source)
        # The manifest is written first: what changes while rows are read counts as changed next time.
        self.store.publish(manifest=manifest(self.spark, self.source), rows=self.load(self.spark, self.source))
        return {"status": "reloaded", "previous": before, "current": self.store.table("rows").count()}
