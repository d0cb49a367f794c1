"""Streaming forms of the incremental operators.

State lives in the session's ``spark.checkpoint.dir``, or in a folder of the warehouse where that is unset; both are
shared by driver and executors.  Results are written beside the old ones and count once they are complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import content_hash, tokens
from ..operators.snapshots import diff
from .files import sweep_at_end


def place(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read back: the lineage ends there.  The table goes when the driver ends."""
    folder = place(rows.sparkSession, name)
    rows.write.parquet(folder)
    sweep_at_end(rows.sparkSession, folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _folder(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str, mark: str = "_SUCCESS") -> list[int]:
    """The complete versions ``v1, v2, ...`` below a folder, in order."""
    path, files = _folder(spark, folder)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    found = [int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()]
    return sorted(v for v in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{v}/{mark}")))


def _remove(spark: SparkSession, folder: str) -> None:
    path, files = _folder(spark, folder)
    files.delete(path, True)


def run_available(rows: DataFrame, each: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    """Process what is there, batch by batch, and stop."""
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table (a file or a folder) as a stream; times without a zone become the session's."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{path}*")
    return rows.select(*[F.col(f.name).cast("timestamp") if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema.fields])


def window_counts(events: DataFrame, stamp: str, key: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per key and event-time window; events later than ``late`` are dropped in append mode."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def keep_latest(rows: DataFrame, target: str, mode: str = "complete") -> None:
    """Write a complete-mode result batch by batch, each beside the one before, which then goes; see ``latest``."""
    spark = rows.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/v{number + 1}")
        for old in versions(spark, target)[:-1]:
            _remove(spark, f"{target}/v{old}")

    run_available(rows, each, target + "-state", mode)


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The last complete result of ``keep_latest``."""
    return spark.read.parquet(f"{target}/v{versions(spark, target)[-1]}")


class IncrementalIndex:
    """Document chunks kept up to date by content hash: unchanged files are skipped, changed ones replaced.

    The folder is a log: each version holds only the files and chunks that it adds and the paths that it removes, and
    counts once its mark is there.  An index over a folder goes on with the versions that it finds.
    """

    _FILES = "path string, hash string, removed boolean, num_chunks long, indexed_at timestamp, version int"

    def __init__(self, spark: SparkSession, folder: str, chunker: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.folder, self.chunker = spark, folder, chunker

    def _at(self, version: int, table: str) -> str:
        return f"{self.folder}/v{version}/{table}"

    @property
    def version(self) -> int:
        return max(versions(self.spark, self.folder, "_done"), default=0)

    def _logged(self) -> DataFrame:
        """The last entry of each path, removed ones too."""
        found = versions(self.spark, self.folder, "_done")
        if not found:
            return self.spark.createDataFrame([], self._FILES)
        rows = self.spark.read.schema(self._FILES).parquet(*[self._at(v, "files") for v in found])
        return rows.groupBy("path").agg(F.max_by(F.struct("hash", "removed", "num_chunks", "indexed_at", "version"), "version").alias("f")).select("path", "f.*")

    def files(self) -> DataFrame:
        """``path, hash`` of what is indexed."""
        return self._logged().where("not removed").select("path", "hash")

    def chunks(self) -> DataFrame:
        """The chunks of what is indexed."""
        found = versions(self.spark, self.folder, "_done")
        parts = [self.spark.read.parquet(self._at(v, "chunks")).withColumn("version", F.lit(v)) for v in found]
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        return rows.join(self._logged().where("not removed").select("path", "version"), ["path", "version"]).drop("version")

    def _commit(self, files: DataFrame, chunks: DataFrame) -> None:
        new = self.version + 1
        chunks.write.mode("overwrite").parquet(self._at(new, "chunks"))
        made = self.spark.read.parquet(self._at(new, "chunks")).groupBy("path").agg(F.count("*").alias("num_chunks"))
        rows = files.join(made, "path", "left").select("path", "hash", "removed", F.coalesce("num_chunks", F.lit(0).cast("long")).alias("num_chunks"), F.current_timestamp().alias("indexed_at"), F.lit(new).alias("version"))
        rows.write.mode("overwrite").parquet(self._at(new, "files"))
        path, where = _folder(self.spark, f"{self.folder}/v{new}/_done")
        where.create(path, True).close()

    def apply(self, batch: DataFrame, _: int = 0) -> None:
        """Upsert ``batch(path, text[, mtime])``; of several texts of a path the latest counts, or the one of smallest hash."""
        stamp = F.col("mtime") if "mtime" in batch.columns else F.lit(0)
        hashed = batch.select("path", "text", content_hash(F.col("text")).alias("hash"), stamp.alias("at"))
        last = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("at"), "hash"))).where("rank = 1")
        changed = last.join(self.files().select("path", F.col("hash").alias("old")), "path", "left").where("old is null or old <> hash")
        self._commit(changed.select("path", "hash", F.lit(False).alias("removed")), self.chunker(changed.select("path", "text")))

    def remove(self, paths: DataFrame) -> None:
        if not self.version:
            return
        gone = self.files().join(paths.select("path").distinct(), "path", "left_semi")
        self._commit(gone.select("path", "hash", F.lit(True).alias("removed")), self.chunks().limit(0))

    def status(self, last: int = 10) -> DataFrame:
        """One row: the numbers of files and chunks, the time of the last change and the files indexed last."""
        held = self._logged().where("not removed")
        recent = held.orderBy(F.desc("indexed_at"), "path").limit(last).agg(F.array_sort(F.collect_list(F.struct("path", "num_chunks"))).alias("files"))
        return held.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("num_chunks"), F.lit(0)).alias("total_chunks"), F.max("indexed_at").alias("updated_at")).join(F.broadcast(recent))  # one row

    def export(self, path: str, text: str = "chunk", order: tuple[str, ...] = ("path", "chunk_index")) -> None:
        """The chunks in order with their tokens, for search."""
        self.chunks().withColumn("tokens", tokens(F.col(text))).sort(*order).write.mode("overwrite").parquet(path)

    def compact(self) -> None:
        """Write all that is indexed as one version and drop those before it."""
        old = versions(self.spark, self.folder, "_done")
        if old:
            self._commit(self.files().withColumn("removed", F.lit(False)), self.chunks())
            for version in old:
                _remove(self.spark, f"{self.folder}/v{version}")

    def forget(self) -> None:
        """An empty index."""
        _remove(self.spark, self.folder)

    def reindex(self, batch: DataFrame) -> None:
        """Forget everything and index the batch."""
        self.forget()
        self.apply(batch)


def daily_diff(spark: SparkSession, snapshots: DataFrame, log: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that compares each new snapshot date with the latest one before it; a date's changes are a partition of
    the log, so a batch that is replayed overwrites what it wrote."""
    def each(batch: DataFrame, _: int) -> None:
        for (day,) in sorted(batch.select("snapshot_date").distinct().collect()):  # dates of one batch
            before = snapshots.where(F.col("snapshot_date") < day).agg(F.max("snapshot_date")).first()[0]
            if before is not None:
                changes = diff(snapshots.where(F.col("snapshot_date") == before), batch.where(F.col("snapshot_date") == day))
                changes.write.mode("overwrite").parquet(f"{log}/date={day}")

    return each


THREADS = "user_id long, messages long, started timestamp, last timestamp, closed boolean"


def threads(events: DataFrame, idle_ms: int = 24 * 3600 * 1000, late: str = "1 hour") -> DataFrame:
    """Per-user threads that close after ``idle_ms`` of event time without activity; ``events(user_id, ts)``."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["user_id", "messages", "started", "last", "closed"]
        if state.hasTimedOut:
            n, first, last = state.get
            state.remove()
            yield pd.DataFrame([(key[0], n, datetime.fromtimestamp(first), datetime.fromtimestamp(last), True)], columns=columns)
            return
        stamps = sorted(x.timestamp() for frame in frames for x in frame["ts"])
        out = []
        n, first, last = state.get if state.exists else (0, stamps[0], stamps[0])
        for at in stamps:
            if n and (at - last) * 1000 > idle_ms:
                out.append((key[0], n, datetime.fromtimestamp(first), datetime.fromtimestamp(last), True))
                n, first = 0, at
            n, last = n + 1, max(last, at)
        state.update((n, first, last))
        state.setTimeoutTimestamp(max(int(last * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        out.append((key[0], n, datetime.fromtimestamp(first), datetime.fromtimestamp(last), False))
        yield pd.DataFrame(out, columns=columns)

    keyed = events.withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(step, THREADS, "n long, first double, last double", "append", GroupStateTimeout.EventTimeTimeout)


class TextAccumulator:
    """Gathers streamed text and flushes when at least ``seconds`` have passed and ``characters`` are held."""

    def __init__(self, seconds: float = 0.5, characters: int = 50, clock: Callable[[], float] | None = None) -> None:
        import time

        self.seconds, self.characters, self.clock = seconds, characters, clock or time.monotonic
        self.held, self.last = "", self.clock()

    def add(self, text: str) -> str | None:
        self.held += text
        if len(self.held) >= self.characters and self.clock() - self.last >= self.seconds:
            return self.flush()
        return None

    def flush(self) -> str:
        out, self.held, self.last = self.held, "", self.clock()
        return out
