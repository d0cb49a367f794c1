"""Snapshots as they arrive: scan documents to a panel, a change log, inventories and an index, in batches that may be replayed.

A file-source stream lists new scan documents.  A batch is parsed, enriched from a catalog and written to the panel, each date a
partition that is overwritten as a whole; each date that came, and the next one after it, is compared with the date before it and the log's
partition of that date is overwritten; inventories go to the index by content hash.  So every write of a batch gives the
same when it is done again.  A batch's number is marked once all is written, and a marked batch is not done again.

Defined cases: a file with a line that is no scan document, or whose path has no date, is set aside whole in the table of
errors and the rest of the batch goes on; of several scans of a date in a batch the resources are one set, and a name listed twice
counts as its last row; a date that comes again replaces its former rows; a date without changes has one row of
change ``none`` in the log, so that a date that lost its changes is overwritten too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import snapshots as S
from ..operators.registry import last_wins
from ..sources.files import SNAPSHOT
from .files import located, mark, names
from .jobs import IncrementalIndex, run_available

DATE = r"(\d{4}-\d{2}-\d{2})"


class SnapshotIngest:
    """``source`` holds scan documents, one per line (``whole``: one per file); ``chunker`` cuts inventories for the index."""

    def __init__(self, spark: SparkSession, source: str, folder: str, chunker, catalog: DataFrame | None = None, kind: Column | None = None, whole: bool = False) -> None:
        self.spark, self.source, self.folder, self.catalog, self.whole = spark, source.rstrip("/"), folder.rstrip("/"), catalog, whole
        self.kind = kind if kind is not None else S.classify_resource(F.col("name"))
        self.index = IncrementalIndex(spark, f"{self.folder}/index", chunker)

    def _read(self, table: str, schema: str | None = None) -> DataFrame:
        at, files = located(self.spark, f"{self.folder}/{table}")
        if not files.exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}") if schema else self.spark.read.parquet(f"{self.folder}/{table}")

    _PANEL = "name string, mtime string, size_bytes long, owner string, resource_type string, is_valuable boolean, is_active boolean, scan_timestamp string, batch long, snapshot_date string"
    _LOG = "name string, change string, old_value string, new_value string, delta long, batch long, date string"
    _ERRORS = "path string, reason string, batch long"

    def panel(self) -> DataFrame:
        """Resources by ``snapshot_date``, a partition each."""
        return self._read("panel", self._PANEL)

    def changes(self) -> DataFrame:
        """The change log; dates without changes have no rows."""
        return self._read("log", self._LOG).where("change <> 'none'")

    def errors(self) -> DataFrame:
        return self._read("errors", self._ERRORS)

    def batches(self) -> list[int]:
        return sorted(int(n) for n in names(self.spark, f"{self.folder}/batches"))

    def _overwrite(self, rows: DataFrame, table: str, by: str) -> None:
        even = rows.hint("rebalance", by)  # few files a date, and a large date in many
        even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.folder}/{table}")

    def _parsed(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Resources of the files that are whole, and the files that are not with the reason."""
        schema = f"{SNAPSHOT}, _broken string"
        rows = batch.where(F.length(F.trim("value")) > 0).select("path", F.regexp_extract("path", DATE, 1).alias("snapshot_date"), F.from_json("value", schema, {"columnNameOfCorruptRecord": "_broken"}).alias("doc"))
        reason = F.when(F.col("snapshot_date") == "", "no date in the path").when(F.col("doc._broken").isNotNull() | F.col("doc.resources").isNull(), "no scan document")
        told = rows.withColumn("reason", reason)
        bad = told.where("reason is not null").groupBy("path").agg(F.min("reason").alias("reason"))
        good = told.join(bad.select("path"), "path", "left_anti")
        one = good.select("snapshot_date", "doc.scan_timestamp", "path", F.posexplode("doc.resources").alias("ord", "r")).where("r.name is not null")
        one = one.select("snapshot_date", F.col("r.name").alias("name"), F.struct("scan_timestamp", "path", "ord", F.col("r.mtime").alias("mtime"), F.col("r.size_bytes").alias("size_bytes"), F.col("r.owner_username").alias("owner"), F.col("r.resource_type").alias("resource_type")).alias("r"))
        last = one.groupBy("snapshot_date", "name").agg(F.max("r").alias("r"))
        return last.select("snapshot_date", "name", "r.mtime", "r.size_bytes", "r.owner", "r.resource_type", "r.scan_timestamp"), bad

    def _enriched(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("resource_type", F.coalesce("resource_type", self.kind))
        if self.catalog is None:
            return rows.withColumn("is_valuable", F.lit(None).cast("boolean")).withColumn("is_active", F.lit(None).cast("boolean"))
        return S.enrich(rows, last_wins(self.catalog, "name", "ord").drop("ord") if "ord" in self.catalog.columns else self.catalog)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Do a batch of ``(path, value)`` lines; a batch that is marked is left alone."""
        if str(number) in names(self.spark, f"{self.folder}/batches"):
            return
        found, bad = self._parsed(batch)
        bad.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/errors/part={number}")
        rows = self._enriched(found).withColumn("batch", F.lit(number).cast("long"))
        columns = [c.strip().split(" ")[0] for c in self._PANEL.split(",")]
        self._overwrite(rows.select(*columns), "panel", "snapshot_date")
        panel = self.panel()
        came = panel.where(F.col("batch") == number).select("snapshot_date").distinct()
        self._log(panel, came, number)
        self._index(panel.join(F.broadcast(came), "snapshot_date"))  # dates: one row a day
        mark(self.spark, f"{self.folder}/batches", str(number))

    def _log(self, panel: DataFrame, came: DataFrame, number: int) -> None:
        """Compare each date that came, and the one after it, with the one before it."""
        days = panel.select("snapshot_date").distinct().join(came.withColumn("came", F.lit(True)), "snapshot_date", "left")
        order = Window.orderBy("snapshot_date")  # dates: one row a day
        days = days.select("snapshot_date", F.lag("snapshot_date").over(order).alias("before"), (F.coalesce("came", F.lit(False)) | F.coalesce(F.lag("came").over(order), F.lit(False))).alias("due"))
        due = days.where("due and before is not null").select(F.col("snapshot_date").alias("date"), "before")
        new = panel.join(F.broadcast(due.select("date")), F.col("snapshot_date") == F.col("date"))
        old = panel.join(F.broadcast(due), F.col("snapshot_date") == F.col("before"))
        found = S.diff(old.drop("snapshot_date", "before"), new.drop("snapshot_date"), "date")
        none = due.join(found.select("date").distinct(), "date", "left_anti").select("date", F.lit("").alias("name"), F.lit("none").alias("change"), *(F.lit(None).cast(t).alias(c) for c, t in (("old_value", "string"), ("new_value", "string"), ("delta", "long"))))
        self._overwrite(found.unionByName(none).withColumn("batch", F.lit(number).cast("long")), "log", "date")

    def _index(self, rows: DataFrame) -> None:
        text = S.to_markdown(rows.withColumn("category", F.concat_ws(" ", "snapshot_date", "resource_type")))
        self.index.apply(text.select(F.concat(F.lit("inventory/"), F.replace("category", F.lit(" "), F.lit("/"))).alias("path"), F.col("markdown").alias("text")))

    def run(self) -> None:
        """Take in what has come since the last run."""
        lines = self.spark.readStream.option("wholetext", self.whole).option("recursiveFileLookup", True).text(self.source)
        run_available(lines.select(F.col("_metadata.file_path").alias("path"), "value"), self.apply, f"{self.folder}/state")

    def status(self) -> DataFrame:
        """One row: snapshots, resources, changes, chunks, files set aside."""
        panel = self.panel().agg(F.count_distinct("snapshot_date").alias("snapshots"), F.count("*").alias("resources"))
        row = panel.join(self.changes().agg(F.count("*").alias("changes"))).join(self.errors().agg(F.count("*").alias("errors")))  # one row each
        return row.join(self.index.files().agg(F.count("*").alias("inventories")))

    def reindex(self) -> None:
        """Make all inventories anew, as after a change of their form."""
        self.index.forget()
        self._index(self.panel())
