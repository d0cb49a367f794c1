"""Snapshots of named resources: differences, panels and activity.

``snapshot(name, mtime, size_bytes, owner)``; a panel has a ``snapshot_date`` as well and is kept partitioned by it, so that a
date range reads only its partitions and a date is written anew without the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import last_wins


def diff(old: DataFrame, new: DataFrame, *by: str) -> DataFrame:
    """Rows ``(name, change, old_value, new_value, delta)``; changes are added, removed, modified, grown, shrunk (with a
    positive delta) and owner_changed.  A name listed twice counts as its last row by ``ord`` where there is one.
    ``by`` names columns before the name that must agree too: many snapshots are compared in one join."""
    if not by:
        old, new = (last_wins(x, "name", "ord") if "ord" in x.columns else x for x in (old, new))
    state = F.struct("mtime", "size_bytes", "owner")
    both = old.select(*by, "name", state.alias("a")).join(new.select(*by, "name", state.alias("b")), [*by, "name"], "full_outer")
    size = lambda s: F.coalesce(F.col(f"{s}.size_bytes"), F.lit(0))
    kept = F.col("a").isNotNull() & F.col("b").isNotNull()
    change = lambda test, name, x, y, delta: F.when(test, F.struct(F.lit(name).alias("change"), x.cast("string").alias("old_value"), y.cast("string").alias("new_value"), delta.cast("long").alias("delta")))
    none = F.lit(None)
    found = F.array(
        change(F.col("a").isNull(), "added", none, none, none), change(F.col("b").isNull(), "removed", none, none, none),
        change(kept & ~F.col("a.mtime").eqNullSafe(F.col("b.mtime")), "modified", F.col("a.mtime"), F.col("b.mtime"), none),
        change(kept & (size("b") > size("a")), "grown", size("a"), size("b"), size("b") - size("a")), change(kept & (size("b") < size("a")), "shrunk", size("a"), size("b"), size("a") - size("b")),
        change(kept & ~F.col("a.owner").eqNullSafe(F.col("b.owner")), "owner_changed", F.col("a.owner"), F.col("b.owner"), none),
    )
    return both.select(*by, "name", F.explode(F.filter(found, lambda c: c.isNotNull())).alias("c")).select(*by, "name", "c.*")


def diff_summary(changes: DataFrame) -> DataFrame:
    """Counts per change; changed owners alone don't make ``has_changes``."""
    kinds = ("added", "removed", "modified", "grown", "shrunk")
    row = changes.agg(*[F.count_if(F.col("change") == k).alias(f"{k}_count") for k in kinds])
    return row.withColumn("has_changes", sum((F.col(f"{k}_count") for k in kinds), F.lit(0)) > 0)


def latest_before(panel: DataFrame, date: str) -> DataFrame:
    """The latest snapshot date strictly before a date (compared as text)."""
    return panel.where(F.col("snapshot_date") < date).agg(F.max("snapshot_date").alias("snapshot_date"))


def save_panel(rows: DataFrame, path: str) -> None:
    """Write snapshots to a panel; a date that the rows have replaces that date, the others stay."""
    even = rows.hint("rebalance", "snapshot_date")  # few files a date, and a large date in many
    even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel as ``save_panel`` keeps it; dates are text, and a filter on them reads their partitions alone."""
    fields = [f.simpleString().replace(":", " ", 1) for f in spark.read.parquet(path).schema if f.name != "snapshot_date"]
    return spark.read.schema(", ".join([*fields, "snapshot_date string"])).parquet(path)


def load_range(panel: DataFrame, start: str, end: str) -> DataFrame:
    return panel.where(F.col("snapshot_date").between(start, end))


def dates(panel: DataFrame) -> DataFrame:
    return panel.select("snapshot_date").distinct().orderBy("snapshot_date")


def timeline(panel: DataFrame, name: str, order: str) -> DataFrame:
    """The first row of a resource in each snapshot."""
    rank = F.row_number().over(Window.partitionBy("snapshot_date").orderBy(order))
    return panel.where(F.col("name") == name).withColumn("_rank", rank).where("_rank = 1").drop("_rank").orderBy("snapshot_date")


def activity(changes: DataFrame, since: str, top: int = 10) -> DataFrame:
    """Totals and leaders of ``changes(date, name, change, delta)`` from a date on, as ``(measure, name, value)``."""
    recent = changes.where(F.col("date") >= since)
    total = recent.where("change in ('added', 'removed')").groupBy("change").agg(F.count("*").alias("value")).select(F.concat(F.lit("total_"), "change").alias("measure"), F.lit("").alias("name"), "value")
    modified = recent.where("change = 'modified'").agg(F.count_distinct("name").alias("value")).select(F.lit("total_modified").alias("measure"), F.lit("").alias("name"), "value")
    grown = _leaders(recent.where("change = 'grown'"), F.sum("delta"), top, "growth")
    active = _leaders(recent.where("change = 'modified'"), F.count("*"), top, "active")
    return total.union(modified).union(grown).union(active)


def _leaders(rows: DataFrame, value: Column, top: int, measure: str) -> DataFrame:
    return rows.groupBy("name").agg(value.cast("long").alias("value")).orderBy(F.desc("value"), "name").limit(top).select(F.lit(measure).alias("measure"), "name", "value")


def sync_plan(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """``action`` for each path: added, updated (its content hash differs), unchanged or removed."""
    both = indexed.select("path", F.col("hash").alias("old")).join(current.select("path", F.col("hash").alias("new")), "path", "full_outer")
    action = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return both.select("path", action.alias("action"))


def classify_resource(name: Column, models: tuple[str, ...] = (), datasets: tuple[str, ...] = ()) -> Column:
    """Kind of a directory by known names, words of the name, and capitals."""
    low = F.lower(name)
    return (
        F.when(low.isin(*models) if models else F.lit(False), "model").when(low.isin(*datasets) if datasets else F.lit(False), "dataset")
        .when(low.rlike("model|embedding|bert|word2vec"), "model").when(low.rlike("data|corpus|archive"), "dataset").when(low.rlike("project|code|src"), "project")
        .when(name.rlike("^[A-Z]"), "project").otherwise("directory")
    )


def scan_summary(resources: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts by type, and the owners with most resources."""
    owners = resources.groupBy("owner").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "owner").limit(top)
    return resources.groupBy("resource_type").agg(F.count("*").alias("n")), owners


def enrich(resources: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog columns by name where the catalog has it."""
    return resources.join(catalog, "name", "left")


def to_markdown(resources: DataFrame, category: str = "category") -> DataFrame:
    """One block of text per category with its resources by name."""
    line = F.concat(F.lit("- **"), F.col("name"), F.lit("** ("), F.col("size_bytes").cast("string"), F.lit(" bytes)"))
    rows = resources.groupBy(category).agg(F.array_sort(F.collect_list(line)).alias("lines"), F.count("*").alias("n"))
    return rows.select(category, F.concat(F.lit("## "), F.col(category), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), F.array_join("lines", "\n")).alias("markdown"))
