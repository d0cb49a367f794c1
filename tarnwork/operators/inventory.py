"""Resources of a catalog or a scan: filters, summaries, contents and what is not indexed yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_type(rows: DataFrame, kind: str, column: str = "resource_type") -> DataFrame:
    return rows.where(F.col(column) == kind)


def owned_by(rows: DataFrame, owner: str, column: str = "owner_username") -> DataFrame:
    return rows.where(F.col(column) == owner)


def valuable(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("is_valuable", F.lit(False)))


def active(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("is_active", F.lit(False)))


def entry(rows: DataFrame, value, column: str = "id") -> DataFrame:
    """The row of one key."""
    return rows.where(F.col(column) == value).limit(1)


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Totals, valuable and active ones, and counts per type, over all rows or per ``by``."""
    per = rows.groupBy(*by, F.coalesce("resource_type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("is_valuable", F.lit(False))).alias("v"), F.count_if(F.coalesce("is_active", F.lit(False))).alias("a"))
    kinds = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n"))))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return per.groupBy(*by).agg(total("n")("total_resources"), total("v")("valuable"), total("a")("active"), kinds.alias("by_type"))


def current_stats(snapshots: DataFrame) -> DataFrame:
    """The summary of the latest ``snapshot_date``; nothing without snapshots."""
    latest = snapshots.agg(F.max("snapshot_date").alias("snapshot_date"))
    return summary(snapshots.join(F.broadcast(latest), "snapshot_date"), "snapshot_date")  # one row


def contents(listing: DataFrame) -> DataFrame:
    """``subdirectory_count, file_count`` of each directory of ``listing(path, parent, is_directory)``."""
    return listing.groupBy("parent").agg(F.count_if("is_directory").alias("subdirectory_count"), F.count_if(~F.col("is_directory")).alias("file_count"))


def owners(listing: DataFrame, accounts: DataFrame) -> DataFrame:
    """``listing(owner_uid)`` with ``owner_username`` of ``accounts(uid, username)``; unknown owners are unknown and -1."""
    names = accounts.select(F.col("uid").alias("owner_uid"), F.col("username").alias("owner_username"))
    out = listing.join(names, "owner_uid", "left")
    known = F.col("owner_username").isNotNull()
    return out.withColumn("owner_uid", F.when(known, F.col("owner_uid")).otherwise(-1)).withColumn("owner_username", F.coalesce("owner_username", F.lit("unknown")))


def username_of(path: Column, prefix: str) -> Column:
    """The directory after ``prefix`` in a path, lower-case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(path, "\\Q" + prefix.rstrip("/") + "\\E/([^/]+)", 1)), F.lit(""))


def unindexed(files: DataFrame, indexed: DataFrame, key: str = "path") -> DataFrame:
    """Files that the state doesn't hold, sorted."""
    return files.join(indexed.select(key), key, "left_anti").orderBy(key)


def save_snapshot(rows: DataFrame, path: str) -> None:
    """A scan as JSON lines."""
    rows.write.mode("overwrite").json(path)
