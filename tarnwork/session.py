"""Session settings and table loading."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings that the engine's results rest on: UTC, ANSI and adaptive execution."""
    builder = SparkSession.builder.appName("tarnwork").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows over all cores where a table comes in fewer parts than there are cores (a small table in one file);
    larger tables are read as they lie, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def dealt(rows: DataFrame, size: int, *by: str, per: int = 100_000) -> DataFrame:
    """Rows dealt by key over as many parts as ``size`` rows need at ``per`` rows a part (one for each core at least): what a
    task holds does not grow with the table, and what is grouped or joined by the key afterwards stays where it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-size // per)), *by)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose nodes lack that path, ship the package with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
