"""Tables in the folder that driver and executors share.

A table written there cuts the lineage and outlives any executor.  The folder is the one the
cluster names in ``spark.checkpoint.dir``; where that is unset, as in tests, it is a folder in
the warehouse, which a cluster shares too.  All tables of an application go when it ends.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_swept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def _sweep_at_end(spark: SparkSession, folder: str) -> None:
    """Have the file system remove the folder when the driver ends."""
    if folder not in _swept:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _swept.add(folder)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _sweep_at_end(spark, folder)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_BATCH, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and give them texts in small batches.

    On a cluster whose nodes lack that path, ship the package with ``--py-files``.
    """
    if spark.conf.get(_BATCH) == "10000":  # the default, meant for numbers
        spark.conf.set(_BATCH, _BATCH_ROWS)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
