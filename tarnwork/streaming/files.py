"""Folders of versions: marks, listings and pointers through the file system that Spark has for a path."""

from __future__ import annotations

import contextlib

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def mark(spark: SparkSession, folder: str, name: str = "_done") -> None:
    """Say that a folder is complete."""
    path, files = located(spark, f"{folder}/{name}")
    files.create(path, True).close()


def marked(spark: SparkSession, folder: str, name: str = "_done") -> list[int]:
    """The numbers of the complete folders ``v1, v2, ...`` below a folder, in order."""
    path, files = located(spark, folder)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    found = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    return sorted(v for v in found if files.exists(located(spark, f"{folder}/v{v}/{name}")[0]))


def remove(spark: SparkSession, folder: str) -> None:
    path, files = located(spark, folder)
    files.delete(path, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of what lies in a folder, in order; none where it is not there."""
    path, files = located(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    at, files = located(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: readers see the old one or the new one, never a part."""
    new, files = located(spark, f"{path}.new")
    stream = files.create(new, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, located(spark, path)[0], options)


def sweep_at_end(spark: SparkSession, folder: str) -> None:
    """Have the file system remove a folder when the driver ends."""
    with contextlib.suppress(AttributeError):
        path, files = located(spark, folder)
        files.deleteOnExit(path)
