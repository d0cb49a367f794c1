"""Embedding indexes of entities and chunks: encode, insert, save, load and search.

An encoder maps a column of texts to ``array<float>``.  The default needs no model: it
hashes words to signed dimensions, so equal texts have equal vectors and texts that share
words are near.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import retrieval as R

DIMENSIONS = 64
Encoder = Callable[[Column], Column]
SCHEMA = "id string, doc_type string, text string, metadata map<string,string>, mentioned array<string>, embedding array<float>"


def hash_encoder(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Signed word hashing, normalised; one Arrow pass."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: _hashed(t or "", dimensions))

    return run(text)


def _hashed(text: str, dimensions: int) -> np.ndarray:
    out = np.zeros(dimensions, dtype=np.float32)
    for word in re.findall(r"[^\W_]+", text.lower()):
        h = zlib.crc32(word.encode())
        out[h % dimensions] += 1.0 if h >> 31 else -1.0
    size = float(np.linalg.norm(out))
    return out / size if size else out


def build(entries: DataFrame, encoder: Encoder = hash_encoder) -> DataFrame:
    """Index rows of ``entries(id, doc_type, text[, metadata, mentioned])``; the first entry of an id stays."""
    have = set(entries.columns)
    rows = entries.select(
        F.col("id").cast("string").alias("id"), "doc_type", "text", F.col("metadata") if "metadata" in have else F.lit(None).cast("map<string,string>").alias("metadata"),
        F.col("mentioned") if "mentioned" in have else F.array().cast("array<string>").alias("mentioned"), F.col("ord") if "ord" in have else F.lit(0).alias("ord"),
    )
    first = rows.groupBy("id").agg(F.min_by(F.struct("doc_type", "text", "metadata", "mentioned"), F.struct("ord", "text")).alias("e")).select("id", "e.*")
    return first.withColumn("embedding", encoder(F.col("text")))


def insert(index: DataFrame, entries: DataFrame, encoder: Encoder = hash_encoder) -> DataFrame:
    """Adds entries whose id the index doesn't have."""
    new = build(entries, encoder).join(index.select("id"), "id", "left_anti")
    return index.unionByName(new)


def save(index: DataFrame, path: str) -> None:
    """Parquet, by type, so that a search of one type reads only its files."""
    index.write.mode("overwrite").partitionBy("doc_type").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select("id", "doc_type", "text", "metadata", "mentioned", "embedding")


def search(index: DataFrame, query: str, k: int = 10, doc_types: list[str] | None = None, boost: list[str] | None = None, factor: float = 0.2, encoder: Encoder = hash_encoder) -> DataFrame:
    """The k nearest entries of the wanted types, with ``factor`` more for each boosted entity that they mention."""
    vector = index.sparkSession.range(1).select(encoder(F.lit(query)).alias("v")).first().v
    keep = F.col("doc_type").isin(*doc_types) if doc_types else None
    near = R.vector_search(index, vector, 3 * k if boost else k, "id", keep=keep)
    return R.entity_boost(near, F.col("mentioned"), boost, factor, k, "id") if boost else near


def similar(index: DataFrame, entity_id: str, k: int = 5, same_type: bool = False) -> DataFrame:
    """The k nearest neighbours of an entry, without itself."""
    own = index.where(F.col("id") == entity_id).first()
    keep = F.col("id") != entity_id
    if same_type:
        keep = keep & (F.col("doc_type") == own["doc_type"])
    return R.vector_search(index, list(own["embedding"]), k, "id", keep=keep)


def stats(index: DataFrame) -> DataFrame:
    return index.groupBy("doc_type").agg(F.count("*").alias("n"))


def with_aliases(surfaces: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """``surfaces(surface, id)`` and the aliases that are not among them yet."""
    more = surfaces.sparkSession.createDataFrame(list(aliases.items()), "surface string, id string")
    return surfaces.select("surface", "id").unionByName(more.join(surfaces.select("surface"), "surface", "left_anti"))


def with_known(found: Column, known: tuple[str, ...], text: Column) -> Column:
    """``found`` and the known names that the text holds in any case."""
    low = F.lower(text)
    return F.array_union(found, F.filter(F.array(*map(F.lit, known)), lambda k: F.contains(low, F.lower(k))))
