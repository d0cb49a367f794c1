"""All queries of the engine by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, documents, enrichment, graph, indexes, keeping, people, planning, registry, retrieval, routing, snapshots, state, streams

_AREAS = (retrieval, indexes, registry, graph, snapshots, audit, enrichment, routing, planning, people, documents, state, streams, keeping)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for area in _AREAS for name, f in area.BOOK.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in _AREAS for name, sql in area.BOOK.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.BOOK.queries["bm25_topk"](spark, sf_dir)
