"""Queries over whole tables: every row counts."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tarnwork import catalog

from .compare import same

LARGER = "/root/testdata/sf0.01"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: The rows or the sum that a whole query must have, in plain SQL over the tables.
WHOLE = {
    "document_panel": ("count(*)", "SELECT count(*) FROM orders"),
    "confidence_score": ("sum(n)", "SELECT count(*) FROM documents"),
    "cross_link_scores": ("count(DISTINCT person_id) FILTER (score < 0.5)", "SELECT count(*) FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')"),
    "author_resolution": ("bool_or(person_id >= 40)", "SELECT true"),
    "graph_project_members": ("count(*)", "SELECT count(DISTINCT l_orderkey) FROM lineitem"),
    "edge_node_sets": ("count(*)", "SELECT count(*) FROM orders"),
    "merge_structured_semantic": ("count(*) FILTER (origin <> 'semantic')", "SELECT count(*) FROM labels WHERE quality = 1"),
    "enrichment_stats": ("max(n)", "SELECT count(*) FROM orders"),
    "cache_upsert": ("count(*) FILTER (v = 'new')", "SELECT count(DISTINCT user_id) FROM events WHERE ts >= TIMESTAMP '2024-01-16'"),
}


@pytest.fixture(scope="module")
def larger():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in Path(LARGER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_query(name, spark, larger):
    found = QUERIES[name](spark, LARGER).toPandas()
    same(found, larger.sql(SQL[name]).df())
    measure, rows = WHOLE[name]
    assert larger.sql(f"SELECT {measure} FROM found").fetchall() == larger.sql(rows).fetchall()
