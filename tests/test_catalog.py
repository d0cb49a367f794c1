"""Every query of the catalog against its SQL, or for its rows where SQL can't express it."""

from __future__ import annotations

import pytest

from tarnwork import catalog

from .compare import same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    found = QUERIES[name](spark, data).toPandas()
    if name in SQL:
        same(found, duck.sql(SQL[name]).df())
    else:
        assert len(found.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "tarnwork.llm", None)
    sys.modules.pop("__spark_entry__", None)
    e = importlib.import_module("__spark_entry__")
    assert "bm25_topk" in e.queries() and not any(q.startswith("op1_") for q in e.queries())
    sys.modules.pop("__spark_entry__", None)
