"""What a task holds does not grow with the table: parts by the number of rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tarnwork.catalog import graph as catalog_graph
from tarnwork.operators import build_graph, graph
from tarnwork.session import dealt


def dealt_over(rows) -> list[int]:
    """The numbers of parts that a plan asks for by key."""
    return [int(n) for n in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", rows._jdf.queryExecution().optimizedPlan().toString())]


def test_parts_follow_rows(spark):
    rows = spark.range(1000)
    assert dealt(rows, 1000, "id", per=10).rdd.getNumPartitions() == 100
    assert dealt(rows, 1000, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_shared_attributes(spark):
    rows = spark.range(1_000_000).select((F.col("id") % 7).alias("n"), (F.col("id") % 100_000).alias("a"))
    found = graph.shared_attributes(rows, "n", "a")
    assert dealt_over(found) == [10, 10]
    assert found.count() == 21


def test_coauthors_of_one_id(spark):
    """Two pairs whose joined names are one id stay two edges, each with its own confidence."""
    rows = [(0, i, p) for i in range(4) for p in ("a", "b_c")] + [(0, 10 + i, p) for i in range(3) for p in ("a_b", "c")]
    found = build_graph.coauthor_edges(spark.createDataFrame(rows, "profile_id int, doc_id int, person_id string"), size=1_000_000)
    assert dealt_over(found) == [10, 10]
    assert sorted((*r.agents, r.confidence) for r in found.collect()) == [("a", "b_c", 0.4), ("a_b", "c", 0.3)]


@pytest.mark.parametrize("name", ["graph_incidence", "graph_who_worked_with"])
def test_edges_arise_where_orders_lie(spark, data, name):
    """Orders and lines are dealt by order once; members and pairs of an order need no further exchange by it."""
    found = getattr(catalog_graph, name)(spark, data)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert dealt_over(found) and "ENSURE_REQUIREMENTS" in plan
    assert not re.search(r"hashpartitioning\((edge_id|l_orderkey|o_orderkey|id)#\d+L?, \d+\), ENSURE", plan)


def test_spelling_makes_no_variants_of_words_too_long(spark):
    """Deletion variants, which grow with the square of a word's length, are made of terms of a possible length only."""
    from tarnwork.operators import registry

    terms = spark.range(2000).selectExpr("concat('supplier#', lpad(id, 9, '0')) as term").union(spark.createDataFrame([("gear",), ("gears",), ("g",)], "term string"))
    found = registry.closest_words(spark.createDataFrame([("gaer",), ("",)], "word string"), terms, least=0.5)
    assert [(r.word, r.term) for r in found.collect()] == [("gaer", "gear")]
    assert "length(term" in found._jdf.queryExecution().optimizedPlan().toString().replace("length(id", "") and registry.closest_words(spark.createDataFrame([], "word string"), terms).count() == 0
    assert found._jdf.queryExecution().optimizedPlan().toString().count(" IN (2,3,4,5,6)") + found._jdf.queryExecution().optimizedPlan().toString().count("INSET") >= 1


def test_key_terms_are_counted_where_texts_lie(spark):
    """No exchange by row and term: only texts are dealt, by id."""
    from tarnwork.operators import enrichment

    rows = spark.range(20_000).selectExpr("id as doc_id", "concat('hot gear ', if(id = 3, 'gear topology', '')) as text")
    found = enrichment.key_terms(rows, "doc_id", k=1, least=0.0)
    assert dealt_over(found) == [10]
    assert "ENSURE_REQUIREMENTS" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.term, r.frequency) for r in found.where("doc_id = 3").collect()] == [("gear", 2)]
