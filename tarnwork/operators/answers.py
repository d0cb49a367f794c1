"""From a query to an answer: registry lookups, search, sources and confidence in one plan.

``entities(type, id, name, description, ord)`` is the registry, ``documents(id, text)`` what is
searched.  A query is one row; what is joined with it on every row is that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import confidence as C
from ..plans import routing as Q
from ..plans.classify import classify
from . import registry as R
from . import suggest as S
from .retrieval import bm25_search

#: How many rows of a kind an answer lists, and of others.
LISTED = {"person": 15, "publication": 10, "topic": 20}
OTHERS = 10
#: Patterns of queries for what a person uses.
USES = (r"what\s+(?:data|resources?)\s+does\s+(\w+)\s+(?:have|use|work)", r"(\w+)(?:'s)?\s+(?:data|resources?|{place})", r"show\s+(\w+)(?:'s)?\s+resources?")


def asked_person(query: Column, place: str = "cluster") -> Column:
    """The name in a query for a person's resources; null without one."""
    low = F.lower(query)
    return F.coalesce(*[F.nullif(F.regexp_extract(low, p.replace("{place}", place), 1), F.lit("")) for p in USES])


def person_resources(links: DataFrame, people: DataFrame, resources: DataFrame, name: str, least: float = 0.3) -> DataFrame:
    """The answer to what a person uses: the person's row, then the resources linked by ``least`` or more.

    ``links(person_id, resource_id, score, reasons)``, ``people(person_id, name, username, ord)``, ``resources(resource_id,
    name, category)``.  The person is the first whose id or name equals the name, whose name contains it or is contained in
    it, whose account it is, or one word of whose name it is."""
    low, own = name.lower().strip(), F.lower(F.coalesce("name", F.lit("")))
    test = (F.lower(F.col("person_id").cast("string")) == low) | own.contains(low) | F.lit(low).contains(own) | F.coalesce(F.lower("username") == low, F.lit(False))
    who = people.where(test).orderBy("ord").limit(1).select("person_id", F.col("name").alias("person"))
    used = links.where(F.col("score") >= least).join(F.broadcast(who), "person_id").join(resources, "resource_id")  # one person
    subject = who.select(F.lit("person").alias("type"), F.col("person_id").cast("string").alias("id"), F.col("person").alias("name"), F.lit(None).cast("double").alias("score"), F.lit("Query subject").alias("match_reason"))
    reason = F.concat(F.lit("Used by "), F.col("person"), F.lit(": "), F.array_join("reasons", ", "))
    rows = used.select(F.concat(F.lit("resource_"), F.coalesce("category", F.lit("resource"))).alias("type"), F.col("resource_id").cast("string").alias("id"), "name", F.col("score").cast("double").alias("score"), reason.alias("match_reason"))
    return subject.unionByName(rows)


def registry_query(spark: SparkSession, query: str, entities: DataFrame, patterns: list[tuple[str, str, float]], kinds: dict[str, tuple[str, ...]], institutions: dict[str, str], gate: tuple[str, ...] = (), stopwords: tuple[str, ...] = (), place: str = "the cluster", least: float = 0.85) -> DataFrame:
    """Rows ``(query, corrected_query, query_type, type, id, name, ord, suggestion)``: the entities that hold a search term
    of the corrected query in their name or description, best name matches first by source order.  A query that is not
    structured or hybrid finds none; results without any of the ``gate`` terms of the query are none; a query that finds
    nothing has one row with a suggestion."""
    words = [w for w in dict.fromkeys(query.lower().split()) if len(w) >= 4 and w not in stopwords]
    one = spark.createDataFrame([(1, query)], "query_id int, query string")
    terms = entities.select(F.explode(F.split(F.lower("name"), r"\s+")).alias("term")).distinct()
    if words:
        close = R.closest_words(spark.createDataFrame([(w,) for w in words], "word string"), terms, least=least)
        one = one.join(R.correct_queries(one, close, stopwords), "query_id")
    else:
        one = one.withColumn("corrected", F.col("query"))
    one = classify(one, patterns, kinds, institutions, query="corrected").withColumn("terms", Q.search_terms(F.col("corrected")))
    one = one.select("query", F.col("corrected").alias("corrected_query"), "query_type", "entity_types", "terms")
    text = F.concat_ws(" ", F.lower("name"), F.lower("description"))
    named = F.exists("terms", lambda t: F.contains(F.lower("name"), t))
    found = entities.join(F.broadcast(one)).where(F.col("query_type").isin("structured", "hybrid") & F.exists("terms", lambda t: F.contains(text, t)))  # one row
    found = R.relevance_gate(found.withColumn("branch", F.when(named, 1).otherwise(2)), query, gate)
    found = R.dedup_results(found).select("query", "corrected_query", "query_type", "type", F.col("id").cast("string").alias("id"), "name", F.struct("branch", "ord").alias("rank"))
    order = F.col("rank.branch") * F.lit(1 << 40) + F.col("rank.ord")
    found = found.select("query", "corrected_query", "query_type", "type", "id", "name", order.cast("long").alias("ord"), F.lit(None).cast("string").alias("suggestion"))
    n = found.agg(F.count("*").alias("n"))
    none = F.array().cast("array<struct<word:string,term:string>>")
    told = S.suggestions(F.col("query"), none, F.col("n"), F.col("entity_types"), place)["message"]
    blank = lambda kind: F.lit(None).cast(kind)
    nothing = one.join(F.broadcast(n)).where("n = 0").select("query", "corrected_query", "query_type", blank("string"), blank("string"), blank("string"), blank("long"), F.coalesce(told, F.concat(F.lit("No results found in the registry for: "), F.col("query"))))  # one row
    return found.union(nothing)


def formatted(results: DataFrame, heading: str = "Found") -> DataFrame:
    """One text per type of ``results(type, name, ord)``: a heading with the number and the first names, as many as
    ``LISTED`` has for the type."""
    from pyspark.sql import Window

    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LISTED.items() for x in pair]), F.col("type")), F.lit(OTHERS))
    counted = results.where("type is not null").groupBy("type").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("type").orderBy("ord", "name"))
    rows = results.where("type is not null").withColumn("rank", rank).where(F.col("rank") <= max(*LISTED.values(), OTHERS)).where(F.col("rank") <= most)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: F.concat(F.lit("- "), x["name"])), "\n")
    rows = rows.groupBy("type").agg(lines.alias("lines"), F.max("rank").alias("shown")).join(counted, "type")
    more = F.when(F.col("n") > F.col("shown"), F.concat(F.lit("\n... and "), (F.col("n") - F.col("shown")).cast("string"), F.lit(" more"))).otherwise("")
    return rows.select("type", "n", F.concat(F.lit(f"{heading} "), F.col("n").cast("string"), F.lit(" "), F.col("type"), F.lit(":\n"), F.col("lines"), more).alias("answer"))


def hybrid_query(spark: SparkSession, query: str, registry: DataFrame, documents: DataFrame, k: int = 5, assistant: str = r"this\s+assistant") -> DataFrame:
    """Rows ``(origin, type, id, name, score, decision, level, confidence)``: the registry's results (from
    ``registry_query``), the ``k`` best documents unless the query's route is the registry alone, and how sure the answer
    is: sources of both, similarities of the first documents relative to the best."""
    route = Q.route(spark.createDataFrame([(query,)], "query string"), assistant=assistant).select("decision")
    found = bm25_search(documents, query, k, "id").select(F.lit("semantic").alias("origin"), F.lit("document").alias("type"), F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.col("score").cast("double").alias("score"))
    found = found.join(F.broadcast(route)).where("decision <> 'registry_only'").drop("decision")  # one row
    known = registry.where("type is not null").select(F.lit("structured").alias("origin"), "type", "id", "name", F.lit(1.0).alias("score"))
    rows = known.unionByName(found)
    best = F.greatest(F.max(F.when(F.col("origin") == "semantic", F.col("score"))), F.lit(1e-9))
    top = rows.agg(best.alias("best"))
    kind = F.when(F.col("origin") == "structured", "registry").otherwise("document")
    relevance = F.when(F.col("origin") == "structured", F.lit(1.0)).otherwise(F.round(F.col("score") / F.col("best"), 6))
    sources = rows.join(F.broadcast(top)).select(F.lit(query).alias("query"), kind.alias("type"), relevance.alias("relevance"), F.concat("origin", F.format_string("%012.6f", 1e5 - F.col("score")), F.col("id")).alias("ord"))  # one row
    sure = C.confidence(sources, "query", similarity="relevance", order="ord").select(F.col("level"), F.col("score").alias("confidence"))
    return rows.join(F.broadcast(route)).join(F.broadcast(sure))  # one row each
