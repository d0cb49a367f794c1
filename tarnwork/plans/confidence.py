"""Confidence of an answer from its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reliability of a kind of source, and weights of the six factors.
RELIABILITY = {"registry": 1.0, "document": 0.8, "web": 0.6, "inference": 0.4}
WEIGHTS = {"source_count": 0.15, "source_quality": 0.25, "structured_data": 0.20, "classification": 0.10, "similarity": 0.15, "source_relevance": 0.15}


def level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").when(score >= 0.4, "low").otherwise("uncertain")


def confidence(sources: DataFrame, answer: str, kind: str = "type", relevance: str = "relevance", similarity: str | None = None, order: str | None = None, classification: float = 1.0) -> DataFrame:
    """``score`` and ``level`` per ``answer`` of ``sources(answer, type, relevance)``: number, reliability and relevance of
    the sources, structured data among them, the classification, and the first three similarities."""
    weight = F.coalesce(*[F.when(F.col(kind) == k, F.lit(w)) for k, w in RELIABILITY.items()], F.lit(0.5))
    rows = sources.groupBy(answer).agg(F.count("*").alias("n"), F.avg(weight).alias("quality"), F.avg(relevance).alias("relevance"), F.bool_or(F.col(kind) == "registry").alias("structured"))
    if similarity:  # three rows of an answer leave their partitions, however many sources it has
        rank = F.row_number().over(Window.partitionBy(answer).orderBy(order, similarity))
        first = sources.withColumn("_rank", rank).where(F.col("_rank") <= 3).groupBy(F.col(answer).alias("_of")).agg(F.avg(similarity).alias("near"))
        rows = rows.join(first, F.col(answer).eqNullSafe(F.col("_of")), "left")
    else:
        rows = rows.withColumn("near", F.lit(None).cast("double"))
    count = F.when(F.col("n") == 0, 0.1).when(F.col("n") == 1, 0.5).when(F.col("n") <= 3, 0.7).otherwise(F.least(F.lit(0.9), 0.7 + F.col("n") * 0.05))
    near = F.coalesce("near", F.lit(0.5))
    factors = {"source_count": count, "source_quality": F.col("quality"), "structured_data": F.when(F.col("structured"), 0.9).otherwise(0.4), "classification": F.lit(classification), "similarity": near, "source_relevance": F.col("relevance")}
    score = F.round(sum((F.lit(WEIGHTS[k]) * v for k, v in factors.items()), F.lit(0.0)), 6)
    return rows.withColumn("score", score).withColumn("level", level(F.col("score"))).select(answer, "n", "score", "level")


def reasons(sources: DataFrame, answer: str, kind: str = "type", order: str | None = None, similarity: Column | None = None, classification: Column | None = None) -> DataFrame:
    """Per ``answer`` of ``sources(answer, type)`` why its confidence is what it is, in sentences: structured data among
    the sources, their number and kinds (in order of first appearance by ``order``), a low or high ``similarity`` and an
    unclear ``classification`` (aggregates over an answer's rows).  An answer without sources has a row of null type."""
    at = F.col(order) if order else F.col(kind)
    held = [F.min(F.struct(at, kind)).alias("first"), F.count(kind).alias("n")]
    extra = {"similarity": similarity, "classification": classification}
    per = sources.groupBy(answer, kind).agg(*held)
    list_of = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("first", "n", kind)))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x[kind]))
    told = per.groupBy(answer).agg(F.sum("n").alias("n"), list_of.alias("kinds"), F.bool_or(F.coalesce(F.col(kind) == "registry", F.lit(False))).alias("structured"), F.max(kind).alias("one"))
    values = [(c if c is not None else F.max(F.lit(0.6 if name == "similarity" else 1.0))).alias(name) for name, c in extra.items()]
    told = told.join(sources.groupBy(answer).agg(*values), answer)
    count = F.when(F.col("n") == 0, "No sources found").when(F.col("n") == 1, F.concat(F.lit("Based on single source ("), "one", F.lit(")")))
    count = count.otherwise(F.concat(F.lit("Based on "), F.col("n").cast("string"), F.lit(" sources ("), F.array_join("kinds", ", "), F.lit(")")))
    near = F.when(F.col("similarity") < 0.5, "Low semantic match to query").when(F.col("similarity") > 0.8, "High semantic relevance")
    unclear = F.when(F.col("classification") < 0.7, "Query intent unclear")
    return told.select(answer, F.concat_ws(". ", F.when(F.col("structured"), "Found structured registry data"), count, near, unclear).alias("reason"))


def structured_sources(results: DataFrame) -> DataFrame:
    """Sources of ``results(type, name, title, url, score)`` from a registry: a person's profile, a project, a publication
    by the start of its title, anything else by its name."""
    kind, name = F.col("type"), F.col("name")
    title = F.left(F.coalesce("title", F.lit("Untitled")), F.lit(50))
    person = F.coalesce(name, F.lit("Unknown"))
    named = F.when(kind == "person", F.concat(person, F.lit(" profile"))).when(kind == "project", F.coalesce(name, F.lit("Unknown Project"))).when(kind == "publication", title).otherwise(F.coalesce(name, kind))
    cited = F.concat(named, F.when(kind == "publication", " (registry publication)").otherwise(" (registry)"))
    url = F.when(kind.isin("person", "publication"), F.col("url"))
    return results.select(F.lit("registry").alias("type"), named.alias("name"), cited.alias("citation"), F.coalesce("score", F.lit(1.0)).alias("relevance"), url.alias("url"))


def document_sources(results: DataFrame) -> DataFrame:
    """Sources of ``results(citation, source_file, score)`` from a search."""
    cited = F.coalesce("citation", "source_file", F.lit("unknown"))
    return results.select(F.lit("document").alias("type"), cited.alias("name"), cited.alias("citation"), F.coalesce("score", F.lit(0.5)).alias("relevance"), F.lit(None).cast("string").alias("url"))


def web_sources(results: DataFrame, rank: str = "rank") -> DataFrame:
    """Sources of ``results(rank, title, url)``, ranks from 0: the relevance falls by 0.1 a rank, to 0.5."""
    title = F.coalesce("title", F.lit("Web Result"))
    return results.select(F.lit("web").alias("type"), title.alias("name"), title.alias("citation"), F.greatest(F.lit(0.5), F.round(1.0 - F.col(rank) * 0.1, 6)).alias("relevance"), F.coalesce("url", F.lit("")).alias("url"))


def sources(structured: DataFrame, semantic: DataFrame) -> DataFrame:
    """Sources of both kinds of results, the structured ones first in their columns' sense only: rows have no order."""
    return structured_sources(structured).unionByName(document_sources(semantic))
