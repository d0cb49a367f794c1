"""Graph edges from registries: projects, publications, co-authorship, affiliation and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import make_id
from ..session import dealt

_NONE = "array<string>"


def _edge(rows: DataFrame, kind: str, key: list[str], agents, inputs=None, outputs=None, ts=None, confidence: float | Column = 1.0) -> DataFrame:
    none = F.array().cast(_NONE)
    return rows.select(
        make_id(kind.lower(), *[F.col(k).cast("string") for k in key]).alias("id"), F.lit(kind).alias("edge_type"), (ts if ts is not None else F.lit(None)).cast("timestamp").alias("ts"), agents.alias("agents"),
        (inputs if inputs is not None else none).alias("inputs"), (outputs if outputs is not None else none).alias("outputs"), none.alias("context"), F.lit(confidence).alias("confidence"),
    )


def resolve_members(refs: DataFrame, people: DataFrame) -> DataFrame:
    """Project members given by id or by name: ``refs(project_id, ref)``, ``people(person_id, name)``; unknown ones go."""
    by_id = people.select(F.col("person_id").alias("ref"), F.col("person_id").alias("by_id"))
    by_name = people.groupBy(F.lower("name").alias("low")).agg(F.max("person_id").alias("by_name"))
    joined = refs.join(by_id, "ref", "left").withColumn("low", F.lower("ref")).join(by_name, "low", "left")
    return joined.select("project_id", F.coalesce("by_id", "by_name").alias("person_id")).where("person_id is not null").distinct()


def project_edges(members: DataFrame) -> DataFrame:
    """One production edge per project with its people."""
    teams = members.groupBy("project_id").agg(F.array_sort(F.collect_set("person_id")).alias("team"))
    return _edge(teams, "Production", ["project_id"], F.col("team"), outputs=F.array("project_id"))


def publication_edges(authors: DataFrame) -> DataFrame:
    """Production edges of ``authors(doc_id, person_id, year)``; a year stands for the 15th of June."""
    rows = authors.groupBy("doc_id").agg(F.array_sort(F.collect_set("person_id")).alias("team"), F.max("year").alias("year"))
    return _edge(rows, "Production", ["doc_id"], F.col("team"), outputs=F.array("doc_id"), ts=F.try_to_timestamp(F.format_string("%d-06-15", "year"), F.lit("yyyy-MM-dd")))


def coauthor_edges(listed: DataFrame, least: int = 3, size: int | None = None) -> DataFrame:
    """Collaboration edges of people listed together in ``listed(profile_id, doc_id, person_id)``; a paper in two profiles
    counts twice.  The times are unknown.  ``size``: about how many rows there are, counted if it isn't told."""
    base = dealt(listed.select("profile_id", "doc_id", "person_id"), listed.count() if size is None else size, "profile_id", "doc_id").distinct()
    other = base.toDF("profile_id", "doc_id", "other")
    pairs = base.join(other, ["profile_id", "doc_id"]).where("person_id < other").groupBy("person_id", "other").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return _edge(pairs, "Collaboration", ["person_id", "other"], F.array("person_id", "other"), confidence=F.least(F.col("n") / 10.0, F.lit(1.0)))


def affiliation_edges(people: DataFrame) -> DataFrame:
    """A person and an institution, as a collaboration edge."""
    rows = people.where("coalesce(institution, '') <> ''")
    return _edge(rows, "Collaboration", ["person_id", "institution"], F.array("person_id", make_id("org", F.col("institution"))), confidence=0.9)


def usage_edges(directories: DataFrame, people: DataFrame, datasets: DataFrame) -> DataFrame:
    """People whose directory holds a data set that is a node already: ``directories(username, dataset_id)``."""
    rows = directories.join(people.select("username", "person_id"), "username").join(datasets.select("dataset_id"), "dataset_id")
    return _edge(rows, "Usage", ["person_id", "dataset_id"], F.array("person_id"), inputs=F.array("dataset_id"), confidence=0.9)
