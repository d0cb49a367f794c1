"""Voice profiles: stores, choice by topic affinity, and seeded random choice with tension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_of

STORE = "compound_types map<string,struct<name:string,description:string,tensions:array<string>,disposition:array<double>>>, individuals map<string,struct<name:string,topics:array<string>,disposition:array<double>>>"


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Compound types and individuals of a profile document, keyed by id."""
    raw = spark.read.schema(STORE).json(path, multiLine=True)
    tables = (raw.select(F.explode(c).alias("id", "p")).select("id", "p.*") for c in ("compound_types", "individuals"))
    return tuple(tables)


def save(types: DataFrame, individuals: DataFrame, path: str) -> None:
    """Write a store as one document, as ``load`` reads it; profiles of one id are an error."""
    fields = lambda rows: F.map_from_entries(F.collect_list(F.struct("id", F.struct(*[c for c in rows.columns if c != "id"]))))
    document = types.agg(fields(types).alias("compound_types")).join(individuals.agg(fields(individuals).alias("individuals")))  # one row each
    document.coalesce(1).write.mode("overwrite").json(path)


def by_topic(affinities: DataFrame, topics: list[str], n: int = 3) -> DataFrame:
    """The voices with most affinities ``(topic, voice)`` to topics that hold the keyword or are held by it."""
    test = F.lit(False)
    for topic in topics:
        test = test | F.col("topic").contains(topic.lower()) | F.lit(topic.lower()).contains(F.col("topic"))
    return affinities.where(test).groupBy("voice").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "voice").limit(n)


def choose(voices: DataFrame, n: int = 3, seed: int = 0, tension: bool = True) -> list[str]:
    """Up to n of the voices ``(id, tensions)``: the first by seeded chance, then one it is in tension with, then by
    chance.  Only the chosen reach the driver."""
    drawn = voices.select("id", "tensions").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    picked = drawn.limit(n + 1).collect()
    if not picked:
        return []
    first, against = picked[0], []
    if tension and first.tensions:
        plain = F.replace(F.lower("id"), F.lit(" "), F.lit("_"))
        test = any_of([plain.contains(t) for t in first.tensions])
        against = [r.id for r in drawn.where((F.col("id") != first.id) & test).limit(1).collect()]
    order = [first.id, *against, *(r.id for r in picked[1:] if r.id not in against)]
    return order[:n]


def common_topics(people: DataFrame, person: str, least: int = 2) -> DataFrame:
    """People who share at least ``least`` exact topics with one: ``people(name, topics)``."""
    own = people.where(F.lower("name").contains(person.lower())).select(F.explode("topics").alias("topic")).distinct()
    rows = people.where(~F.lower("name").contains(person.lower())).select("name", F.explode(F.array_distinct("topics")).alias("topic"))
    return rows.join(own, "topic").groupBy("name").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
