"""What to ask instead: vocabularies, alternative queries and corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of data that every vocabulary holds.
COMMON = (
    "openalex", "semantic scholar", "mag", "dblp", "pubmed", "patstat", "uspto", "wos", "web of science", "reddit", "twitter", "weibo", "4chan", "word2vec", "specter", "mat2vec", "hyperbolic",
    "embeddings", "snapshots", "precomputed", "social media",
)
#: Data terms beside which snapshots are suggested.
DATA_TERMS = ("openalex", "semantic", "scholar", "patent", "reddit", "twitter", "pubmed")
#: Queries to suggest by kind of entity, and by words of the query (the first that it has); the place is a parameter.
CATEGORIES = {
    "people": ("Who works on [topic]?", "List all researchers"),
    "datasets": ("What datasets are available?", "Where is the [name] data?"),
    "snapshots": ("What data snapshots are on {place}?", "Where is the OpenAlex snapshot?"),
    "embeddings": ("What embeddings are available?", "Where are the word2vec embeddings?"),
}
BY_WORD = (
    (("embedding",), ("What embeddings are on {place}?", "Where are the word2vec embeddings?")),
    (("data",), ("What datasets are available?", "What data snapshots are on {place}?")),
    (("who", "person"), ("List all researchers", "Who works on [topic]?")),
)


def vocabulary(entities: DataFrame, common: tuple[str, ...] = COMMON) -> DataFrame:
    """Distinct lower-case names of ``entities(name)`` and the common ones, as ``term``."""
    named = entities.where(F.coalesce("name", F.lit("")) != "").select(F.lower("name").alias("term"))
    return named.union(entities.sparkSession.createDataFrame([(c,) for c in common], "term string")).distinct()


def alternatives(query: Column, types: Column, categories: dict[str, tuple[str, ...]] | None = None, place: str = "the cluster") -> Column:
    """At most five distinct queries: two per kind of entity, then those of the query's words, then of data terms."""
    low = F.lower(query)
    texts = lambda xs: F.array(*[F.lit(x.replace("{place}", place)) for x in xs])
    none = F.array().cast("array<string>")
    table = F.create_map(*[x for k, v in (categories or CATEGORIES).items() for x in (F.lit(k), texts(v[:2]))])
    by_type = F.flatten(F.transform(F.coalesce(types, none), lambda t: F.coalesce(F.element_at(table, t), none)))
    by_word = None
    for words, queries in BY_WORD:
        has = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        by_word = F.when(has, texts(queries)) if by_word is None else by_word.when(has, texts(queries))
    data = F.when(F.arrays_overlap(F.split(low, r"\s+"), texts(DATA_TERMS)), texts(("What data snapshots are on {place}?",))).otherwise(none)
    return F.slice(F.array_distinct(F.concat(by_type, by_word.otherwise(none), data)), 1, 5)


def suggestions(query: Column, typos: Column, found: Column, types: Column, place: str = "the cluster") -> Column:
    """``has_suggestions, did_you_mean, alternative_queries, message``: the query with ``typos(word, term)`` put right,
    and other queries if nothing was found."""
    mended = F.reduce(typos, query, lambda q, t: F.replace(q, t["word"], t["term"]))
    mean = F.when((F.size(typos) > 0) & (mended != query), mended)
    none = F.array().cast("array<string>")
    other = F.when(found == 0, alternatives(query, types, place=place)).otherwise(none)
    some = (F.size(typos) > 0) | (F.size(other) > 0)
    lines = F.concat(
        F.when(mean.isNotNull(), F.array(F.concat(F.lit('Did you mean: "'), mean, F.lit('"?')))).otherwise(none),
        F.when(F.size(other) > 0, F.concat(F.array(F.lit("Try these queries:")), F.transform(F.slice(other, 1, 3), lambda a: F.concat(F.lit("  - "), a)))).otherwise(none),
    )
    return F.struct(some.alias("has_suggestions"), mean.alias("did_you_mean"), other.alias("alternative_queries"), F.when(some, F.array_join(lines, "\n")).alias("message"))
