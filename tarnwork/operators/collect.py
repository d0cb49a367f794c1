"""Samples of what people wrote and said: chat users, papers and transcripts.

``people(id, name, role, institution, topics, works_count, ord)``, ``pubs(owner, title, abstract, doi, year, topics,
ord)``, ``chunks(source, text, speaker, ord)`` and ``users(id, real_name, profile_name, display_name, name, is_bot,
ord)`` carry their source order in ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import any_contains, contains, holding

#: Words that tell a transcript by its file.
TRANSCRIPTS = ("transcript", "recording", ".vtt", "meeting")


def _text(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def user_names(users: DataFrame) -> DataFrame:
    """``id, name, is_bot``: the real name, else the profile's, else the account's, else the id."""
    return users.select("id", F.coalesce(_text("real_name"), _text("profile_name"), _text("name"), "id").alias("name"), F.coalesce("is_bot", F.lit(False)).alias("is_bot"))


def user_by_name(users: DataFrame, name: str) -> DataFrame:
    """The first user whose real or display name contains the name, or whose account is it."""
    test = contains(F.col("real_name"), name) | contains(F.col("display_name"), name) | F.coalesce(F.lower("name") == name.lower(), F.lit(False))
    return users.where(test).orderBy("ord").limit(1).select("id")


def name_of(users: DataFrame, ids: DataFrame, column: str = "user") -> DataFrame:
    """``ids`` with ``user_name``; an unknown id is its own name."""
    names = user_names(users).select(F.col("id").alias(column), F.col("name").alias("user_name"))
    return ids.join(names, column, "left").withColumn("user_name", F.coalesce("user_name", column))


def channels(messages: DataFrame) -> DataFrame:
    """Distinct channels that are not hidden."""
    return messages.select("channel").where(~F.col("channel").startswith(".")).distinct()


def person_topics(people: DataFrame, name: str) -> DataFrame:
    """Topics of the first person whose name contains the name or is contained in it."""
    low = F.lower("name")
    found = people.where(contains(F.col("name"), name) | F.coalesce(F.lit(name.lower()).contains(low), F.lit(False)))
    return found.orderBy("ord").limit(1).select("name", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))


def authors_by_topic(people: DataFrame, topic: str) -> DataFrame:
    """People with a topic that contains the topic, those of most works first."""
    found = people.where(any_contains(F.col("topics"), topic)).withColumn("works_count", F.coalesce("works_count", F.lit(0)))
    return found.select("name", "role", "institution", "topics", "works_count", "ord").orderBy(F.desc("works_count"), "ord")


def _first(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The first ``most`` rows with their numbers."""
    kept = rows.orderBy(*order).limit(most)
    return kept.withColumn("n", F.row_number().over(Window.orderBy(*order)))  # at most ``most`` rows


def papers_by_topic(pubs: DataFrame, topic: str, most: int = 30) -> DataFrame:
    """Abstracts of the first publications with the topic in their title or topics."""
    found = pubs.where((contains(F.col("title"), topic) | any_contains(F.col("topics"), topic)) & (F.coalesce("abstract", F.lit("")) != ""))
    source = F.concat(F.lit("abstract:"), F.coalesce("doi", F.lit("unknown")))
    context = F.concat(F.lit(f"Topic: {topic}, Author: "), F.coalesce("owner", F.lit("Unknown")))
    rows = found.select("ord", F.col("abstract").alias("text"), F.lit("paper_abstract").alias("source_type"), source.alias("source_id"), F.col("year").cast("string").alias("timestamp"), context.alias("context"))
    return _first(rows, most, "ord")


def author_chunks(chunks: DataFrame, author: str) -> DataFrame:
    """Chunks of publications that mention the author."""
    return chunks.where(contains(F.col("source"), "pub") & contains(F.col("text"), author))


def author_samples(pubs: DataFrame, chunks: DataFrame, author: str, most: int = 50, titles: bool = True, abstracts: bool = True) -> DataFrame:
    """Titles and abstracts of an author's publications in order, then chunks that mention the author.  A publication
    begun is finished, so its abstract may be one more than ``most``."""
    mine = pubs.where(contains(F.col("owner"), author))
    source = lambda kind: F.concat(F.lit(kind), F.coalesce("doi", F.left("title", F.lit(30))))
    parts = []
    if titles:
        parts.append(F.struct(F.lit(0).alias("part"), F.col("title").alias("text"), F.lit("paper_title").alias("source_type"), source("paper:").alias("source_id")))
    if abstracts:
        parts.append(F.struct(F.lit(1).alias("part"), F.col("abstract").alias("text"), F.lit("paper_abstract").alias("source_type"), source("abstract:").alias("source_id")))
    none = pubs.sparkSession.createDataFrame([], "prio int, ord long, part int, text string, source_type string, source_id string")
    written = mine.select(F.lit(0).alias("prio"), F.col("ord").cast("long").alias("ord"), F.explode(F.array(*parts)).alias("p")).select("prio", "ord", "p.*") if parts else none
    written = written.where(F.coalesce("text", F.lit("")) != "")
    said = author_chunks(chunks, author).select(F.lit(1), F.col("ord").cast("long"), F.lit(0), "text", F.lit("paper_chunk"), F.concat(F.lit("chunk:"), F.coalesce("source", F.lit("unknown"))))
    rows = _first(written.union(said), most + 1, "prio", "ord", "part")
    begun = F.lag(F.struct("prio", "ord")).over(Window.orderBy("n")) == F.struct("prio", "ord")
    return rows.withColumn("_begun", F.coalesce(begun, F.lit(False)) & (F.col("prio") == 0)).where((F.col("n") <= most) | F.col("_begun")).drop("_begun", "prio", "part", "ord")


def transcript_sources(manifest: DataFrame) -> DataFrame:
    """Files of ``manifest(name, path, num_elements)`` that are transcripts by their path or name."""
    both = F.concat_ws("\n", F.lower("path"), F.lower("name"))
    return manifest.where(F.rlike(both, F.lit("|".join(w.replace(".", r"\.") for w in TRANSCRIPTS)))).select("name", "path", F.coalesce("num_elements", F.lit(0)).alias("num_elements"))


def chunks_by_source(chunks: DataFrame, pattern: str) -> DataFrame:
    return chunks.where(contains(F.col("source"), pattern))


def speaker_samples(manifest: DataFrame, chunks: DataFrame, speaker: str, wanted: tuple[str, ...] = (), most: int = 100, least: int = 30) -> DataFrame:
    """The first utterances of a speaker, by the chunk's speaker or its beginning, in the transcripts of the manifest."""
    files = transcript_sources(manifest)
    for_all = F.lit(not wanted)
    files = files.where(for_all | F.exists(F.array(*map(F.lit, wanted or ("",))), lambda w: F.contains(F.lower("path"), F.lower(w))))
    names = files.select(F.lower("name").alias("topic"), F.col("name").alias("file")).distinct()
    sources = chunks.select(F.lower("source").alias("about")).distinct()
    held = holding(names.select("topic").distinct(), sources).join(names, "topic")
    low = speaker.lower()
    begins = F.lower("text").startswith(low + ":")
    by_name = contains(F.col("speaker"), speaker)
    said = F.when(by_name, F.col("text")).when(begins, F.trim(F.substr("text", F.lit(len(low) + 2))))
    rows = chunks.withColumn("about", F.lower("source")).join(held, "about").withColumn("text", said).where(F.col("text").isNotNull() & (F.length("text") >= least))
    rows = rows.select("file", "ord", "text", F.lit("transcript").alias("source_type"), F.concat(F.lit("transcript:"), F.col("file")).alias("source_id"))
    return _first(rows, most, "file", "ord")
