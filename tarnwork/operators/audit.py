"""Bibliometric audit: document panel, title bins, proxy scores, quadrants and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HIGH_SIGNAL_VENUES, any_of, author_group, clean_key, compact_list, title_words
from .quantiles import quantiles


def document_panel(documents: DataFrame, edges: DataFrame, owners: DataFrame, people: DataFrame) -> DataFrame:
    """One row per document with its authors by edge, its profile owners, and their names and roles.

    ``documents(doc_id, title, doi, year, venue, citation_count, topics)``, ``edges(doc_id, person_id)``,
    ``owners(doi, title, person_id)``, ``people(person_id, name, role)``.
    """
    docs = documents.withColumn("paper_key", clean_key(F.col("doi"), F.col("title")))
    by_edge = edges.groupBy("doc_id").agg(F.array_sort(F.collect_set("person_id")).alias("edge_authors"))
    by_key = owners.select(clean_key(F.col("doi"), F.col("title")).alias("paper_key"), "person_id").groupBy("paper_key").agg(F.array_sort(F.collect_set("person_id")).alias("profile_owners"))
    none = F.array().cast("array<string>")
    rows = docs.join(by_edge, "doc_id", "left").join(by_key, "paper_key", "left")
    rows = rows.withColumn("edge_authors", F.coalesce("edge_authors", none)).withColumn("profile_owners", F.coalesce("profile_owners", none))
    rows = rows.withColumn("lab_links", F.array_sort(F.array_union("edge_authors", "profile_owners")))
    linked = rows.select("doc_id", F.posexplode("lab_links").alias("pos", "person_id")).join(people, "person_id")
    named = linked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "role"))).alias("p"))
    named = named.select("doc_id", F.transform("p", lambda x: x["name"]).alias("names"), F.transform("p", lambda x: x["role"]).alias("roles"))
    rows = rows.join(named, "doc_id", "left")
    count = F.col("citation_count").cast("double")
    return rows.select(
        "doc_id", "paper_key", "title", F.coalesce("doi", F.lit("")).alias("doi"), "year", F.coalesce("venue", F.lit("")).alias("venue"), count.isNull().alias("citation_missing"), count.alias("citation_count"), F.log1p(count).alias("log1p_citations"),
        title_words(F.col("title")).alias("title_word_count"), compact_list(F.col("edge_authors")).alias("edge_author_ids"), compact_list(F.col("profile_owners")).alias("profile_owner_ids"), compact_list(F.col("lab_links")).alias("lab_link_ids"),
        compact_list(F.coalesce("names", none)).alias("lab_author_names"), compact_list(F.coalesce("roles", none)).alias("lab_author_roles"), F.size("topics").alias("topic_count"), F.size("profile_owners").alias("profile_link_count"), F.size("lab_links").alias("lab_link_count"), compact_list(F.slice("topics", 1, 12)).alias("topics"),
    ).orderBy(F.desc("year"), "title")


def title_bins(rows: DataFrame) -> DataFrame:
    n = F.col("title_word_count")
    return rows.withColumn("title_bin", F.when(n <= 6, "<= 6 words").when(n <= 10, "7-10 words").when(n <= 14, "11-14 words").when(n <= 19, "15-19 words").otherwise(">= 20 words"))


def _unit(x):
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def proxy_scores(rows: DataFrame) -> DataFrame:
    """Text surprise, representation contrast and role-aware reward, each in 0..1.

    The 5 % and 95 % points of the title length are exact and interpolated; they are one row, joined back.
    """
    points = quantiles(rows, "title_word_count", {"low": 0.05, "high": 0.95})
    bounds = points.select(F.greatest(F.lit(1.0), "low").alias("_low"), F.col("high").alias("_high")).select("_low", F.greatest(F.col("_low") + 1, "_high").alias("_high"))
    rows = rows.join(F.broadcast(bounds))  # one row
    verbosity = _unit((F.col("title_word_count") - F.col("_low")) / (F.col("_high") - F.col("_low")))
    title = F.coalesce("title", F.lit(""))
    has = lambda s: title.contains(s).cast("double")
    commas = F.least(F.length(title) - F.length(F.replace(title, F.lit(","), F.lit(""))), F.lit(3)) / 3.0
    marks = _unit(has(":") * 0.40 + has("?") * 0.20 + commas * 0.25 + F.lower(title).contains(" and ").cast("double") * 0.15)
    breadth = _unit(F.col("topic_count") / 12.0)
    roles = F.filter(F.transform(F.split(F.coalesce("lab_author_roles", F.lit("")), ";"), lambda r: F.trim(r)), lambda r: r != "")
    diversity = _unit(F.size(F.array_distinct(roles)) / 4.0)
    venue = any_of([F.lower(F.coalesce("venue", F.lit(""))).contains(v) for v in HIGH_SIGNAL_VENUES]).cast("double")
    linked = _unit(F.col("profile_link_count") / 3.0)
    rows = rows.withColumn("text_surprise_score", _unit(0.84 * verbosity + 0.16 * marks))
    rows = rows.withColumn("representation_contrast_proxy", _unit(0.45 * breadth + 0.25 * diversity + 0.20 * venue + 0.10 * linked))
    return rows.withColumn("role_aware_reward", _unit(0.60 * F.col("representation_contrast_proxy") + 0.25 * diversity + 0.15 * linked)).drop("_low", "_high")


def quadrants(rows: DataFrame) -> DataFrame:
    """Median splits (the median itself on the low side) and the composition of authors."""
    sides = {"_text": "text_surprise_score", "_contrast": "representation_contrast_proxy"}
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).alias("v")) for n, c in sides.items()])).alias("s")).select("s.*")
    medians = quantiles(values, "v", {"median": 0.5}, "side")
    cut = medians.agg(*[F.max(F.when(F.col("side") == n, F.col("median"))).alias(n) for n in sides])
    rows = rows.join(F.broadcast(cut))  # one row
    text, contrast = F.col("text_surprise_score") > F.col("_text"), F.col("representation_contrast_proxy") > F.col("_contrast")
    name = F.when(~text & contrast, "Hidden Gem").when(text & contrast, "Aligned Surprise").when(~text & ~contrast, "Routine").when(text & ~contrast, "False Positive").otherwise("Unclassified")
    return rows.withColumn("reward_quadrant", name).withColumn("author_composition", author_group(F.col("lab_author_roles"))).drop("_text", "_contrast")


def summarize(rows: DataFrame, by: str, means: tuple[str, ...] = ()) -> DataFrame:
    """Rows, rows with citations, mean and median citations, and means of scores per group."""
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), F.count("citation_count").alias("n_with_citations"), F.avg("citation_count").alias("mean_citations"), *[F.avg(m).alias(f"mean_{m}") for m in means])
    points = quantiles(rows, "citation_count", {"median_citations": 0.5}, by).withColumnRenamed(by, "_of")
    return sums.join(points, F.col(by).eqNullSafe(F.col("_of"))).drop("_of")


def hidden_ratio(summary: DataFrame) -> DataFrame:
    """Mean citations of hidden gems over those of false positives; null unless both are there and the latter positive."""
    of = lambda name: F.max(F.when(F.col("reward_quadrant") == name, F.col("mean_citations")))
    return summary.agg(of("Hidden Gem").alias("h"), of("False Positive").alias("f")).select(F.when(F.col("f") > 0, F.col("h") / F.col("f")).alias("ratio"))
