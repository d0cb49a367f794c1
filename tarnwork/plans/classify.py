"""Classification of queries by pattern tables, and compound filters.  The tables are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a role is called.
ROLES = {"student": ("student", "students", "phd", "phd student", "phd students"), "faculty": ("faculty", "professor", "professors", "director"), "postdoc": ("postdoc", "postdocs", "postdoctoral"), "researcher": ("researcher", "researchers", "scientist", "scholar")}


def first_in(text: Column, table: dict[str, str]) -> Column:
    """The value of the first key that the text holds as a substring."""
    return F.coalesce(*[F.when(text.contains(key), F.lit(value)) for key, value in table.items()], F.lit(None).cast("string"))


def normalize(value: Column, table: dict[str, str], endings: tuple[str, ...] = ("university", "institute", "college")) -> Column:
    """The canonical name: by equality, then by containment either way, then title case if it looks like one; else null."""
    low = F.lower(F.trim(value))
    exact = F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in table.items()], F.lit(None).cast("string"))
    near = F.coalesce(*[F.when(low.contains(k) | F.lit(k).contains(low), F.lit(v)) for k, v in table.items()], F.lit(None).cast("string"))
    looks = sum((low.contains(e).cast("int") for e in endings), F.lit(0)) > 0
    return F.coalesce(exact, near, F.when(looks, F.initcap(value)))


def role(text: Column, roles: dict[str, tuple[str, ...]] | None = None) -> Column:
    return first_in(text, {variant: name for name, variants in (roles or ROLES).items() for variant in variants})


def normalize_role(value: Column, roles: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The role that a name equals, else the first that contains it or that it contains; else null."""
    low, table = F.trim(F.lower(value)), roles or ROLES
    exact = [F.when(low.isin(*variants), F.lit(name)) for name, variants in table.items()]
    near = [F.when(low.contains(v) | F.lit(v).contains(low), F.lit(name)) for name, variants in table.items() for v in variants]
    return F.coalesce(*exact, *near, F.lit(None).cast("string"))


#: Kinds of queries whose patterns are surer than others.
SURE = ("comparison", "publication_count", "citations", "h_index", "contact", "collaborators", "research_interests")
LIKELY = ("person_lookup", "topic_search", "project_members", "publication_search")


def pattern_confidence(query: Column, matched: Column, subtype: Column) -> Column:
    """By the kind of query 0.85 to 0.95, and 0.05 more if the match covers over 0.7 of it, at most 1."""
    base = F.when(subtype.isin(*LIKELY), 0.90).when(subtype.isin(*SURE), 0.95).otherwise(0.85)
    covers = F.length(matched) / F.greatest(F.length(query), F.lit(1)) > 0.7
    return F.round(F.when(covers, F.least(base + 0.05, F.lit(1.0))).otherwise(base), 6)


def keywords(entities: DataFrame) -> DataFrame:
    """Distinct keywords of ``entities(kind, name)``: words of 3 or more letters of people's and datasets' names, of 4 or
    more of topics and descriptions (these only letters), other names whole."""
    low, kind = F.lower("name"), F.col("kind")
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    of = (
        F.when(kind.isin("person", "dataset", "resource"), F.filter(words, lambda w: F.length(w) >= 3))
        .when(kind == "topic", F.filter(words, lambda w: F.length(w) >= 4))
        .when(kind == "description", F.filter(words, lambda w: (F.length(w) >= 4) & w.rlike(r"^\p{L}+$")))
        .when(kind.isin("owner", "file"), F.filter(F.array(low), lambda w: F.length(w) >= 3))
        .otherwise(F.array(low))
    )
    return entities.where("name is not null").select(F.explode(of).alias("keyword")).distinct()


def compound(queries: DataFrame, institutions: dict[str, str], query: str = "query") -> DataFrame:
    """Adds ``institution``, ``role``, ``topic`` and ``is_compound`` (at least two of them)."""
    low = F.lower(query)
    raw = F.coalesce(F.nullif(F.regexp_extract(low, r"(?:working\s+on|studying|researching|in|on)\s+(.+?)(?:\s+at|\s+from|\?|$)", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"(.+?)\s+research(?:ers?)?", 1), F.lit("")))
    skip = [*institutions, *(v for vs in ROLES.values() for v in vs), "who", "what", "find", "list", "show", "the", "are", "is"]
    words = F.filter(F.split(raw, r"\s+"), lambda w: ~w.isin(*skip) & (w != ""))
    out = queries.withColumn("institution", first_in(low, institutions)).withColumn("role", role(low)).withColumn("topic", F.nullif(F.array_join(words, " "), F.lit("")))
    found = sum((F.col(c).isNotNull().cast("int") for c in ("institution", "role", "topic")), F.lit(0))
    return out.withColumn("is_compound", found >= 2)


def classify(queries: DataFrame, patterns: list[tuple[str, str, float]], keywords: dict[str, tuple[str, ...]], institutions: dict[str, str], names: Column | None = None, query: str = "query") -> DataFrame:
    """``query_type``, ``subtype``, ``confidence``: compound, then ordered ``patterns`` (regex, subtype, confidence), then
    ``keywords`` of entity types, then names of people, then semantic."""
    low = F.lower(F.trim(query))
    rows = compound(queries, institutions, query)
    hit = F.coalesce(*[F.when(F.rlike(low, F.lit(p)), F.struct(F.lit(s).alias("subtype"), F.lit(c).alias("confidence"))) for p, s, c in patterns], F.lit(None).cast("struct<subtype:string,confidence:double>"))
    types = F.filter(F.array(*[F.when(sum((low.contains(w).cast("int") for w in ws), F.lit(0)) > 0, F.lit(t)) for t, ws in keywords.items()]), lambda t: t.isNotNull())
    named = F.size(names) > 0 if names is not None else F.lit(False)
    rows = rows.withColumn("_hit", hit).withColumn("entity_types", F.when(F.col("is_compound"), F.array(F.lit("people"))).otherwise(types))
    kind = F.when(F.col("is_compound") | F.col("_hit").isNotNull() | named, "structured").when(F.size("entity_types") > 0, "hybrid").otherwise("semantic")
    sure = F.when(F.col("is_compound"), 0.9).when(F.col("_hit").isNotNull(), F.col("_hit.confidence")).when(F.size("entity_types") > 0, 0.7).when(named, 0.8).otherwise(0.5)
    return rows.withColumn("query_type", kind).withColumn("subtype", F.when(F.col("is_compound"), "compound").otherwise(F.col("_hit.subtype"))).withColumn("confidence", sure).drop("_hit")
