"""Routing, weights, intent and confidence over queries made from events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import retrieval as R
from ..plans import confidence as C
from ..plans import routing as Q
from ..session import table
from ._book import Book

BOOK = Book()
_ASKED = (
    "who is jane doe", "papers about graph networks and their growth over time in many fields of research", "list all faculty", "compare gears and bolts", "gear prices", "how are rings and plates related", "Explain the methodology of the approach",
    "who works on large scale network inference", "what datasets do we have?", "when was the lab founded", "upcoming meetings in 2027", "what happened in 2019", '"exact phrase" gear', "Jane Doe", "impact of widgets", "current state of 2024 gears", "jane doe's email", "how many postdocs", "tell me more about it", "bolts and plates or rings",
)
#: Questions made of each part, by its key.
_FRAMES = (
    "who is {}", "papers about {} and their growth", "list all {}", "compare {} and bolts", "{} prices in 2019", "how are {} and plates related", "who works on {}", "what datasets do we have on {}?", "tell me more about {}", "upcoming {} in 2027", '"{}" exactly',
    "show me the {} or the bolts", "explain the connection of {} to its parts", "what is a {}", "how to install the {}", "help me with {}", "same {} as above", "synthesize the literature on {}", "latest version of {} and all of the others beyond it, as well as those that came before and after in many years of work",
)


def asked_sql(fixed: tuple[str, ...]) -> str:
    """A CTE ``q(query_id, query)``: fixed queries, a question about each part, and all that users say."""
    values = ", ".join("({}, '{}')".format(i, q.replace("'", "''")) for i, q in enumerate(fixed))
    frames = " ".join("WHEN {} THEN '{}' || p_name || '{}'".format(i, *(x.replace("'", "''") for x in f.split("{}"))) for i, f in enumerate(_FRAMES))
    return f"""q AS (SELECT CAST(query_id AS BIGINT) AS query_id, query FROM (VALUES {values}) v(query_id, query) UNION ALL SELECT 1000000 + p_partkey, CASE p_partkey % {len(_FRAMES)} {frames} END FROM part
        UNION ALL SELECT 1000000000000 + conv_id * 10000 + turn, text FROM conversations WHERE role = 'user' AND text IS NOT NULL)"""


def asked(spark: SparkSession, d: str, fixed: tuple[str, ...]) -> DataFrame:
    """The table of ``asked_sql``."""
    known = spark.createDataFrame(list(enumerate(fixed)), "query_id long, query string")
    k = F.col("p_partkey")
    frames = F.coalesce(*[F.when(k % len(_FRAMES) == i, F.concat(F.lit(f.split("{}")[0]), F.col("p_name"), F.lit(f.split("{}")[1]))) for i, f in enumerate(_FRAMES)])
    parts = table(spark, d, "part").select((k + 1_000_000).cast("long"), frames)
    said = table(spark, d, "conversations").where("role = 'user' and text is not null").select((F.col("conv_id") * 10_000 + F.col("turn") + 1_000_000_000_000).cast("long"), "text")
    return known.union(parts).union(said)


_VALUES = asked_sql(_ASKED)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d, _ASKED)


def _first(patterns: tuple) -> str:
    return "coalesce(" + ", ".join("CASE WHEN regexp_matches(lower(trim(query)), '{}') THEN '{}' END".format(p.replace("'", "''"), k) for p, k in patterns) + ")"


def _hits(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(lower(query), '{w}')::INT" for w in words) + ")"


@BOOK.add(f"""WITH {_VALUES}, m AS (SELECT *, {_first(Q.SIMPLE)} AS s, {_first(Q.COMPLEX)} AS c, len(list_filter(string_split_regex(trim(query), '\\s+'), lambda w: w <> '')) AS n,
    least(({_hits(Q.KEYWORDS['high'])} + 0.5::DOUBLE * {_hits(Q.KEYWORDS['medium'])}) / greatest({_hits(Q.KEYWORDS['high'])} + {_hits(Q.KEYWORDS['medium'])} + {_hits(Q.KEYWORDS['low'])}, 1), 1.0::DOUBLE) AS k FROM q)
    SELECT query_id, coalesce(s, c) AS pattern, CASE WHEN s IS NOT NULL THEN 'registry_only' WHEN c IS NOT NULL THEN 'rag_only' ELSE 'hybrid' END AS decision,
    CASE WHEN s IS NOT NULL THEN CASE WHEN n <= 5 THEN 0.98::DOUBLE WHEN n > 10 THEN 0.85::DOUBLE ELSE 0.95::DOUBLE END WHEN c IS NOT NULL THEN round(least(0.85::DOUBLE + CASE WHEN n > 10 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN k > 0.5 THEN 0.05::DOUBLE ELSE 0 END, 0.95::DOUBLE), 6) ELSE 0.5::DOUBLE END AS route_confidence FROM m""")
def route_query(spark: SparkSession, d: str) -> DataFrame:
    return Q.route(_asked(spark, d)).select("query_id", "pattern", "decision", "route_confidence")


@BOOK.add("""WITH c AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'structured' WHEN 1 THEN 'semantic' ELSE 'hybrid' END AS kind, (event_id % 11) / 10.0::DOUBLE AS belief, event_id % 5 AS t FROM events)
    SELECT event_id, CASE WHEN kind = 'structured' AND belief >= 0.9 THEN 'registry_only' WHEN kind = 'semantic' THEN 'rag_only' WHEN kind = 'structured' AND belief < 0.7 THEN 'hybrid' WHEN t = 0 THEN 'rag_only' WHEN t = 1 THEN 'registry_only' WHEN t = 2 THEN 'rag_only' ELSE 'hybrid' END AS decision FROM c""")
def route_classified(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    types = F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 5 == 1, F.array(F.lit("people"))).when(i % 5 == 2, F.array(F.lit("topics"))).when(i % 5 == 3, F.array(F.lit("people"), F.lit("topics"))).otherwise(F.array(F.lit("other")))
    rows = table(spark, d, "events").select("event_id", F.lit("zzz").alias("query"), F.when(i % 3 == 0, "structured").when(i % 3 == 1, "semantic").otherwise("hybrid").alias("kind"), ((i % 11) / 10.0).alias("belief"), types.alias("types"))
    return Q.route(rows, "query", "types", "kind", "belief").select("event_id", "decision")


@BOOK.add(f"""WITH {_VALUES}, k AS (SELECT query_id, CASE WHEN regexp_matches(query, '{R.EXACT}') THEN 'exact_match' WHEN regexp_matches(query, '{R.NAME}') THEN 'name_lookup' WHEN regexp_matches(query, '{R.CONCEPTUAL}') THEN 'conceptual' ELSE 'mixed' END AS query_type FROM q)
    SELECT query_id, query_type, CASE query_type WHEN 'exact_match' THEN 0.3::DOUBLE WHEN 'name_lookup' THEN 0.5::DOUBLE WHEN 'conceptual' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS semantic FROM k""")
def adaptive_weights(spark: SparkSession, d: str) -> DataFrame:
    return R.adaptive_weights(_asked(spark, d)).select("query_id", "query_type", "semantic")


@BOOK.add(f"""WITH {_VALUES}, y AS (SELECT *, list_transform(regexp_extract_all(query, '\\b((?:19|20)\\d{{2}})\\b', 1), lambda x: CAST(x AS INT)) AS ys, lower(query) AS l FROM q)
    SELECT query_id, ys AS years, CASE WHEN regexp_matches(l, '{D.INTENTS['historical']}') THEN 'historical' WHEN regexp_matches(l, '{D.INTENTS['future']}') THEN 'future' WHEN regexp_matches(l, '{D.INTENTS['current']}') THEN 'current' WHEN len(ys) > 0 AND list_max(ys) < 2026 THEN 'past' WHEN len(ys) > 0 AND list_min(ys) > 2026 THEN 'future'
    WHEN list_contains(ys, 2026) THEN 'current' WHEN regexp_matches(l, '{D.INTENTS['past']}') THEN 'past' ELSE 'any' END AS intent FROM y""")
def temporal_intent(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    return _asked(spark, d).select("query_id", F.transform(D.years_in(q), lambda y: y.cast("int")).alias("years"), D.temporal_intent(q, 2026).alias("intent"))


@BOOK.add("""WITH s AS (SELECT source, doc_id, CASE doc_id % 4 WHEN 0 THEN 'registry' WHEN 1 THEN 'document' WHEN 2 THEN 'web' ELSE 'inference' END AS type, (doc_id % 10) / 10.0::DOUBLE AS relevance FROM documents),
    a AS (SELECT source, count(*) AS n, avg(CASE type WHEN 'registry' THEN 1.0::DOUBLE WHEN 'document' THEN 0.8::DOUBLE WHEN 'web' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END) AS q, avg(relevance) AS r, bool_or(type = 'registry') AS st, list(relevance ORDER BY doc_id)[1:3] AS near FROM s GROUP BY source),
    f AS (SELECT source, n, round(0.15::DOUBLE * CASE WHEN n = 1 THEN 0.5::DOUBLE WHEN n <= 3 THEN 0.7::DOUBLE ELSE least(0.9::DOUBLE, 0.7::DOUBLE + n * 0.05::DOUBLE) END + 0.25::DOUBLE * q + 0.2::DOUBLE * CASE WHEN st THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END + 0.1::DOUBLE + 0.15::DOUBLE * list_sum(near) / len(near) + 0.15::DOUBLE * r, 6) AS score FROM a)
    SELECT source, n, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' WHEN score >= 0.4 THEN 'low' ELSE 'uncertain' END AS level FROM f""")
def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select("source", "doc_id", F.when(k % 4 == 0, "registry").when(k % 4 == 1, "document").when(k % 4 == 2, "web").otherwise("inference").alias("type"), ((k % 10) / 10.0).alias("relevance"))
    return C.confidence(rows, "source", similarity="relevance", order="doc_id")


_INTENTS = {"person": (r"\bwho\b", r"\bjane\b"), "topic": (r"\bpapers?\b", r"\bnetworks?\b", r"\bmethodology\b"), "list": (r"\blist\b", r"\bhow many\b"), "thing": (r"\bgears?\b", r"\bbolts?\b")}


@BOOK.add(f"WITH {_VALUES}, v AS (SELECT query_id, " + ", ".join("(" + " + ".join(f"regexp_matches(lower(query), '{p}')::INT" for p in ps) + f") AS {k}" for k, ps in _INTENTS.items()) + """ FROM q)
    SELECT query_id, CASE WHEN greatest(person, topic, list, thing) = 0 THEN NULL WHEN person = greatest(person, topic, list, thing) THEN 'person' WHEN topic = greatest(topic, list, thing) THEN 'topic' WHEN list = greatest(list, thing) THEN 'list' ELSE 'thing' END AS intent,
    round(greatest(person, topic, list, thing) / nullif(person + topic + list + thing, 0)::DOUBLE, 6) AS share FROM v""")
def intent_vote(spark: SparkSession, d: str) -> DataFrame:
    return Q.vote_intent(_asked(spark, d), _INTENTS).select("query_id", "intent", "share")


@BOOK.add(f"WITH {_VALUES} SELECT query_id, len(list_distinct(list_concat([query], list_transform(string_split_regex(query, '(?i)\\s+(?:and|or)\\s+'), lambda p: trim(p))))) AS n_parts, list_distinct(regexp_extract_all(query, '\\b[A-Z][a-z]+(?:\\s+[A-Z]\\.)?(?:\\s+[A-Z][a-z]+){{1,2}}\\b')) AS names FROM q")
def subqueries_names(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("query_id", F.size(Q.subqueries(F.col("query"))).alias("n_parts"), Q.person_names(F.col("query")).alias("names"))


#: The acronyms, once more, so that a wrong one shows.
_ACRONYMS = {"ai": "artificial intelligence", "ml": "machine learning", "nlp": "natural language processing", "llm": "large language model", "nsf": "national science foundation", "nih": "national institutes of health"}


@BOOK.add(f"""WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'AI paint of ' || p_name || ' for ml' WHEN 1 THEN p_name || ' llm nih' ELSE p_name || ' mail' END AS query FROM part),
    v AS (SELECT p_partkey, list_concat([query], list_filter([{', '.join(f"CASE WHEN list_contains(string_split(lower(query), ' '), '{a}') THEN replace(lower(query), '{a}', '{full}') END" for a, full in _ACRONYMS.items())}], lambda x: x IS NOT NULL)) AS v FROM n)
    SELECT p_partkey, unnest(v) AS variant, generate_subscripts(v, 1) - 1 AS position FROM v""")
def acronym_expansion(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    query = F.when(k % 3 == 0, F.concat(F.lit("AI paint of "), name, F.lit(" for ml"))).when(k % 3 == 1, F.concat(name, F.lit(" llm nih"))).otherwise(F.concat(name, F.lit(" mail")))
    return table(spark, d, "part").select("p_partkey", F.posexplode(T.acronym_variants(query)).alias("position", "variant"))


@BOOK.add("SELECT s_suppkey, s_name || ': member of NATION_' || s_nationkey AS summary, CASE WHEN s_suppkey % 4 = 0 THEN 'Associate' ELSE 'Jane' END AS name FROM supplier")
def entity_texts(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.enrichment import clean_name

    rows = table(spark, d, "supplier")
    title = F.when(F.col("s_suppkey") % 4 == 0, "Prof. Associate").otherwise("Dr.  Jane")
    return rows.select("s_suppkey", F.format_string("%s: member of NATION_%d", "s_name", "s_nationkey").alias("summary"), clean_name(title).alias("name"))
