"""Planning queries: what a query is, how good a result is, what to ask instead, and whole answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import profiles as P
from ..operators import answers as A
from ..operators import registry as R
from ..operators import suggest as S
from ..plans import classify as K
from ..plans import confidence as C
from ..plans import fallbacks as B
from ..plans import routing as Q
from ..plans import steps as X
from ..session import documents, table
from ._book import Book, sql_bm25, sql_quoted
from .routing import _ASKED, asked, asked_sql

BOOK = Book()
#: More queries, for the rules that those of routing don't reach.
_MORE = (
    "What is the deadline for gears", "please synthesize the literature on gears", "show me the bolts", "compare gears to bolts", "what did the author say", "the same as above", "latest version of numpy", "how to install the tool",
    "a query of exactly ten words that has no pattern here", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty one two three four five six",
    "one two three four five six seven eight nine ten eleven twelve", "who's ann", "what is a gear", "gears and bolts", "help me", "setup error", "his gears", "tell me more about gears", "state of the art", "find the document on rings",
)
_TEXTS = (*_ASKED, *_MORE)
_ALL = asked_sql(_TEXTS)


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d, _TEXTS)


def _any(column: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


_PLAIN_SQL = "^what is (the |a )?deadline|^when (is|was|did)|^who (is|was|did)|^where (is|was)|^how many|^what (was|is) (the )?(date|time|name|title)|^which|^link to|^find (the )?(chat|conversation|message|document)|^show me (the )?|^list (the |all )?"
_HARD_SQL = "synthesize|compare.*to|relationship between|how does.*relate|explain (the )?(connection|difference|relationship)|implications of|what are (all |the )?(ways|methods|approaches)|analyze|critique|evaluate|multi.?perspective|deep dive"


@BOOK.add(f"WITH {_ALL}, w AS (SELECT *, lower(query) AS l, len(regexp_extract_all(query, '\\S+')) AS n FROM q) SELECT query_id, CASE WHEN regexp_matches(l, '{_PLAIN_SQL}') THEN 'simple' WHEN regexp_matches(l, '{_HARD_SQL}') THEN 'complex' WHEN n < 10 THEN 'simple' WHEN n > 25 THEN 'complex' ELSE 'medium' END AS complexity FROM w")
def query_complexity(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", Q.query_complexity(F.col("query")).alias("complexity"))


@BOOK.add(f"WITH {_ALL} SELECT query_id, regexp_matches(query, '(?i)\\b(he|him|his|she|her|hers|they|them|their|theirs|it|its|that|this|these|those|the person|the researcher|the professor|the author|same|above|mentioned|discussed)\\b') AS needs FROM q")
def needs_reformulation(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", Q.needs_reformulation(F.col("query")).alias("needs"))


_FOLLOW_SQL = [" his ", " her ", " their ", " its ", " he ", " she ", " they ", " it ", " him ", " them ", "his ", "her ", "their ", " that ", " this ", " those ", " these ", " same ", " similar ", "'s ", "more about", "tell me more", "what else", "follow up", "following up"]


@BOOK.add(f"WITH {_ALL} SELECT query_id, {_any('lower(query)', _FOLLOW_SQL)} OR " + " OR ".join("starts_with(lower(query), '{}')".format(w.strip().replace("'", "''")) for w in _FOLLOW_SQL) + " AS follows FROM q")
def follow_up(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", Q.follows(F.col("query")).alias("follows"))


@BOOK.add(f"WITH {_ALL} SELECT query_id, regexp_matches(lower(query), 'latest version|current version|newest version|how (to|do i) install|documentation for|docs for|tutorial|guide for|pytorch|tensorflow|numpy|pandas|scikit|(conda|pip) install|error message|stack trace|api reference|official docs|beyond (the lab|it)|outside the lab|in general|more broadly|in the field|(recent|latest|current) trends|state.of.the.art|(recent|latest) (developments|research)|recent papers|what''?s new in|(industry|academic) trends|compared to other|how does this compare|elsewhere|other (labs|researchers)') AS external FROM q")
def looks_external(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", Q.looks_external(F.col("query")).alias("external"))


_JOINED_SQL = [" and ", " or ", " compare ", " versus ", " vs ", " relationship ", " between ", " both ", " multiple ", " all ", " similar to ", " like ", " as well as ", " along with ", " together "]


@BOOK.add(f"""WITH {_ALL}, w AS (SELECT *, lower(trim(query)) AS l, len(regexp_extract_all(query, '\\S+')) AS n FROM q), f AS (SELECT *, starts_with(l, 'who is ') OR starts_with(l, 'who''s ') OR starts_with(l, 'what is ') AS asks FROM w)
    SELECT query_id, (n <= 5 AND asks) OR (n <= 10 AND NOT {_any('l', _JOINED_SQL)}) AS simple,
    CASE WHEN asks THEN 'search_registry' WHEN regexp_matches(l, 'how do i|how to|setup|install|error') THEN 'search_docs' WHEN regexp_matches(l, 'what can you|help me|your capabilities') THEN 'direct_answer' ELSE 'search_registry' END AS action,
    CASE WHEN asks THEN 'lookup' WHEN regexp_matches(l, 'how do i|how to|setup|install|error') THEN 'technical' WHEN regexp_matches(l, 'what can you|help me|your capabilities') THEN 'explore' ELSE 'lookup' END AS intent FROM f""")
def plan_is_simple(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    return _queries(spark, d).select("query_id", X.simple(q).alias("simple"), X.action(q).alias("a")).select("query_id", "simple", "a.action", "a.intent")


def _quality(a: float, b: float, direct: bool) -> str:
    plain = f"CASE WHEN s > 0 THEN least(1.0::DOUBLE, 0.7::DOUBLE + {a}::DOUBLE * s) WHEN m > 0 THEN least(0.8::DOUBLE, 0.4::DOUBLE + {b}::DOUBLE * m) ELSE 0.2::DOUBLE END"
    return f"round(CASE WHEN e THEN 0.0::DOUBLE {'WHEN w THEN 0.9::DOUBLE' if direct else ''} ELSE {plain} END, 6)"


@BOOK.add(f"WITH r AS (SELECT event_id, event_id % 4 AS s, event_id % 9 AS m, event_id % 23 = 0 AS w, event_id % 29 = 0 AS e FROM events) SELECT event_id, {_quality(0.05, 0.08, True)} AS run, {_quality(0.1, 0.1, False)} AS planned, CASE WHEN m = 0 THEN 0.2::DOUBLE ELSE round(least(0.9::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * m), 6) END AS listed FROM r")
def step_quality(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    args = (i % 4, i % 9, i % 23 == 0, i % 29 == 0)
    return table(spark, d, "events").select("event_id", X.result_quality(*args).alias("run"), X.result_quality(*args, per=X.PLANNED).alias("planned"), X.list_quality(i % 9).alias("listed"))


@BOOK.add("""WITH t AS (SELECT doc_id, lower(text) AS l, text, length(text) AS n FROM documents) SELECT doc_id, CASE WHEN text IS NULL THEN 0.0::DOUBLE WHEN n < 50 THEN 0.2::DOUBLE WHEN contains(l, 'error') OR contains(l, 'not found') THEN 0.1::DOUBLE WHEN contains(l, 'no results') THEN 0.15::DOUBLE ELSE round(least(0.8::DOUBLE, 0.5::DOUBLE + least(0.3::DOUBLE, n / 1000.0::DOUBLE)), 6) END AS run,
    CASE WHEN text IS NULL THEN 0.0::DOUBLE WHEN n < 50 THEN 0.2::DOUBLE WHEN contains(l, 'error') OR contains(l, 'not found') THEN 0.1::DOUBLE ELSE 0.6::DOUBLE END AS planned FROM t""")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.text_quality(F.col("text")).alias("run"), X.text_quality(F.col("text"), True).alias("planned"))


_CONF_SQL = """s AS (SELECT source, doc_id, CASE WHEN doc_id % 9 < 7 THEN 'document' WHEN doc_id % 9 = 7 THEN 'web' ELSE 'registry' END AS type, (doc_id % 10) / 9.0::DOUBLE AS sim FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'nothing', -1, NULL, 0.3 UNION ALL SELECT 'sole', -2, 'web', 0.9)"""


@BOOK.add(f"""WITH {_CONF_SQL}, k AS (SELECT source, type, count(*) AS n, min(doc_id) AS first FROM s WHERE type IS NOT NULL GROUP BY 1, 2), a AS (SELECT source, count(type) AS n, max(sim) AS most, min(sim) AS least, bool_or(type = 'registry') AS reg, max(type) AS one FROM s GROUP BY 1)
    SELECT source, CASE WHEN coalesce(reg, false) THEN 'Found structured registry data. ' ELSE '' END || CASE WHEN n = 0 THEN 'No sources found' WHEN n = 1 THEN 'Based on single source (' || one || ')' ELSE 'Based on ' || n || ' sources (' || (SELECT string_agg(k.n || ' ' || k.type, ', ' ORDER BY first) FROM k WHERE k.source = a.source) || ')' END
    || CASE WHEN most < 0.5 THEN '. Low semantic match to query' WHEN most > 0.8 THEN '. High semantic relevance' ELSE '' END || CASE WHEN least < 0.7 THEN '. Query intent unclear' ELSE '' END AS reason FROM a""")
def confidence_reasons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 9
    kind = F.when(k < 7, "document").when(k == 7, "web").otherwise("registry")
    rows = table(spark, d, "documents").where("source is not null").select("source", "doc_id", kind.alias("type"), ((F.col("doc_id") % 10) / 9.0).alias("sim"))
    more = spark.createDataFrame([("nothing", -1, None, 0.3), ("sole", -2, "web", 0.9)], "source string, doc_id long, type string, sim double")
    return C.reasons(rows.union(more), "source", order="doc_id", similarity=F.max("sim"), classification=F.min("sim"))


@BOOK.add("""SELECT 'registry' AS type, CASE p_partkey % 4 WHEN 0 THEN coalesce(p_name, 'Unknown') || ' profile' WHEN 1 THEN p_name WHEN 2 THEN left(p_name || ' ' || repeat(p_type, 12), 50) ELSE 'dataset' END AS name,
    CASE p_partkey % 4 WHEN 0 THEN p_name || ' profile (registry)' WHEN 1 THEN p_name || ' (registry)' WHEN 2 THEN left(p_name || ' ' || repeat(p_type, 12), 50) || ' (registry publication)' ELSE 'dataset (registry)' END AS citation, CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE ELSE p_size / 50.0::DOUBLE END AS relevance, CASE WHEN p_partkey % 4 IN (0, 2) THEN p_brand END AS url FROM part
    UNION ALL SELECT 'document', CASE WHEN doc_id % 2 = 0 THEN 'c' || doc_id ELSE source END, CASE WHEN doc_id % 2 = 0 THEN 'c' || doc_id ELSE source END, CASE WHEN doc_id % 5 = 0 THEN 0.5::DOUBLE ELSE (doc_id % 10) / 10.0::DOUBLE END, NULL FROM documents WHERE source IS NOT NULL""")
def source_extraction(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, "person").when(k == 1, "project").when(k == 2, "publication").otherwise("dataset")
    found = table(spark, d, "part").select(kind.alias("type"), F.when(k < 3, F.col("p_name")).alias("name"), F.concat_ws(" ", "p_name", F.repeat("p_type", F.lit(12))).alias("title"), F.col("p_brand").alias("url"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") / 50.0).alias("score"))
    i = F.col("doc_id")
    near = table(spark, d, "documents").where("source is not null").select(F.when(i % 2 == 0, F.concat(F.lit("c"), i.cast("string"))).alias("citation"), F.col("source").alias("source_file"), F.when(i % 5 != 0, (i % 10) / 10.0).alias("score"))
    return C.sources(found, near)


@BOOK.add("SELECT 'web' AS type, coalesce(lang, 'Web Result') AS name, coalesce(lang, 'Web Result') AS citation, greatest(0.5::DOUBLE, round(1.0::DOUBLE - (doc_id % 12) * 0.1::DOUBLE, 6)) AS relevance, coalesce(source, '') AS url FROM documents")
def web_sources(spark: SparkSession, d: str) -> DataFrame:
    return C.web_sources(table(spark, d, "documents").select((F.col("doc_id") % 12).alias("rank"), F.col("lang").alias("title"), F.col("source").alias("url")))


_INTENT_WORDS = ("Lookup", " technical ", "look_up", "debug", "analysis", "collaborate", "unclear", "nonsense", "", "explore", "Find")


@BOOK.add(f"""WITH n AS (SELECT event_id, CASE event_id % 12 {' '.join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_INTENT_WORDS))} ELSE event_type END AS word FROM events)
    SELECT event_id, word, CASE lower(trim(word)) WHEN 'lookup' THEN 'lookup' WHEN 'technical' THEN 'technical' WHEN 'look_up' THEN 'lookup' WHEN 'debug' THEN 'technical' WHEN 'analysis' THEN 'explore' WHEN 'collaborate' THEN 'connect' WHEN 'explore' THEN 'explore' WHEN 'find' THEN 'lookup' ELSE 'ambiguous' END AS intent FROM n""")
def valid_intents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 12
    word = F.coalesce(*[F.when(k == i, w) for i, w in enumerate(_INTENT_WORDS)], F.col("event_type")).alias("word")
    return table(spark, d, "events").select("event_id", word).select("event_id", "word", Q.valid_intent(F.col("word")).alias("intent"))


@BOOK.add("WITH r AS (SELECT event_id, event_id % 3 AS s, event_id % 4 AS m, repeat('x', event_id % 100) AS t, event_id % 2 = 0 AS x, event_id % 31 = 0 AS e FROM events) SELECT event_id, e OR (s = 0 AND m = 0) OR (x AND s = 0) OR (s = 0 AND m > 0 AND length(t) < 50) AS weak FROM r")
def results_weak(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", Q.results_weak(i % 3, i % 4, F.repeat(F.lit("x"), (i % 100).cast("int")), i % 2 == 0, i % 31 == 0).alias("weak"))


#: The words that are no terms, once more, so that a wrong list shows.
_STOP_SQL = sql_quoted([
    "who", "what", "where", "when", "how", "why", "which", "is", "are", "was", "were", "be", "been", "being", "the", "a", "an", "and", "or", "but", "if",
    "then", "do", "does", "did", "done", "doing", "we", "i", "you", "they", "he", "she", "it", "have", "has", "had", "having", "all", "any", "some", "no",
    "not", "list", "tell", "me", "about", "describe", "show", "find", "get", "give", "can", "could", "would", "should", "may", "might", "on", "in", "at",
    "to", "for", "of", "with", "by", "from", "up", "down", "into", "onto", "upon", "this", "that", "these", "those", "there", "here", "please", "thanks",
    "thank",
])


@BOOK.add(f"""WITH {_ALL}, g AS (SELECT *, regexp_extract(lower(query), 'who (?:is|works on) (.+)', 1) AS g FROM q), c AS (SELECT query_id, query, CASE WHEN length(trim(trim(trim(g), '?.,!'))) > 2 THEN [trim(trim(trim(g), '?.,!'))] ELSE [] END AS held FROM g),
    w AS (SELECT query_id, held, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+') AS w FROM c) SELECT query_id, list_concat(held, list_filter(w, lambda x, i: length(x) > 2 AND NOT list_contains([{_STOP_SQL}], x) AND NOT list_contains(held, x) AND list_position(w, x) = i)) AS terms FROM w""")
def extract_terms(spark: SparkSession, d: str) -> DataFrame:
    group = F.array(F.regexp_extract(F.lower("query"), "who (?:is|works on) (.+)", 1))
    return _queries(spark, d).select("query_id", Q.search_terms(F.col("query"), group).alias("terms"))


@BOOK.add(f"WITH {_ALL} SELECT query_id, length(query) AS query_length, len(regexp_extract_all(query, '\\S+')) AS word_count, ends_with(trim(query), '?') AS has_question_mark FROM q")
def analyze_query(spark: SparkSession, d: str) -> DataFrame:
    return Q.analyze(_queries(spark, d)).select("query_id", "query_length", "word_count", "has_question_mark")


_SUBTYPES = {"who is": "person_lookup", "compare": "comparison", "list": "role_list"}


@BOOK.add(f"""WITH {_ALL}, m AS (SELECT query_id, query, regexp_extract(lower(query), '^(who is \\w+|compare \\w+|list \\w+)', 1) AS hit FROM q) SELECT query_id, CASE WHEN starts_with(hit, 'who is') THEN CASE WHEN length(hit) / length(query)::DOUBLE > 0.7 THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END
    WHEN starts_with(hit, 'compare') THEN CASE WHEN length(hit) / length(query)::DOUBLE > 0.7 THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END ELSE CASE WHEN length(hit) / length(query)::DOUBLE > 0.7 THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END END AS confidence FROM m WHERE hit <> ''""")
def pattern_confidence(spark: SparkSession, d: str) -> DataFrame:
    hit = F.regexp_extract(F.lower("query"), r"^(who is \w+|compare \w+|list \w+)", 1)
    kind = F.coalesce(*[F.when(F.col("hit").startswith(k), v) for k, v in _SUBTYPES.items()])
    return _queries(spark, d).withColumn("hit", hit).where("hit <> ''").select("query_id", K.pattern_confidence(F.col("query"), F.col("hit"), kind).alias("confidence"))


_ROLES = (("PhD", "student"), ("phd students", "student"), ("Professor of things", "faculty"), ("post", "postdoc"), ("the director", "faculty"), ("cook", None), ("Research Scientist", "researcher"), ("student", "student"))


@BOOK.add(f"""WITH n AS (SELECT c_custkey, CASE c_custkey % {len(_ROLES)} {' '.join(f"WHEN {i} THEN '{r}'" for i, (r, _) in enumerate(_ROLES))} END || CASE WHEN c_custkey % 3 = 0 AND c_custkey % {len(_ROLES)} <> 3 THEN ' ' || c_name ELSE '' END AS value FROM customer)
    SELECT c_custkey, value, CASE c_custkey % {len(_ROLES)} {' '.join(f"WHEN {i} THEN '{r}'" for i, (_, r) in enumerate(_ROLES) if r)} END AS role FROM n""")
def normalize_roles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % len(_ROLES)
    name = F.when((F.col("c_custkey") % 3 == 0) & (k != 3), F.concat(F.lit(" "), F.col("c_name"))).otherwise("")
    value = F.concat(F.coalesce(*[F.when(k == i, r) for i, (r, _) in enumerate(_ROLES)]), name)
    return table(spark, d, "customer").select("c_custkey", value.alias("value")).select("c_custkey", "value", K.normalize_role(F.col("value")).alias("role"))


@BOOK.add("""WITH w AS (SELECT unnest(string_split_regex(lower(p_name), '\\s+')) AS k FROM part UNION ALL SELECT unnest(string_split_regex(lower(c_name), '\\s+')) FROM customer)
    SELECT DISTINCT k AS keyword FROM w WHERE length(k) >= 3 UNION SELECT lower(s_name) FROM supplier UNION SELECT t FROM (SELECT unnest(string_split_regex(lower(p_type), '\\s+')) AS t FROM part) WHERE length(t) >= 4""")
def registry_keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda name, kind, column: table(spark, d, name).select(F.lit(kind).alias("kind"), F.col(column).alias("name"))
    return K.keywords(rows("part", "dataset", "p_name").union(rows("customer", "person", "c_name")).union(rows("supplier", "project", "s_name")).union(rows("part", "topic", "p_type")))


@BOOK.add(f"SELECT DISTINCT lower(s_name) AS term FROM supplier UNION SELECT DISTINCT lower(p_name) FROM part UNION SELECT unnest([{sql_quoted(list(S.COMMON))}])")
def query_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select(F.col("s_name").alias("name")).union(table(spark, d, "part").select("p_name"))
    return S.vocabulary(names)


_WANTED = ((1, "where is the openalex data", ("datasets",), 0), (2, "who works on gearz", ("people", "datasets"), 0), (3, "embedding", (), 0), (4, "gearz", (), 3), (5, "nothing", (), 0))


@BOOK.add("""SELECT * FROM (VALUES (1, true, NULL, ['What datasets are available?', 'Where is the [name] data?', 'What data snapshots are on the cluster?'], 'Try these queries:' || chr(10) || '  - What datasets are available?' || chr(10) || '  - Where is the [name] data?' || chr(10) || '  - What data snapshots are on the cluster?'),
    (2, true, 'who works on gears', ['Who works on [topic]?', 'List all researchers', 'What datasets are available?', 'Where is the [name] data?'], 'Did you mean: "who works on gears"?' || chr(10) || 'Try these queries:' || chr(10) || '  - Who works on [topic]?' || chr(10) || '  - List all researchers' || chr(10) || '  - What datasets are available?'),
    (3, true, NULL, ['What embeddings are on the cluster?', 'Where are the word2vec embeddings?'], 'Try these queries:' || chr(10) || '  - What embeddings are on the cluster?' || chr(10) || '  - Where are the word2vec embeddings?'), (4, true, 'gears', [], 'Did you mean: "gears"?'), (5, false, NULL, [], NULL)) t(query_id, has_suggestions, did_you_mean, alternative_queries, message)""")
def query_suggestions(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(i, q, list(t), n) for i, q, t, n in _WANTED], "query_id int, query string, types array<string>, n int")
    typos = F.filter(F.array(F.struct(F.lit("gearz").alias("word"), F.lit("gears").alias("term"))), lambda t: F.contains(F.col("query"), t["word"]))
    return rows.select("query_id", S.suggestions(F.col("query"), typos, F.col("n"), F.col("types")).alias("s")).select("query_id", "s.*")


@BOOK.add("""SELECT o_custkey AS thread, CASE WHEN count(*) = 1 THEN max(o_orderstatus || o_orderkey) ELSE coalesce(string_agg(o_orderstatus || o_orderkey, chr(10) || chr(10) ORDER BY o_orderkey) FILTER (o_orderkey % 3 <> 0), '') END AS content FROM orders GROUP BY o_custkey""")
def merged_responses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("thread"), k.alias("at"), F.concat("o_orderstatus", k.cast("string")).alias("content"), F.when(k % 3 == 0, "failed").alias("error"))
    return X.merged(rows, "thread", "at")


@BOOK.add("SELECT p_partkey, p_name, 'a' AS step FROM part WHERE p_size < 5 UNION ALL SELECT p_partkey, NULL, 'b' FROM part WHERE p_size > 45")
def combine_results(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    found = {"a": part.where("p_size < 5").select("p_partkey", "p_name"), "b": part.where("p_size > 45").select("p_partkey")}
    return X.combine(found, ("a", "failed", "b"))


@BOOK.add("""SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, '- Today''s date: ' || strftime(o_orderdate, '%B %d, %Y') || chr(10) || '- Current year: ' || year(o_orderdate) || chr(10) || '- Current quarter: Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS context FROM orders""")
def temporal_context(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().select(F.col("day").cast("string").alias("day"), D.temporal_context(F.col("day")).alias("context"))


@BOOK.add("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'fox' ELSE 'hunter' END AS style, [0.5::DOUBLE, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, s_suppkey / 1000.0, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, CASE WHEN s_suppkey % 3 = 0 THEN 0.5 ELSE 0.25 END] AS traits FROM supplier""")
def disposition_round_trip(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    style = F.when(k % 2 == 0, '{"epistemic_appetite": {"curiosity_style": "fox"}, ').otherwise("{")
    risk = F.when(k % 3 == 0, "").otherwise(', "aesthetic": {"risk": 0.25}')
    document = F.concat(style, F.lit('"social": {"disclosure": '), (k / 1000.0).cast("string"), F.lit("}"), risk, F.lit("}"))
    read = P.disposition(P.disposition_json(P.disposition(document)))
    return table(spark, d, "supplier").select("s_suppkey", read.alias("v")).select("s_suppkey", F.col("v.epistemic_appetite.curiosity_style").alias("style"), P.disposition_vector(F.col("v")).alias("traits"))


#: What the whole queries ask, with the words that tell kinds of entities and the patterns of structured queries.
_LOOKUP, _KINDS = "find the hot gears", {"part": ("gear", "bolt"), "supplier": ("supplier",)}
_PATTERNS = [(r"^list \w+$", "role_list", 0.95)]


def _entities(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.lit("part").alias("type"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_partkey").cast("long").alias("ord"))
    supplier = table(spark, d, "supplier").select(F.lit("supplier"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), "s_name", F.lit("sells gears and hot things"), F.col("s_suppkey").cast("long") + 10_000_000)
    return part.union(supplier)


_FOUND = """e AS (SELECT 'part' AS type, 'p' || p_partkey AS id, p_name AS name, p_type AS about, p_partkey AS ord FROM part UNION ALL SELECT 'supplier', 's' || s_suppkey, s_name, 'sells gears and hot things', s_suppkey + 10000000 FROM supplier),
    found AS (SELECT type, id, name, CASE WHEN contains(lower(name), 'hot') OR contains(lower(name), 'gear') THEN 1 ELSE 2 END AS branch, ord FROM e WHERE contains(lower(name), 'hot') OR contains(lower(name), 'gear') OR contains(lower(about), 'hot') OR contains(lower(about), 'gear'))"""


def _asked_registry(spark: SparkSession, d: str, query: str, gate: tuple[str, ...] = ()) -> DataFrame:
    return A.registry_query(spark, query, _entities(spark, d), _PATTERNS, _KINDS, {}, gate, ("find", "the"))


@BOOK.add(f"WITH {_FOUND} SELECT 'find the hot gaer' AS query, 'find the hot gear' AS corrected_query, 'hybrid' AS query_type, type, id, name, branch * (1::BIGINT << 40) + ord AS ord, NULL::VARCHAR AS suggestion FROM found")
def registry_query(spark: SparkSession, d: str) -> DataFrame:
    return A.registry_query(spark, "find the hot gaer", _entities(spark, d), _PATTERNS, _KINDS | {"part": ("gear",)}, {}, (), ("find", "the"), least=0.5)


@BOOK.add("SELECT 'who sells whales' AS query, 'who sells whales' AS corrected_query, 'semantic' AS query_type, NULL::VARCHAR AS type, NULL::VARCHAR AS id, NULL::VARCHAR AS name, NULL::BIGINT AS ord, 'Try these queries:' || chr(10) || '  - List all researchers' || chr(10) || '  - Who works on [topic]?' AS suggestion")
def registry_query_empty(spark: SparkSession, d: str) -> DataFrame:
    return _asked_registry(spark, d, "who sells whales")


_SEARCH = "gear the edtion ndble"


@BOOK.add(f"""WITH {_FOUND.replace("contains(lower(name), 'hot') OR ", "").replace(" OR contains(lower(about), 'hot')", "")}, {sql_bm25(['gear', 'the', 'edtion', 'ndble'])}, top AS (SELECT doc_id, bm25 FROM scored WHERE bm25 > 0 ORDER BY bm25 DESC, doc_id LIMIT 5),
    docs AS (SELECT 'semantic' AS origin, 'document' AS type, CAST(doc_id AS VARCHAR) AS id, round(bm25 / (SELECT max(bm25) FROM top), 6) AS score FROM top),
    rows AS (SELECT * FROM docs UNION ALL SELECT 'structured', type, id, 1.0::DOUBLE FROM found), near AS (SELECT avg(CASE WHEN origin = 'structured' THEN 1.0::DOUBLE ELSE round(score / (SELECT max(score) FROM docs), 6) END) AS near FROM (SELECT * FROM rows ORDER BY origin, score DESC, id LIMIT 3)),
    f AS (SELECT round(0.15::DOUBLE * CASE WHEN count(*) = 1 THEN 0.5::DOUBLE WHEN count(*) <= 3 THEN 0.7::DOUBLE ELSE least(0.9::DOUBLE, 0.7::DOUBLE + count(*) * 0.05::DOUBLE) END + 0.25::DOUBLE * avg(CASE WHEN origin = 'structured' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END) + 0.2::DOUBLE * CASE WHEN bool_or(origin = 'structured') THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END + 0.1::DOUBLE
        + 0.15::DOUBLE * (SELECT near FROM near) + 0.15::DOUBLE * avg(CASE WHEN origin = 'structured' THEN 1.0::DOUBLE ELSE round(score / (SELECT max(score) FROM docs), 6) END), 6) AS confidence FROM rows)
    SELECT origin, type, id, score, 'hybrid' AS decision, confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'uncertain' END AS level FROM rows, f""")
def hybrid_query(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    out = A.hybrid_query(spark, _SEARCH, _asked_registry(spark, d, _SEARCH), docs)
    return out.select("origin", "type", "id", "score", "decision", "confidence", "level")


@BOOK.add("""WITH r AS (SELECT p_type AS type, p_name AS name, p_partkey AS ord, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey, p_name) AS k, count(*) OVER (PARTITION BY p_type) AS n FROM part)
    SELECT type, n, 'Found ' || any_value(n) || ' ' || type || ':' || chr(10) || string_agg('- ' || name, chr(10) ORDER BY k) FILTER (k <= 10) || CASE WHEN n > 10 THEN chr(10) || '... and ' || (n - 10) || ' more' ELSE '' END AS answer FROM r GROUP BY type, n""")
def formatted_answers(spark: SparkSession, d: str) -> DataFrame:
    return A.formatted(table(spark, d, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord")))


@BOOK.add("SELECT c_custkey AS query_id, CASE WHEN c_custkey % 4 < 3 THEN 'user' || c_custkey END AS person FROM customer")
def asked_persons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    frames = (("What data does User", " use?"), ("user", "'s resources"), ("show user", "'s resources"), ("hello ", ""))
    query = F.coalesce(*[F.when(k % 4 == i, F.concat(F.lit(a), k.cast("string"), F.lit(b))) for i, (a, b) in enumerate(frames)])
    return table(spark, d, "customer").select(k.alias("query_id"), A.asked_person(query).alias("person"))


@BOOK.add("""WITH l AS (SELECT s_suppkey, CASE WHEN s_suppkey % 40 = 3 THEN 1.0::DOUBLE ELSE 0::DOUBLE END + CASE WHEN s_suppkey % 7 = 3 THEN 0.9::DOUBLE ELSE 0::DOUBLE END AS score, CASE WHEN s_suppkey % 7 = 3 AND s_suppkey % 40 = 3 THEN 'listed_owner, owns_directory' WHEN s_suppkey % 7 = 3 THEN 'listed_owner' ELSE 'owns_directory' END AS why, s_name FROM supplier WHERE s_suppkey % 40 = 3 OR s_suppkey % 7 = 3)
    SELECT 'person' AS type, '3' AS id, c_name AS name, NULL::DOUBLE AS score, 'Query subject' AS match_reason FROM customer WHERE c_custkey = 3 UNION ALL SELECT 'resource_supplier', CAST(s_suppkey AS VARCHAR), s_name, round(score, 6), 'Used by Customer#000000003: ' || why FROM l""")
def person_resources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = lambda x: F.concat(F.lit("user"), x.cast("string"))
    supplier, customer = table(spark, d, "supplier"), table(spark, d, "customer")
    resources = supplier.select(k.alias("resource_id"), F.col("s_name").alias("name"), F.lit("supplier").alias("category"), name(k % 40).alias("path_user"), name(k % 7).alias("owner"), F.lit(None).cast("string").alias("created_by"), F.lit("").alias("description"))
    people = customer.select(F.col("c_custkey").alias("person_id"), name(F.col("c_custkey")).alias("username"), F.col("c_name"), F.array().cast("array<string>").alias("topics"), F.col("c_custkey").alias("ord"))
    links = R.cross_links(people.drop("c_name"), resources)
    return A.person_resources(links, people.withColumnRenamed("c_name", "name"), resources, "user3")


def _named(spark: SparkSession, d: str):
    """A lookup of parts whose names have all words of a query."""
    part = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"))

    def found(query: str, parent: DataFrame | None) -> DataFrame:
        rows = part
        for word in query.lower().split():
            rows = rows.where(F.array_contains(F.split("name", " "), word))
        return rows

    return found


def _rows(n: str) -> str:
    return f"(SELECT least(count(*), 20) FROM part WHERE {n})"


def _quality_sql(n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN round(least(1.0::DOUBLE, 0.7::DOUBLE + 0.05::DOUBLE * {n}), 6) ELSE 0.2::DOUBLE END"


_TRIED = "hot gear and whales"


@BOOK.add(f"""WITH n AS (SELECT {_rows("false")} AS a, {_rows("list_has_all(string_split(lower(p_name), ' '), ['hot', 'gear'])")} AS b)
    SELECT 1 AS position, 's1' AS step, {_quality_sql('a')} AS quality, false AS success, 1 AS fallbacks FROM n UNION ALL SELECT 2, 'fallback:decomposition', {_quality_sql('b')}, true, 1 FROM n""")
def plan_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """A lookup finds nothing; the first strategy finds nothing either, the second does."""
    run = B.with_strategies([X.Step("s1", "registry", _TRIED)], {"registry": _named(spark, d)}, ("expansion", "decomposition", "narrowing"))
    told = [(i + 1, o.step, round(o.quality, 6), o.success, run.fallbacks) for i, o in enumerate(run.outcomes)]
    return spark.createDataFrame(told, "position int, step string, quality double, success boolean, fallbacks int")


@BOOK.add("""SELECT p_partkey, lower(p_name) AS name, 'a' AS step FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'gear') UNION ALL SELECT p_partkey, lower(p_name), 'b' FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'hot')""")
def plan_together(spark: SparkSession, d: str) -> DataFrame:
    """Two lookups side by side and the union of what they found."""
    steps = [X.Step("a", "registry", "gear"), X.Step("b", "registry", "hot"), X.Step("c", "combine", "", "a", ("a", "b"))]
    run = B.execute_together(spark, steps, {"registry": _named(spark, d)})
    return run.outcomes[-1].rows
