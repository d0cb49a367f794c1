"""Index, graph building, classification and voice queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entity_text as X
from ..operators import build_graph as G
from ..operators import index as I
from ..operators import voices as S
from ..plans import classify as C
from ..session import table
from ._book import Book

BOOK = Book()


def _entries(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("dataset").alias("doc_type"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.array("p_brand").alias("mentioned"))
    people = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("person").alias("doc_type"), F.col("s_name").alias("text"), F.array().cast("array<string>").alias("mentioned"))
    return part.unionByName(people)


@BOOK.add("SELECT doc_type, count(*) AS n FROM (SELECT 'dataset' AS doc_type FROM part UNION ALL SELECT 'person' FROM supplier) GROUP BY 1")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.stats(I.build(_entries(spark, d)))


@BOOK.add("SELECT 'p' || p_partkey AS id, 1.0::DOUBLE AS score FROM part WHERE p_name = 'hot gear' AND p_type = 'PROMO' ORDER BY id LIMIT 5")
def index_search(spark: SparkSession, d: str) -> DataFrame:
    found = I.search(I.build(_entries(spark, d)), "hot gear PROMO", 200, ["dataset"])
    return found.where("text = 'hot gear PROMO'").orderBy("id").limit(5).select("id", "score")


@BOOK.add()
def index_similar(spark: SparkSession, d: str) -> DataFrame:
    return I.similar(I.build(_entries(spark, d)), "p1", 10, same_type=True).select("id", "score")


@BOOK.add("SELECT count(*) AS n FROM (SELECT p_partkey FROM part UNION ALL SELECT s_suppkey FROM supplier)")
def index_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    return I.insert(I.build(entries.where("doc_type = 'person'")), entries).agg(F.count("*").alias("n"))


@BOOK.add("""SELECT c_custkey, c_name || ' is a ' || c_mktsegment || CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE ' at NATION_' || c_nationkey END || '.' || ' Research areas: ' || lower(c_mktsegment) || ', trade.' || CASE WHEN c_custkey % 3 > 0 THEN ' h-index: ' || c_custkey % 3 || ', cited by: 0.' ELSE '' END AS text FROM customer""")
def person_texts(spark: SparkSession, d: str) -> DataFrame:
    none, at = F.lit(None), F.when(F.col("c_nationkey") % 5 == 0, "").otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
    text = X.person(F.col("c_name"), F.col("c_mktsegment"), at, none.cast("string"), F.array(F.lower("c_mktsegment"), F.lit("trade")), none.cast("array<string>"), F.col("c_custkey") % 3, none.cast("int"))
    return table(spark, d, "customer").select("c_custkey", text.alias("text"))


@BOOK.add("""WITH r AS (SELECT DISTINCT l_orderkey AS project_id, CASE WHEN l_suppkey % 2 = 0 THEN 's' || l_suppkey ELSE 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') END AS ref FROM lineitem),
    m AS (SELECT DISTINCT project_id, 's' || s_suppkey AS person_id FROM r JOIN supplier ON ref = 's' || s_suppkey OR lower(ref) = lower(s_name)) SELECT project_id, list_sort(list(person_id)) AS team FROM m GROUP BY project_id""")
def graph_project_members(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_suppkey").cast("string")
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("s"), k)).otherwise(F.concat(F.lit("Supplier#"), F.lpad(k, 9, "0"))).alias("ref")).distinct()
    people = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("person_id"), F.col("s_name").alias("name"))
    return G.resolve_members(refs, people).groupBy("project_id").agg(F.array_sort(F.collect_list("person_id")).alias("team"))


@BOOK.add("""WITH b AS (SELECT DISTINCT o_custkey % 3 AS profile_id, l_orderkey AS doc_id, 's' || l_suppkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT x.p AS a, y.p AS b, least(count(*) / 10.0, 1.0)::DOUBLE AS confidence FROM b x JOIN b y ON x.profile_id = y.profile_id AND x.doc_id = y.doc_id AND x.p < y.p GROUP BY 1, 2 HAVING count(*) >= 3""")
def graph_coauthor_edges(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    listed = listed.select((F.col("o_custkey") % 3).alias("profile_id"), F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("person_id"))
    return G.coauthor_edges(listed, size=table(spark, d, "lineitem").count()).select(F.col("agents")[0].alias("a"), F.col("agents")[1].alias("b"), "confidence")


_INSTITUTIONS = {"mit": "MIT", "penn": "University of Pennsylvania", "duke": "Duke University"}
_ASKED = ((1, "phd students at mit"), (2, "committee members studying networks"), (3, "who works on graphs"), (4, "faculty working on deep learning at duke"), (5, "list datasets"), (6, "gears"))


@BOOK.add("SELECT * FROM (VALUES (1, 'MIT', 'student', NULL, true, 'structured'), (2, 'MIT', NULL, 'networks', true, 'structured'), (3, NULL, NULL, 'graphs', false, 'semantic'), (4, 'Duke University', 'faculty', 'deep learning', true, 'structured'), (5, NULL, NULL, NULL, false, 'structured'), (6, NULL, NULL, NULL, false, 'hybrid')) t(query_id, institution, role, topic, is_compound, query_type)")
def classify_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = C.classify(spark.createDataFrame(_ASKED, "query_id int, query string"), [(r"^list\s+datasets", "list_datasets", 0.9)], {"parts": ("gear", "bolt")}, _INSTITUTIONS)
    return rows.select("query_id", "institution", "role", "topic", "is_compound", "query_type")


@BOOK.add("SELECT p_brand AS voice, count(*) AS hits FROM part WHERE contains(p_type, 'small') OR contains(lower(p_name), 'gear') GROUP BY 1 ORDER BY hits DESC, voice LIMIT 3")
def voices_by_topic(spark: SparkSession, d: str) -> DataFrame:
    return S.by_topic(table(spark, d, "part").select(F.lower("p_name").alias("topic"), F.col("p_brand").alias("voice")), ["gear"], 3)


@BOOK.add("WITH t AS (SELECT s_suppkey, unnest([CAST(s_nationkey AS VARCHAR), CAST(s_suppkey % 5 AS VARCHAR), CAST(s_suppkey % 3 AS VARCHAR) || 'x']) AS topic FROM supplier), o AS (SELECT DISTINCT topic FROM t WHERE s_suppkey = 7) SELECT s_name AS name, count(DISTINCT topic) AS shared FROM t JOIN supplier USING (s_suppkey) WHERE topic IN (SELECT topic FROM o) AND s_suppkey <> 7 GROUP BY 1 HAVING count(DISTINCT topic) >= 2")
def coauthors_by_topics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    people = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.array(F.col("s_nationkey").cast("string"), (k % 5).cast("string"), F.concat((k % 3).cast("string"), F.lit("x"))).alias("topics"))
    return S.common_topics(people, "Supplier#000000007")
