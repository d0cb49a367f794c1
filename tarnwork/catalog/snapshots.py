"""Snapshot queries: a user's events up to a day are a resource of that day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import snapshots as S
from ..session import table
from ._book import Book

BOOK = Book()


def _side(where: str) -> str:
    return f"SELECT 'u' || user_id AS name, max(ts) AS mtime, count(*) AS size_bytes, arg_max(event_type, event_id) AS owner FROM events WHERE {where} GROUP BY user_id"


_OLD, _NEW = "ts < TIMESTAMP '2024-01-15' AND user_id % 7 <> 0", "ts >= TIMESTAMP '2024-01-15' AND user_id % 5 <> 0"
_DIFF = f"""a AS ({_side(_OLD)}), b AS ({_side(_NEW)}), j AS (SELECT coalesce(a.name, b.name) AS name, a.name AS an, b.name AS bn, a.mtime AS am, b.mtime AS bm, a.size_bytes AS asz, b.size_bytes AS bsz, a.owner AS ao, b.owner AS bo FROM a FULL JOIN b ON a.name = b.name),
    changes AS (SELECT name, 'added' AS change, NULL::BIGINT AS delta FROM j WHERE an IS NULL UNION ALL SELECT name, 'removed', NULL FROM j WHERE bn IS NULL UNION ALL SELECT name, 'modified', NULL FROM j WHERE an IS NOT NULL AND bn IS NOT NULL AND am <> bm
    UNION ALL SELECT name, 'grown', bsz - asz FROM j WHERE bsz > asz UNION ALL SELECT name, 'shrunk', asz - bsz FROM j WHERE bsz < asz UNION ALL SELECT name, 'owner_changed', NULL FROM j WHERE ao <> bo)"""


def _snapshot(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("ts").alias("mtime"), F.count("*").alias("size_bytes"), F.max_by("event_type", "event_id").alias("owner")).withColumn("name", F.concat(F.lit("u"), F.col("user_id").cast("string")))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return S.diff(_snapshot(events.where("ts < timestamp'2024-01-15' and user_id % 7 <> 0")), _snapshot(events.where("ts >= timestamp'2024-01-15' and user_id % 5 <> 0")))


@BOOK.add(f"WITH {_DIFF} SELECT name, change, delta FROM changes")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("name", "change", "delta")


@BOOK.add(f"WITH {_DIFF}, c AS (SELECT count(*) FILTER (change = 'added') AS added_count, count(*) FILTER (change = 'removed') AS removed_count, count(*) FILTER (change = 'modified') AS modified_count, count(*) FILTER (change = 'grown') AS grown_count, count(*) FILTER (change = 'shrunk') AS shrunk_count FROM changes) SELECT *, added_count + removed_count + modified_count + grown_count + shrunk_count > 0 AS has_changes FROM c")
def snapshot_diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.diff_summary(_changes(spark, d))


_PANEL = "panel AS (SELECT strftime(ts, '%Y-%m-%d') AS snapshot_date, event_type AS name, event_id, user_id, value FROM events)"


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("snapshot_date"), F.col("event_type").alias("name"), "event_id", "user_id", "value")


@BOOK.add(f"WITH {_PANEL} SELECT max(snapshot_date) AS snapshot_date FROM panel WHERE snapshot_date < '2024-01-20'")
def latest_before(spark: SparkSession, d: str) -> DataFrame:
    return S.latest_before(_panel(spark, d), "2024-01-20")


@BOOK.add(f"WITH {_PANEL} SELECT DISTINCT snapshot_date FROM panel")
def snapshot_dates(spark: SparkSession, d: str) -> DataFrame:
    return S.dates(_panel(spark, d))


@BOOK.add(f"WITH {_PANEL} SELECT snapshot_date, count(*) AS n FROM panel WHERE snapshot_date BETWEEN '2024-01-05' AND '2024-01-12' GROUP BY 1")
def snapshot_range(spark: SparkSession, d: str) -> DataFrame:
    return S.load_range(_panel(spark, d), "2024-01-05", "2024-01-12").groupBy("snapshot_date").agg(F.count("*").alias("n"))


@BOOK.add(f"WITH {_PANEL} SELECT snapshot_date, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY event_id) AS r FROM panel WHERE name = 'purchase') WHERE r = 1")
def resource_timeline(spark: SparkSession, d: str) -> DataFrame:
    return S.timeline(_panel(spark, d), "purchase", "event_id").select("snapshot_date", "event_id", "user_id")


_LOG = "log AS (SELECT strftime(ts, '%Y-%m-%d') AS date, 'u' || user_id AS name, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' WHEN 'view' THEN 'modified' ELSE 'grown' END AS change, CAST(floor(value) AS BIGINT) AS delta FROM events)"


@BOOK.add(f"""WITH {_LOG}, r AS (SELECT * FROM log WHERE date >= '2024-01-10')
    SELECT 'total_' || change AS measure, '' AS name, count(*) AS value FROM r WHERE change IN ('added', 'removed') GROUP BY change UNION ALL SELECT 'total_modified', '', count(DISTINCT name) FROM r WHERE change = 'modified'
    UNION ALL (SELECT 'growth', name, CAST(sum(delta) AS BIGINT) FROM r WHERE change = 'grown' GROUP BY name ORDER BY 3 DESC, name LIMIT 10) UNION ALL (SELECT 'active', name, count(*) FROM r WHERE change = 'modified' GROUP BY name ORDER BY 3 DESC, name LIMIT 10)""")
def activity_summary(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").when(F.col("event_type") == "view", "modified").otherwise("grown")
    log = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), kind.alias("change"), F.floor("value").cast("long").alias("delta"))
    return S.activity(log, "2024-01-10")


@BOOK.add("""WITH a AS (SELECT doc_id, left(sha256(text), 16) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, left(sha256(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END), 16) AS h FROM documents WHERE doc_id % 7 <> 0)
    SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'updated' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def incremental_sync(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    a = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), T.content_hash(F.col("text")).alias("hash"))
    b = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), T.content_hash(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return S.sync_plan(a, b)


@BOOK.add("SELECT p_name AS name, CASE WHEN regexp_matches(lower(p_name), 'model|embedding|bert|word2vec') THEN 'model' WHEN regexp_matches(lower(p_name), 'data|corpus|archive') THEN 'dataset' WHEN regexp_matches(lower(p_name), 'project|code|src') THEN 'project' WHEN regexp_matches(p_name, '^[A-Z]') THEN 'project' ELSE 'directory' END AS kind, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'Gear ' || p_name WHEN 1 THEN p_name || '_data' WHEN 2 THEN 'bert-' || p_name ELSE p_name END AS p_name FROM part) GROUP BY 1, 2")
def resource_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Gear "), "p_name")).when(k == 1, F.concat("p_name", F.lit("_data"))).when(k == 2, F.concat(F.lit("bert-"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(name.alias("name")).groupBy("name", S.classify_resource(F.col("name")).alias("kind")).agg(F.count("*").alias("n"))


@BOOK.add("SELECT s_nationkey AS owner, count(*) AS n FROM supplier GROUP BY 1 ORDER BY n DESC, owner LIMIT 10")
def scan_top_owners(spark: SparkSession, d: str) -> DataFrame:
    return S.scan_summary(table(spark, d, "supplier").select(F.col("s_nationkey").alias("owner"), F.lit("x").alias("resource_type")))[1]


@BOOK.add("SELECT p_brand AS category, '## ' || p_brand || ' (' || count(*) || ')' || chr(10) || string_agg(l, chr(10) ORDER BY l) AS markdown FROM (SELECT p_brand, '- **' || p_name || '** (' || p_size || ' bytes)' AS l FROM part) GROUP BY p_brand")
def snapshot_markdown(spark: SparkSession, d: str) -> DataFrame:
    return S.to_markdown(table(spark, d, "part").select(F.col("p_brand").alias("category"), F.col("p_name").alias("name"), F.col("p_size").alias("size_bytes")))


@BOOK.add("SELECT p_partkey, p_brand, s_name FROM part LEFT JOIN supplier ON 'Brand#' || s_suppkey = p_brand")
def catalog_enrich(spark: SparkSession, d: str) -> DataFrame:
    catalog = table(spark, d, "supplier").select(F.concat(F.lit("Brand#"), F.col("s_suppkey").cast("string")).alias("name"), "s_name")
    return S.enrich(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name")), catalog).select("p_partkey", F.col("name").alias("p_brand"), "s_name")
