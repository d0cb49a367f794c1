"""Queries over people, chats, transcripts and resources: customers are people, orders papers, events messages, parts resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import entity_text as E
from ..functions import text as T
from ..operators import collect as C
from ..operators import graph as G
from ..operators import index as X
from ..operators import inventory as I
from ..operators import registry as R
from ..operators import state as S
from ..session import table
from ..sources import files
from ..streaming import jobs as J
from ._book import Book

BOOK = Book()


def _users(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    account = F.concat(F.lit("acct"), k.cast("string"))
    return table(spark, d, "customer").select(
        F.concat(F.lit("U"), k.cast("string")).alias("id"), F.when(k % 3 == 0, F.col("c_name")).otherwise("").alias("real_name"), F.when(k % 3 == 1, F.col("c_name")).alias("profile_name"),
        F.lower("c_mktsegment").alias("display_name"), F.when(k % 5 > 0, account).alias("name"), F.when(k % 4 == 0, k % 8 == 0).alias("is_bot"), k.alias("ord"),
    )


_USERS = """u AS (SELECT 'U' || c_custkey AS id, CASE WHEN c_custkey % 3 < 2 THEN c_name WHEN c_custkey % 5 > 0 THEN 'acct' || c_custkey ELSE 'U' || c_custkey END AS name, coalesce(c_custkey % 8 = 0, false) AS is_bot, c_custkey AS ord, lower(c_mktsegment) AS shown, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS real, CASE WHEN c_custkey % 5 > 0 THEN 'acct' || c_custkey END AS account FROM customer)"""


@BOOK.add(f"WITH {_USERS} SELECT id, name, is_bot FROM u")
def chat_users(spark: SparkSession, d: str) -> DataFrame:
    return C.user_names(_users(spark, d))


@BOOK.add(f"WITH {_USERS} SELECT id FROM u WHERE contains(lower(real), 'acct17') OR contains(shown, 'acct17') OR account = 'acct17' ORDER BY ord LIMIT 1")
def chat_user_by_name(spark: SparkSession, d: str) -> DataFrame:
    return C.user_by_name(_users(spark, d), "Acct17")


@BOOK.add(f"WITH {_USERS} SELECT event_id, coalesce(u.name, 'U' || user_id) AS user_name FROM events LEFT JOIN u ON id = 'U' || user_id")
def chat_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user"))
    return C.name_of(_users(spark, d), rows).select("event_id", "user_name")


@BOOK.add("SELECT DISTINCT event_type AS channel FROM events")
def chat_channels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("channel"))
    return C.channels(rows.union(spark.createDataFrame([(".hidden",)], "channel string")))


def _people(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    topics = F.array(F.lower("c_mktsegment"), F.concat(F.lit("area "), (k % 7).cast("string")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("Director").alias("role"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("institution"), topics.alias("topics"), F.when(k % 6 > 0, k % 10).alias("works_count"), k.alias("ord"))


@BOOK.add("SELECT c_name AS name, [lower(c_mktsegment), 'area ' || c_custkey % 7] AS topics FROM customer WHERE contains(lower(c_name), '00001') ORDER BY c_custkey LIMIT 1")
def person_topics(spark: SparkSession, d: str) -> DataFrame:
    return C.person_topics(_people(spark, d), "00001")


@BOOK.add("SELECT c_name AS name, CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 10 ELSE 0 END AS works_count FROM customer WHERE contains('area ' || c_custkey % 7, 'area 3') OR contains(lower(c_mktsegment), 'area 3')")
def authors_by_topic(spark: SparkSession, d: str) -> DataFrame:
    return C.authors_by_topic(_people(spark, d), "Area 3").select("name", "works_count")


_PAPERS = """p AS (SELECT 'Customer ' || o_custkey AS owner, 'On ' || o_orderpriority || ' ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 > 0 THEN 'abstract of ' || o_orderkey END AS abstract, CASE WHEN o_orderkey % 4 > 0 THEN '10/' || o_orderkey END AS doi, year(o_orderdate) AS year, ['t' || o_orderkey % 9] AS topics, o_orderkey AS ord FROM orders),
    c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'pubs/' ELSE 'talks/' END || source AS source, CASE WHEN doc_id % 50 = 0 THEN 'by customer 7 ' ELSE '' END || text AS text, doc_id AS ord FROM documents)"""


def _papers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return table(spark, d, "orders").select(text("Customer ", F.col("o_custkey")).alias("owner"), text("On ", F.col("o_orderpriority"), " ", k).alias("title"), F.when(k % 3 > 0, text("abstract of ", k)).alias("abstract"), F.when(k % 4 > 0, text("10/", k)).alias("doi"), F.year("o_orderdate").alias("year"), F.array(text("t", k % 9)).alias("topics"), k.alias("ord"))


def _said(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").select(F.concat(F.when(k % 2 == 0, "pubs/").otherwise("talks/"), "source").alias("source"), F.concat(F.when(k % 50 == 0, "by customer 7 ").otherwise(""), "text").alias("text"), k.alias("ord"))


@BOOK.add(f"WITH {_PAPERS} SELECT source, text, ord FROM c WHERE contains(lower(source), 'pub') AND contains(lower(text), 'customer 7')")
def author_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.author_chunks(_said(spark, d), "Customer 7")


@BOOK.add(f"WITH {_PAPERS}, f AS (SELECT * FROM p WHERE (contains(lower(title), 't4') OR contains(topics[1], 't4')) AND abstract IS NOT NULL ORDER BY ord LIMIT 30) SELECT abstract AS text, 'abstract:' || coalesce(doi, 'unknown') AS source_id, CAST(year AS VARCHAR) AS timestamp, 'Topic: T4, Author: ' || owner AS context FROM f")
def papers_by_topic(spark: SparkSession, d: str) -> DataFrame:
    return C.papers_by_topic(_papers(spark, d), "T4").select("text", "source_id", "timestamp", "context")


@BOOK.add(f"""WITH {_PAPERS}, s AS (SELECT 0 AS prio, ord, 0 AS part, title AS text, 'paper:' || coalesce(doi, left(title, 30)) AS source_id FROM p WHERE contains(lower(owner), 'customer 7') UNION ALL SELECT 0, ord, 1, abstract, 'abstract:' || coalesce(doi, left(title, 30)) FROM p WHERE contains(lower(owner), 'customer 7') AND abstract IS NOT NULL
    UNION ALL SELECT 1, ord, 0, text, 'chunk:' || coalesce(source, 'unknown') FROM c WHERE contains(lower(source), 'pub') AND contains(lower(text), 'customer 7')), n AS (SELECT *, row_number() OVER (ORDER BY prio, ord, part) AS n FROM s)
    SELECT text, source_id, n FROM (SELECT *, lag(ord) OVER (ORDER BY n) AS before FROM n) WHERE n <= 12 OR (n = 13 AND prio = 0 AND before = ord)""")
def author_samples(spark: SparkSession, d: str) -> DataFrame:
    return C.author_samples(_papers(spark, d), _said(spark, d), "Customer 7", 12).select("text", "source_id", "n")


_FILES_SQL = "m AS (SELECT DISTINCT source AS name, CASE WHEN length(source) % 2 = 0 THEN 'meetings/' ELSE 'texts/' END || source AS path, 3 AS num_elements FROM documents WHERE source IS NOT NULL)"


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    folder = F.when(F.length("source") % 2 == 0, "meetings/").otherwise("texts/")
    return table(spark, d, "documents").where("source is not null").select(F.col("source").alias("name"), F.concat(folder, "source").alias("path"), F.lit(3).alias("num_elements")).distinct()


@BOOK.add(f"WITH {_FILES_SQL} SELECT name, path, num_elements FROM m WHERE starts_with(path, 'meetings/')")
def transcript_sources(spark: SparkSession, d: str) -> DataFrame:
    return C.transcript_sources(_manifest(spark, d))


@BOOK.add("SELECT doc_id AS ord, source FROM documents WHERE contains(lower(source), 'src1')")
def chunks_by_source(spark: SparkSession, d: str) -> DataFrame:
    return C.chunks_by_source(table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "source"), "SRC1").select("ord", "source")


@BOOK.add(f"""WITH {_FILES_SQL}, c AS (SELECT 'x/' || source AS source, CASE WHEN doc_id % 3 = 0 THEN 'Ann: ' ELSE '' END || text AS text, CASE WHEN doc_id % 3 = 1 THEN 'Ann Lee' ELSE 'Bo' END AS speaker, doc_id AS ord FROM documents WHERE text IS NOT NULL),
    s AS (SELECT m.name AS file, ord, CASE WHEN contains(lower(speaker), 'ann') THEN c.text ELSE trim(substr(c.text, 5)) END AS text FROM m JOIN c ON contains(lower(c.source), lower(m.name)) WHERE starts_with(path, 'meetings/') AND (contains(lower(speaker), 'ann') OR starts_with(lower(c.text), 'ann:')))
    SELECT file, ord, text, n FROM (SELECT *, row_number() OVER (ORDER BY file, ord) AS n FROM s WHERE length(text) >= 30) WHERE n <= 100""")
def speaker_samples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    said = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("x/"), "source").alias("source"), F.concat(F.when(k % 3 == 0, "Ann: ").otherwise(""), "text").alias("text"), F.when(k % 3 == 1, "Ann Lee").otherwise("Bo").alias("speaker"), k.alias("ord"))
    return C.speaker_samples(_manifest(spark, d), said, "Ann").select("file", "ord", "text", "n")


def _stock(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), F.when(k % 5 > 0, F.col("p_type")).alias("resource_type"), F.col("p_brand").alias("owner_username"), F.when(k % 4 > 0, k % 4 == 1).alias("is_valuable"), (k % 3 == 0).alias("is_active"), F.concat(F.lit("2024-01-"), F.lpad((k % 9 + 1).cast("string"), 2, "0")).alias("snapshot_date"))


@BOOK.add("SELECT p_partkey AS id FROM part WHERE p_partkey % 5 > 0 AND p_type = 'PROMO'")
def resources_by_type(spark: SparkSession, d: str) -> DataFrame:
    return I.of_type(_stock(spark, d), "PROMO").select("id")


@BOOK.add("SELECT p_partkey AS id FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def resources_by_owner(spark: SparkSession, d: str) -> DataFrame:
    stock = _stock(spark, d)
    return I.owned_by(stock, stock.agg(F.min("owner_username")).first()[0]).select("id")


@BOOK.add("SELECT p_partkey AS id, p_partkey % 3 = 0 AS active FROM part WHERE p_partkey % 4 = 1")
def resources_valuable(spark: SparkSession, d: str) -> DataFrame:
    return I.valuable(_stock(spark, d)).select("id", F.col("is_active").alias("active"))


@BOOK.add("SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0")
def resources_active(spark: SparkSession, d: str) -> DataFrame:
    return I.active(_stock(spark, d)).select("id")


@BOOK.add("SELECT p_partkey AS id, p_brand AS owner_username FROM part WHERE p_partkey = 5")
def resource_entry(spark: SparkSession, d: str) -> DataFrame:
    return I.entry(_stock(spark, d), 5).select("id", "owner_username")


_SUMMED = "count(*) AS total_resources, count(*) FILTER (p_partkey % 4 = 1) AS valuable, count(*) FILTER (p_partkey % 3 = 0) AS active, count(*) FILTER (p_partkey % 5 = 0) AS untyped"


@BOOK.add(f"SELECT {_SUMMED} FROM part")
def resource_summary(spark: SparkSession, d: str) -> DataFrame:
    return I.summary(_stock(spark, d)).select("total_resources", "valuable", "active", F.col("by_type")["unknown"].alias("untyped"))


@BOOK.add(f"SELECT '2024-01-09' AS snapshot_date, {_SUMMED} FROM part WHERE p_partkey % 9 = 8")
def current_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.current_stats(_stock(spark, d)).select("snapshot_date", "total_resources", "valuable", "active", F.col("by_type")["unknown"].alias("untyped"))


@BOOK.add("SELECT 'u' || user_id AS parent, count(*) FILTER (event_type = 'view') AS subdirectory_count, count(*) FILTER (event_type <> 'view') AS file_count FROM events GROUP BY user_id")
def directory_contents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("parent"), (F.col("event_type") == "view").alias("is_directory"))
    return I.contents(rows)


@BOOK.add("SELECT event_id, CASE WHEN c_custkey IS NULL THEN -1 ELSE user_id END AS owner_uid, coalesce(c_name, 'unknown') AS owner_username FROM events LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 2 = 0")
def scan_owners(spark: SparkSession, d: str) -> DataFrame:
    accounts = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("username"))
    return I.owners(table(spark, d, "events").select("event_id", F.col("user_id").alias("owner_uid")), accounts).select("event_id", "owner_uid", "owner_username")


@BOOK.add("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE lower(s_name) END AS username FROM supplier")
def path_usernames(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "/home/").otherwise("/project/lab/"), "s_name", F.lit("/data"))
    return table(spark, d, "supplier").select("s_suppkey", I.username_of(path, "/project/lab/").alias("username"))


@BOOK.add("SELECT strftime(ts, '%Y-%m-%d') AS path FROM events GROUP BY 1 HAVING day(min(ts)) % 3 > 0")
def unindexed_snapshots(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("path")).distinct()
    return I.unindexed(days, days.where(F.day(F.to_date("path")) % 3 == 0))


@BOOK.add("SELECT user_id AS key FROM events GROUP BY 1 HAVING user_id % 4 > 0")
def cache_delete(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "events").select(F.col("user_id").alias("key")).distinct()
    return S.delete(keys, keys.where("key % 4 = 0"))


@BOOK.add("SELECT user_id, count(*) AS api_calls_saved, round(count(*) * 0.001::DOUBLE, 6) AS estimated_cost_saved_usd, round(count(*) * 0.35::DOUBLE * 1000, 6) AS estimated_time_saved_ms FROM events GROUP BY user_id")
def cache_savings(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("hits"))
    return hits.select("user_id", S.estimated_savings(F.col("hits")).alias("s")).select("user_id", "s.*")


@BOOK.add("SELECT user_id, (epoch(TIMESTAMP '2024-02-01') - epoch(max(ts)))::BIGINT < 259200 AND user_id % 2 = 0 AS is_active FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY user_id")
def thread_active(spark: SparkSession, d: str) -> DataFrame:
    threads = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_activity")).withColumn("bot_active", F.col("user_id") % 2 == 0)
    return S.active_threads(threads, F.lit("2024-02-01").cast("timestamp"), 3 * 86400).select("user_id", "is_active")


@BOOK.add("""WITH m AS (SELECT user_id, event_type || '-item-' || event_id % 6 AS entity, count(*) AS mentions, max(date_trunc('second', ts)) AS t FROM events GROUP BY 1, 2), r AS (SELECT user_id, entity, mentions, round(mentions * 0.4::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - (epoch(TIMESTAMP '2024-02-01') - epoch(t)) / 3600.0::DOUBLE / 24) * 0.6::DOUBLE, 6) AS relevance FROM m)
    SELECT user_id, entity, mentions, relevance FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC, entity) AS k FROM r) WHERE k <= 15""")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.concat("event_type", F.lit("-item-"), (F.col("event_id") % 6).cast("string")).alias("entity"), "ts")
    return S.mentions(rows, "user_id", "entity", "ts", F.lit("2024-02-01").cast("timestamp")).select("user_id", "entity", "mentions", "relevance")


@BOOK.add("SELECT p_partkey, levenshtein(lower(p_name), 'hot gear') = 0 AS equal, lower(p_name) AS name FROM part")
def normal_names(spark: SparkSession, d: str) -> DataFrame:
    name = T.normalize_name(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("-"))))
    return table(spark, d, "part").select("p_partkey", (T.sequence_ratio(name, F.lit("hot gear")) == 1).alias("equal"), name.alias("name"))


@BOOK.add("SELECT o_orderkey, o_orderkey % 3600 / 1.0::DOUBLE AS seconds, lpad(CAST(o_orderkey % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS told FROM orders")
def caption_times(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3600
    stamp = F.concat(F.lit("00:"), F.lpad(F.floor(k / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(".000"))
    return table(spark, d, "orders").select("o_orderkey", D.vtt_seconds(stamp).cast("double").alias("seconds"), D.clock(k).alias("told"))


@BOOK.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 2000 + o_orderkey % 10 + 10 ELSE NULL END AS year, CASE o_orderkey % 3 WHEN 0 THEN 'transcript' WHEN 1 THEN 'proposal' ELSE 'document' END AS kind FROM orders""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    year = F.when(k % 2 == 0, F.concat(F.lit("_20"), (k % 10 + 10).cast("string"))).otherwise("")
    name = F.concat(F.when(k % 3 == 0, "zoom_call").when(k % 3 == 1, "final submission").otherwise("notes"), year, F.lit(".txt"))
    return table(spark, d, "orders").select("o_orderkey", T.year_of_filename(name).alias("year"), T.detect_doc_type(name).alias("kind"))


@BOOK.add("SELECT user_id, event_id, 'Speaker ' || event_type AS speaker, 'said ' || event_id AS text, event_id % 50 + 0.5::DOUBLE AS start_s FROM events")
def caption_segments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    start = F.concat(F.lit("00:"), F.lpad((k % 50).cast("string"), 2, "0"))
    body = F.concat(F.lit("WEBVTT\n\n1\n"), start, F.lit(".500 --> "), start, F.lit(".900\n<v Speaker "), "event_type", F.lit(">said "), k.cast("string"), F.lit("</v>\n"))
    found = files.captions(table(spark, d, "events").select("event_id", body.alias("text")), "event_id")
    return found.join(table(spark, d, "events").select("event_id", "user_id"), "event_id").select("user_id", "event_id", "speaker", "text", "start_s")


@BOOK.add("SELECT s_suppkey, 0 AS pos, s_name AS speaker, 'first' AS said FROM supplier UNION ALL SELECT s_suppkey, 1, 'Bo', 'second' FROM supplier WHERE s_suppkey % 2 = 0")
def transcript_utterances(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat("s_name", F.lit(": first\nmore of it\n"), F.when(F.col("s_suppkey") % 2 == 0, "Bo: second").otherwise(""))
    return files.utterances(table(spark, d, "supplier").select("s_suppkey", body.alias("text")), "s_suppkey")


@BOOK.add("SELECT s_suppkey, s_suppkey % 3 = 0 AS embedded FROM supplier")
def embedded_captions(spark: SparkSession, d: str) -> DataFrame:
    body = F.repeat(F.lit("00:01.000 --> 00:02.000 x\n"), F.when(F.col("s_suppkey") % 3 == 0, 5).otherwise(4))
    return table(spark, d, "supplier").select("s_suppkey", files.is_embedded_captions(body).alias("embedded"))


@BOOK.add("SELECT event_type, count(*) AS n FROM events WHERE event_id % 7 > 0 GROUP BY 1")
def query_log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = J.place(spark, "log")
    rows = table(spark, d, "events").select(F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("query"), (F.col("event_id") % 7).cast("int").alias("num_results"))
    files.append_log(rows, path)
    return files.query_log(spark, path).where("num_results > 0").groupBy(F.col("query").alias("event_type")).agg(F.count("*").alias("n"))


@BOOK.add("SELECT count(*) AS total_files, count(*) FILTER (doc_id % 4 = 1) AS changed FROM documents WHERE doc_id % 5 > 0")
def index_resumed(spark: SparkSession, d: str) -> DataFrame:
    """An index is left after one batch; another one over the folder goes on, removes some files and writes itself anew."""
    from ..operators.enrichment import chunks

    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    folder = J.place(spark, "resumed")
    J.IncrementalIndex(spark, folder, lambda rows: chunks(rows, "path")).apply(docs)
    again = J.IncrementalIndex(spark, folder, lambda rows: chunks(rows, "path"))
    again.apply(docs.withColumn("text", F.when(F.col("path").cast("long") % 4 == 1, F.concat(F.lit("more "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))))
    again.remove(docs.where("cast(path as long) % 5 = 0"))
    again.compact()
    total = again.status().select("total_files")
    changed = again.files().join(docs.select("path", T.content_hash(F.col("text")).alias("old")), "path").agg(F.count_if(F.coalesce(F.col("hash") != F.col("old"), F.lit(True))).alias("changed"))
    return total.join(F.broadcast(changed))


@BOOK.add("SELECT 's' || s_suppkey AS id, 'supplier' AS doc_type, s_name AS text FROM supplier WHERE s_suppkey = 7")
def index_entry(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("supplier").alias("doc_type"), F.col("s_name").alias("text"))
    return I.entry(X.build(entries), "s7").select("id", "doc_type", "text")


@BOOK.add("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey = 3")
def graph_edge(spark: SparkSession, d: str) -> DataFrame:
    return I.entry(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), 3)


@BOOK.add("""WITH known AS (SELECT p_name AS surface, 'p' || min(p_partkey) AS id FROM part GROUP BY 1), a(surface, id) AS (VALUES ('gear', 'other'), ('cog', 'p1'), ('hot gear', 'p2'))
    SELECT surface, id FROM known UNION ALL SELECT surface, id FROM a WHERE surface NOT IN (SELECT surface FROM known)""")
def alias_surfaces(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "part").groupBy(F.col("p_name").alias("surface")).agg(F.concat(F.lit("p"), F.min("p_partkey").cast("string")).alias("id"))
    return X.with_aliases(known, {"gear": "other", "cog": "p1", "hot gear": "p2"})


@BOOK.add("SELECT doc_id, list_sort(list_distinct(list_concat(['the'], list_filter(['hand', 'the', 'Tion'], lambda w: contains(lower(text), lower(w)))))) AS entities FROM documents WHERE text IS NOT NULL")
def known_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.array_sort(X.with_known(F.array(F.lit("the")), ("hand", "the", "Tion"), F.col("text"))).alias("entities"))


@BOOK.add("""SELECT 'person' AS type, 'c' || c_custkey AS id, c_name || ' is a buyer at N' || c_nationkey || '.' AS text FROM customer UNION ALL SELECT 'funding', 's' || s_suppkey, s_name || '. Funded by Agency.' FROM supplier""")
def all_summaries(spark: SparkSession, d: str) -> DataFrame:
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    person = E.person(F.col("c_name"), F.lit("buyer"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), none, empty, empty, F.lit(None).cast("int"), F.lit(None).cast("int"))
    people = table(spark, d, "customer").select(F.lit("person").alias("type"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), person.alias("text"))
    money = table(spark, d, "supplier").select(F.lit("funding").alias("type"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), E.funding(F.col("s_name"), F.lit("Agency"), F.lit(None).cast("double"), none).alias("text"))
    return people.unionByName(money)


@BOOK.add("SELECT 'w' || CAST(o_custkey AS VARCHAR) AS person, count(*) AS n FROM orders GROUP BY o_custkey")
def graph_nodes_touched(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("Usage").alias("edge_type"), F.col("o_orderdate").alias("ts"), F.array(F.concat(F.lit("w"), F.col("o_custkey").cast("string"))).alias("agents"), none.alias("inputs"), none.alias("outputs"), none.alias("context"))
    return G.incident_edges(G.membership(edges)).groupBy(F.col("node_id").alias("person")).agg(F.count("*").alias("n"))


@BOOK.add("SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'customer#000000012') ORDER BY c_custkey LIMIT 1")
def person_by_name(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    return R.first_match(rows, R.people_by_name(F.col("c_name"), "Customer#000000012"), "c_custkey").select("c_custkey")
