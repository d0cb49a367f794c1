"""Tables that follow their sources: reloads, snapshot ingestion, partitioned panels and keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk_tables as O
from ..operators import enrichment as E
from ..operators import snapshots as S
from ..operators import voices as V
from ..operators.enrichment import chunks
from ..session import reachable, table
from ..sources import files, registries
from ..sources.directories import directories
from ..sources.published import Watched
from ..streaming import jobs as J
from ..streaming import state as K
from ..streaming import throttle as H
from ..streaming.ingest import SnapshotIngest
from . import enrichment
from ._book import Book

BOOK = Book()


def _reloads(kind: str, watched: Watched, change) -> list[tuple]:
    """What a watched table tells when it is loaded, asked in vain, and asked after a change; and an old reader's count."""
    first = watched.force_reload()
    old = watched.table()
    none = watched.reload_if_changed()
    change()
    after = watched.reload_if_changed()
    again = watched.force_reload()
    told = [(1, True, first["previous"], first["current"]), (2, none is not None, None, None), (3, after is not None, after["previous"], after["current"]), (4, True, again["previous"], again["current"]), (5, False, None, old.count())]
    return [(kind, *t) for t in told]


@BOOK.add("""WITH c AS (SELECT 'chunks' AS kind, count(*) AS a, count(*) FILTER (doc_id % 3 > 0) AS b FROM documents UNION ALL SELECT 'registry', count(*), count(*) FILTER (s_suppkey % 4 > 0) FROM supplier
    UNION ALL SELECT 'graph', count(*), count(*) FILTER (o_orderkey % 5 > 0) FROM orders)
    SELECT kind, 1 AS step, true AS changed, 0::BIGINT AS previous, a AS current FROM c UNION ALL SELECT kind, 2, false, NULL, NULL FROM c UNION ALL SELECT kind, 3, true, a, b FROM c UNION ALL SELECT kind, 4, true, b, b FROM c UNION ALL SELECT kind, 5, false, NULL, a FROM c""")
def reload_on_change(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, people and a graph are loaded, asked for changes, changed, and asked again; step 5 is a reader from before."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("source_file"))
    at = J.place(spark, "chunks")
    docs.write.json(at)
    out = _reloads("chunks", Watched(spark, at, files.chunks, J.place(spark, "watched")), lambda: docs.where("doc_id % 3 > 0").write.mode("overwrite").json(at))
    member = F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"))
    registry = lambda rows: rows.agg(F.struct(F.collect_list(member).alias("members")).alias("people"))
    people, place = table(spark, d, "supplier"), J.place(spark, "registry")
    registry(people).write.json(place)  # a registry is one document
    out += _reloads("registry", Watched(spark, place, registries.people, J.place(spark, "watched")), lambda: registry(people.where("s_suppkey % 4 > 0")).write.mode("overwrite").json(place))
    edges, nodes = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), "o_orderkey"), J.place(spark, "nodes")
    edges.write.parquet(nodes)
    out += _reloads("graph", Watched(spark, nodes, lambda s, p: s.read.parquet(p), J.place(spark, "watched")), lambda: edges.where("o_orderkey % 5 > 0").write.mode("overwrite").parquet(nodes))
    return spark.createDataFrame(out, "kind string, step int, changed boolean, previous long, current long")


def _scans(events: DataFrame) -> DataFrame:
    """A scan document per day and two halves of the users: a user's events of the day are a resource."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("snapshot_date")
    rows = events.groupBy(day, "user_id").agg(F.max("ts").cast("string").alias("mtime"), F.count("*").alias("size_bytes"), F.max_by("event_type", "event_id").alias("owner_username"))
    resource = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), "mtime", "size_bytes", "owner_username")
    return rows.groupBy("snapshot_date", (F.col("user_id") % 2).alias("half")).agg(F.to_json(F.struct(F.max("mtime").alias("scan_timestamp"), F.collect_list(resource).alias("resources"))).alias("value")).select("snapshot_date", "value")


_jobs: dict[tuple[str, str], SnapshotIngest] = {}


def _ingested(spark: SparkSession, d: str) -> SnapshotIngest:
    """Days arrive in two runs, the later ones first, and one file is broken; the last batch is tried again.  An application does so
    once for a folder."""
    key = (spark.sparkContext.applicationId, d)
    if key in _jobs:
        return _jobs[key]
    reachable(spark)
    events, source = table(spark, d, "events"), J.place(spark, "scans")
    scans = _scans(events)
    job = SnapshotIngest(spark, source, J.place(spark, "ingest"), lambda rows: chunks(rows, "path"))
    write = lambda rows: rows.write.mode("append").partitionBy("snapshot_date").text(source)
    write(scans.where("snapshot_date >= '2024-01-15'"))
    spark.range(1).select(F.lit('{"resources": [').alias("value")).write.text(f"{source}/broken-2024-01-01")
    job.run()
    write(scans.where("snapshot_date < '2024-01-15'"))
    job.run()
    job.apply(spark.createDataFrame([("x-2024-01-03", '{"resources": []}')], "path string, value string"), job.batches()[-1])
    _jobs[key] = job
    return job


_PER_DAY = "s AS (SELECT strftime(ts, '%Y-%m-%d') AS day, 'u' || user_id AS name, max(ts) AS mtime, count(*) AS size, arg_max(event_type, event_id) AS owner FROM events GROUP BY 1, 2), days AS (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM (SELECT DISTINCT day FROM s))"
_LOGGED = f"""{_PER_DAY}, n AS (SELECT d.day AS date, s.* FROM s JOIN days d ON s.day = d.day WHERE before IS NOT NULL), o AS (SELECT d.day AS date, s.* FROM s JOIN days d ON s.day = d.before),
    j AS (SELECT coalesce(n.date, o.date) AS date, coalesce(n.name, o.name) AS name, o.size AS a, n.size AS b, o.mtime AS am, n.mtime AS bm, o.owner AS ao, n.owner AS bo FROM n FULL JOIN o ON n.date = o.date AND n.name = o.name),
    log AS (SELECT date, name, 'added' AS change, NULL::BIGINT AS delta FROM j WHERE a IS NULL UNION ALL SELECT date, name, 'removed', NULL FROM j WHERE b IS NULL UNION ALL SELECT date, name, 'modified', NULL FROM j WHERE am <> bm
    UNION ALL SELECT date, name, 'grown', b - a FROM j WHERE b > a UNION ALL SELECT date, name, 'shrunk', a - b FROM j WHERE b < a UNION ALL SELECT date, name, 'owner_changed', NULL FROM j WHERE ao <> bo)"""


@BOOK.add(f"WITH {_LOGGED} SELECT * FROM log")
def ingest_changes(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d).changes().select("date", "name", "change", "delta")


@BOOK.add(f"WITH {_LOGGED} SELECT (SELECT count(DISTINCT day) FROM s) AS snapshots, (SELECT count(*) FROM s) AS resources, (SELECT count(*) FROM log) AS changes, 1::BIGINT AS errors, (SELECT count(DISTINCT day) FROM s) AS inventories")
def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d).status()


@BOOK.add("SELECT strftime(ts, '%Y-%m-%d') AS snapshot_date, count(*) AS n, sum(CASE WHEN strftime(ts, '%Y-%m-%d') = '2024-01-10' THEN -1 ELSE 1 END)::BIGINT AS total FROM events WHERE strftime(ts, '%Y-%m-%d') <> '2024-01-10' OR user_id % 3 = 0 GROUP BY 1")
def panel_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """A panel kept by date, of which one date is written anew."""
    panel = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("snapshot_date"), F.col("user_id").cast("string").alias("name"), "user_id", F.lit(1).alias("x"))
    path = J.place(spark, "panel")
    S.save_panel(panel, path)
    S.save_panel(panel.where("snapshot_date = '2024-01-10' and user_id % 3 = 0").withColumn("x", F.lit(-1)), path)
    return S.load_panel(spark, path).groupBy("snapshot_date").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@BOOK.add("SELECT 'u' || user_id AS name, count(*) AS n FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-10' GROUP BY 1")
def panel_one_date(spark: SparkSession, d: str) -> DataFrame:
    """One date of a panel kept by date: one partition is read."""
    panel = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("snapshot_date"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"))
    path = J.place(spark, "panel")
    S.save_panel(panel, path)
    return S.load_range(S.load_panel(spark, path), "2024-01-10", "2024-01-10").groupBy("name").agg(F.count("*").alias("n"))


@BOOK.add("""WITH m AS (SELECT CAST(conv_id // 4 AS VARCHAR) AS thread, coalesce(role, '') || ':' || coalesce(text, '') AS line, lower(coalesce(text, '')) AS low, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id // 4) AS messages FROM conversations WINDOW w AS (PARTITION BY conv_id // 4 ORDER BY conv_id, turn)),
    s AS (SELECT *, CASE WHEN messages < 15 THEN 0 ELSE 5 * ((messages - 10) // 5) END AS summarized FROM m)
    SELECT thread, messages, summarized, md5(string_agg(line, chr(10) ORDER BY k) FILTER (k > summarized)) AS recent, count(*) FILTER (contains(low, 'the')) AS n_the, count(*) FILTER (contains(low, 'hand')) AS n_hand FROM s GROUP BY 1, 2, 3""")
def stateful_threads(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each thread after a stream of messages."""
    reachable(spark)
    talks = J.stream_table(spark, f"{d}/conversations.parquet")
    thread = F.floor(F.col("conv_id") / 4).cast("string").alias("thread")
    rows = talks.select(thread, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("at"), F.col("turn").alias("seq"), "role", "text")
    out = J.place(spark, "threads")
    with K.rocks(spark):
        J.run_available(K.threads(rows, ("the", "hand"), 10 * 365 * 86400 * 1000), lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}"), out + "-state", "update")
    last = spark.read.parquet(out).groupBy("thread").agg(F.max_by(F.struct("messages", "summarized", "recent", "entities"), "messages").alias("t")).select("thread", "t.*")
    lines = F.array_join(F.transform("recent", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    n = lambda k: F.coalesce(F.try_element_at("entities", F.lit(k)), F.lit(0)).alias(f"n_{k}")
    return last.select("thread", "messages", "summarized", F.md5(lines).alias("recent"), n("the"), n("hand"))


@BOOK.add("""WITH a AS (SELECT CAST(user_id AS VARCHAR) AS cache, event_id AS seq, event_type || '-' || event_id % 7 AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), p AS (SELECT *, lag(k) OVER (PARTITION BY cache, key ORDER BY k) AS before FROM a),
    n AS (SELECT p.cache, p.k, count(DISTINCT b.key) AS apart FROM p LEFT JOIN a b ON b.cache = p.cache AND b.k > p.before AND b.k < p.k WHERE p.before IS NOT NULL GROUP BY 1, 2)
    SELECT p.cache, p.seq, p.key, coalesce(apart < 6, false) AS hit FROM p LEFT JOIN n ON n.cache = p.cache AND n.k = p.k""")
def stateful_lru(spark: SparkSession, d: str) -> DataFrame:
    """Which accesses find their key in a cache of six keys per user."""
    reachable(spark)
    key = F.concat(F.col("event_type"), F.lit("-"), (F.col("event_id") % 7).cast("string")).alias("key")
    rows = J.stream_table(spark, f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("cache"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), key)
    out = J.place(spark, "lru")
    with K.rocks(spark):
        J.run_available(K.lru(rows, 6), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), out + "-state")
    return spark.read.parquet(out).select("cache", "seq", "key", "hit")


@BOOK.add("SELECT event_type AS name, count(DISTINCT user_id % 5)::BIGINT AS subdirectory_count, 1::BIGINT AS level, bool_and(true) AS owned FROM events GROUP BY 1")
def directory_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree written from events, listed by the directory source: the directories of its first level and how many are in each."""
    reachable(spark)
    root = J.place(spark, "tree")
    events = table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("five"), F.concat(F.col("event_id").cast("string"), F.lit(" "), F.col("user_id").cast("string")).alias("value"))
    events.write.partitionBy("event_type", "five").text(root)
    found = directories(spark, root, skip=("_SUCCESS", "._SUCCESS.crc"))
    within = found.where("is_directory and level = 2").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("subdirectory_count"))
    first = found.where("is_directory and level = 1").join(within, "path")
    return first.select(F.regexp_replace("name", "^event_type=", "").alias("name"), "subdirectory_count", F.col("level").cast("long").alias("level"), (F.col("owner_uid") >= 0).alias("owned"))


@BOOK.add("SELECT event_type AS name, count(*) AS lines FROM events WHERE user_id % 5 <> 2 GROUP BY 1")
def directory_files(spark: SparkSession, d: str) -> DataFrame:
    """The files that the directory source lists, without one directory of each branch, read as texts."""
    reachable(spark)
    root = J.place(spark, "tree")
    table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("five"), F.col("event_id").cast("string").alias("value")).write.partitionBy("event_type", "five").text(root)
    listed = directories(spark, root, skip=("five=2",)).where("not is_directory and level = 3 and name like 'part-%'").select("path")
    lines = spark.read.option("recursiveFileLookup", True).text(root).select(F.regexp_replace(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), "^file:/+", "/").alias("path"))
    found = lines.join(listed, "path")
    return found.groupBy(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("name")).agg(F.count("*").alias("lines"))


@BOOK.add("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id % 9 + 1 AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) AS us FROM events),
    r(key, k, since, held, pieces, part, characters, given) AS (SELECT key, k, us, n, 1::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM e WHERE k = 1
        UNION ALL SELECT key, k, CASE WHEN flush THEN us ELSE since END, CASE WHEN flush THEN 0 ELSE h END, CASE WHEN flush THEN 0 ELSE p END, part + CASE WHEN flush THEN 1 ELSE 0 END, CASE WHEN flush THEN h END, CASE WHEN flush THEN p END
        FROM (SELECT e.key, e.k, e.us, r.since, r.part, r.held + e.n AS h, r.pieces + 1 AS p, r.held + e.n >= 30 AND e.us - r.since >= 86400000000 AS flush FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1))
    SELECT key, part - 1 AS part, characters, given AS pieces FROM r WHERE given IS NOT NULL UNION ALL SELECT key, part, held, pieces FROM (SELECT *, k = max(k) OVER (PARTITION BY key) AS last FROM r) WHERE last AND pieces > 0""")
def throttled_sink(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of text per user, given out a day apart and thirty characters at least; what is held last comes by its timer."""
    reachable(spark)
    i = F.col("event_id")
    last = spark.range(1).select(F.lit("~").alias("key"), F.lit("2100-01-01").cast("timestamp").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit("end").alias("text"))
    source, out = J.place(spark, "pieces"), J.place(spark, "given")
    spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), i.alias("seq"), F.repeat(F.lit("x"), (i % 9 + 1).cast("int")).alias("text")).write.parquet(f"{source}/a")
    last.write.parquet(f"{source}/b")  # far later: what is still held is given out by its timer
    rows = spark.readStream.schema(last.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1000).parquet(source)
    with K.rocks(spark):
        J.run_available(H.throttled(rows, 86400.0, 30), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), out + "-state")
    return spark.read.parquet(out).where("key <> '~'").select("key", "part", F.length("text").cast("long").alias("characters"), "pieces")


@BOOK.add(enrichment.BOOK.sql["keyterms_topk"])
def keyterms_from_saved(spark: SparkSession, d: str) -> DataFrame:
    """Key terms by weights that were saved and loaded."""
    docs, path = enrichment._ascii(spark, d), J.place(spark, "weights")
    E.save_idf(E.fit_idf(docs), docs.count(), path)
    weights, n = E.load_idf(spark, path)
    return E.key_terms(docs.where(F.lit(n) > 0), "doc_id", weights, 10, 0.05)


@BOOK.add(f"SELECT doc_id, type, unnest(entities) AS entity FROM ({enrichment.BOOK.sql['gazetteer_extract']})")
def entity_links(spark: SparkSession, d: str) -> DataFrame:
    """What texts mention, kept as a file of links and read again."""
    path = J.place(spark, "links")
    E.save_links(enrichment.gazetteer_extract(spark, d), "doc_id", path)
    return E.load_links(spark, path, "doc_id")


@BOOK.add("SELECT 'type' AS kind, 'n' || n_nationkey AS id, n_name AS name, ['calm', 'n' || n_regionkey] AS held FROM nation UNION ALL SELECT 'individual', 'c' || c_custkey, c_name, [lower(c_mktsegment)] FROM customer")
def voice_store_saved(spark: SparkSession, d: str) -> DataFrame:
    """Profiles saved as a store and loaded again."""
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("id")
    types = table(spark, d, "nation").select(key("n", "n_nationkey"), F.col("n_name").alias("name"), F.lit("").alias("description"), F.array(F.lit("calm"), F.concat(F.lit("n"), F.col("n_regionkey").cast("string"))).alias("tensions"))
    people = table(spark, d, "customer").select(key("c", "c_custkey"), F.col("c_name").alias("name"), F.array(F.lower("c_mktsegment")).alias("topics"))
    path = J.place(spark, "voices")
    V.save(types, people, path)
    types, people = V.load(spark, path)
    return types.select(F.lit("type").alias("kind"), "id", "name", F.col("tensions").alias("held")).union(people.select(F.lit("individual"), "id", "name", "topics"))


@BOOK.add("SELECT 'total' AS name, CAST(count(*) AS VARCHAR) AS value FROM part UNION ALL SELECT 'brands', CAST(count(DISTINCT p_brand) AS VARCHAR) FROM part UNION ALL SELECT p_type, CAST(count(*) AS VARCHAR) FROM part GROUP BY p_type")
def stored_summary(spark: SparkSession, d: str) -> DataFrame:
    """A registry's summary as its document has it."""
    part = table(spark, d, "part")
    counts = part.groupBy("p_type").agg(F.count("*").alias("n")).select(F.col("p_type").alias("name"), F.col("n").cast("string").alias("value"))
    totals = part.agg(F.count("*").alias("total"), F.count_distinct("p_brand").alias("brands")).select(F.explode(F.create_map(F.lit("total"), F.col("total").cast("string"), F.lit("brands"), F.col("brands").cast("string"))).alias("name", "value"))
    path = J.place(spark, "summary")
    counts.union(totals).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("summary")).write.json(path)
    return registries.summary(spark, path)


@BOOK.add()
def overlap_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping chunks of whole documents beside the documents' own columns, by a lateral join."""
    reachable(spark)
    return O.overlapping(table(spark, d, "documents").select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "chunk_index", F.md5("chunk").alias("chunk_md5"), F.length("chunk").alias("characters"), "char_start", "char_end")
