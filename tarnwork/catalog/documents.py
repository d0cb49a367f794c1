"""Queries over documents and files: nations and regions are written as registries, scans, chats and texts, and read back.

A registry, a snapshot or a manifest is one document by nature, so these are made of small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import inventory as I
from ..operators import voices as V
from ..session import table
from ..sources import files, registries
from ..streaming import jobs as J
from ._book import Book

BOOK = Book()


def _document(rows: DataFrame, path: str, *columns: Column) -> str:
    """One JSON document of a small table."""
    rows.agg(F.to_json(F.struct(*columns)).alias("value")).coalesce(1).write.text(path)
    return path


def _list(item: Column, order: str = "n_nationkey") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), item.alias("item")))), lambda x: x["item"])


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _registry(spark: SparkSession, d: str) -> str:
    k = F.col("n_nationkey")
    paper = F.struct(_text("On ", F.col("n_name")).alias("title"), (2000 + k).cast("int").alias("year"), F.when(k % 2 == 0, _text("10/", k)).alias("doi"), k.cast("int").alias("citation_count"), F.array(F.col("n_name")).alias("authors"))
    work = F.struct(k.cast("int").alias("h_index"), F.array(F.lit("trade"), F.lower("n_name")).alias("topics"), F.array(paper).alias("recent_publications"))
    member = F.struct(_text("p", k).alias("id"), F.col("n_name").alias("name"), F.when(k % 3 > 0, "Director").alias("role"), _text("R", F.col("n_regionkey")).alias("institution"), F.lit(1).alias("unknown_field"), work.alias("openalex"))
    kind = lambda prefix: F.struct(_text(prefix, k).alias("id"), F.col("n_name").alias("name"), F.array(F.lit("t")).alias("tags"))
    people = F.struct(_list(member).alias("members")).alias("people")
    return _document(table(spark, d, "nation"), J.place(spark, "registry"), people, _list(kind("j")).alias("projects"), _list(kind("d")).alias("datasets"), _list(kind("g")).alias("guides"))


@BOOK.add("SELECT 'p' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 3 > 0 THEN 'Director' END AS role, 'R' || n_regionkey AS institution, ['trade', lower(n_name)] AS topics, n_nationkey::INT AS h_index FROM nation")
def registry_people(spark: SparkSession, d: str) -> DataFrame:
    return registries.people(spark, _registry(spark, d)).select("id", "name", "role", "institution", "topics", "h_index")


@BOOK.add("SELECT n_name AS owner, 'p' || n_nationkey AS person_id, 'On ' || n_name AS title, (2000 + n_nationkey)::INT AS year, CASE WHEN n_nationkey % 2 = 0 THEN '10/' || n_nationkey END AS doi, [n_name] AS authors FROM nation")
def registry_publications(spark: SparkSession, d: str) -> DataFrame:
    return registries.publications(spark, _registry(spark, d)).select("owner", "person_id", "title", "year", "doi", "authors")


@BOOK.add("SELECT k AS kind, left(k, 1) || n_nationkey AS id, n_name AS name, ['t'] AS tags FROM nation, (SELECT unnest(['jprojects', 'datasets', 'guides']) AS k) UNION ALL SELECT 'missing', NULL, NULL, NULL WHERE false")
def registry_entities(spark: SparkSession, d: str) -> DataFrame:
    path = _registry(spark, d)
    read = lambda kind, name: registries.entities(spark, path, kind).select(F.lit(name).alias("kind"), "id", "name", "tags")
    return read("projects", "jprojects").union(read("datasets", "datasets")).union(read("guides", "guides")).union(read("tools", "tools"))


@BOOK.add("SELECT c AS _category, left(c, 1) || n_nationkey AS id, n_name AS name FROM nation, (SELECT unnest(['data_snapshots', 'embeddings', 'social_media_datasets']) AS c)")
def registry_resources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    item = lambda prefix: _list(F.struct(_text(prefix, k).alias("id"), F.col("n_name").alias("name")))
    within = F.struct(item("d").alias("items")).alias("data_snapshots")
    path = _document(table(spark, d, "nation"), J.place(spark, "resources"), within, item("e").alias("embeddings"), item("s").alias("social_media_datasets"))
    return registries.resources(spark, path).select("_category", "id", "name")


@BOOK.add("SELECT 'node' AS kind, 'n' || n_nationkey AS id, n_name AS name, NULL::VARCHAR AS at FROM nation UNION ALL SELECT 'edge', 'e' || n_nationkey, 'n' || n_nationkey, CASE WHEN n_nationkey % 4 > 0 THEN '2024-01-01' END FROM nation")
def graph_document(spark: SparkSession, d: str) -> DataFrame:
    """Read, saved and loaded again."""
    k = F.col("n_nationkey")
    node = F.struct(_text("n", k).alias("id"), F.lit("Person").alias("type"), F.col("n_name").alias("name"))
    edge = F.struct(_text("e", k).alias("id"), F.lit("Usage").alias("edge_type"), F.array(_text("n", k)).alias("agents"), F.when(k % 4 > 0, "2024-01-01T00:00:00").otherwise("soon").alias("timestamp"))
    nodes, edges = registries.graph(spark, _document(table(spark, d, "nation"), J.place(spark, "graph"), _list(node).alias("nodes"), _list(edge).alias("edges")))
    folder = J.place(spark, "saved-graph")
    registries.save_graph(nodes, edges, folder)
    registries.refresh(spark, folder)
    saved = spark.read.parquet(f"{folder}/edges").select(F.lit("edge").alias("kind"), "id", F.col("agents")[0].alias("name"), F.date_format("ts", "yyyy-MM-dd").alias("at"))
    return spark.read.parquet(f"{folder}/nodes").select(F.lit("node").alias("kind"), "id", "name", F.lit(None).cast("string").alias("at")).union(saved)


def _scan(spark: SparkSession, d: str) -> str:
    k = F.col("n_nationkey")
    resource = F.struct(_text("r", k).alias("id"), F.col("n_name").alias("name"), _text("R", F.col("n_regionkey")).alias("resource_type"), (k * 10).alias("size_bytes"), (k % 2 == 0).alias("is_valuable"))
    owned = F.struct(_text("o", k).alias("id"), _text("u", k % 3).alias("person_username"), _text("r", k).alias("resource_id"))
    return _document(table(spark, d, "nation"), J.place(spark, "scan") + "/2024-01-03", F.lit("2024-01-03T00:00:00").alias("scan_timestamp"), _list(resource).alias("resources"), _list(owned).alias("ownership_hyperedges"))


@BOOK.add("SELECT '2024-01-03' AS snapshot_date, 'r' || n_nationkey AS id, n_name AS name, n_nationkey::BIGINT * 10 AS size_bytes, n_nationkey % 2 = 0 AS is_valuable FROM nation")
def snapshot_document(spark: SparkSession, d: str) -> DataFrame:
    found = files.snapshot(spark, _scan(spark, d))
    again = J.place(spark, "scan-lines")
    I.save_snapshot(found, again)
    return spark.read.schema(found.schema).json(again).select("snapshot_date", "id", "name", "size_bytes", "is_valuable")


@BOOK.add("SELECT 'o' || n_nationkey AS id, 'u' || n_nationkey % 3 AS person_username, 'r' || n_nationkey AS resource_id FROM nation")
def snapshot_ownership(spark: SparkSession, d: str) -> DataFrame:
    return files.ownership(spark, _scan(spark, d)).select("id", "person_username", "resource_id")


@BOOK.add("SELECT r_name AS channel, n_name || ' says something long' AS text, 'U' || n_nationkey AS user, 'The ' || n_name AS user_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 > 1")
def chat_export(spark: SparkSession, d: str) -> DataFrame:
    """One folder a channel, one file a day; joins, bots and short messages are left out."""
    folder, k = J.place(spark, "chat"), F.col("n_nationkey")
    kind = F.when(k % 5 == 0, "channel_join")
    said = F.when(k % 5 == 1, "short").otherwise(_text(F.col("n_name"), " says something long"))
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    for (channel,) in table(spark, d, "region").select("r_name").collect():  # five regions
        message = F.struct(said.alias("text"), _text("U", k).alias("user"), kind.alias("subtype"))
        rows.where(F.col("r_name") == channel).agg(F.to_json(_list(message)).alias("value")).coalesce(1).write.text(f"{folder}/{channel}")
        _renamed(spark, f"{folder}/{channel}")
    users = table(spark, d, "nation").select(_text("U", k).alias("id"), _text("The ", F.col("n_name")).alias("name"))
    return files.chat_messages(spark, folder, users).select("channel", "text", "user", "user_name")


def _renamed(spark: SparkSession, folder: str, name: str = "2024-01-01.json") -> None:
    """Gives the one part file of a folder a name of its own."""
    path, system = J._folder(spark, folder)
    for status in system.listStatus(path):
        if status.getPath().getName().startswith("part-"):
            system.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))


@BOOK.add("SELECT n_name AS name, '/data/' || n_nationkey AS path, 'u' || n_regionkey AS owner, n_nationkey % 3 = 0 AS is_valuable FROM nation")
def catalog_document(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    block = F.concat(F.lit("Name: "), "n_name", F.lit("\nPath: /data/"), k.cast("string"), F.lit("\nOwner: u"), F.col("n_regionkey").cast("string"), F.when(k % 3 == 0, "\nAssessment: valuable").otherwise("\nAssessment: old"))
    path = J.place(spark, "catalog")
    table(spark, d, "nation").agg(F.array_join(_list(block), "\n" + "-" * 80 + "\n").alias("value")).coalesce(1).write.text(path)
    return files.catalog_entries(spark, path).select("name", "path", "owner", "is_valuable")


@BOOK.add("SELECT r_name AS source_file, n_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def parsed_elements(spark: SparkSession, d: str) -> DataFrame:
    """A full text whose elements a manifest deals to files."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text, per = J.place(spark, "full-text"), rows.groupBy("n_regionkey", "r_name").agg(F.count("*").alias("n"))
    ordered = rows.withColumn("place", F.col("n_regionkey") * 1000 + F.col("n_nationkey"))
    ordered.agg(F.array_join(_list(F.col("n_name"), "place"), "\n\n").alias("value")).coalesce(1).write.text(text)
    item = F.struct(F.col("r_name").alias("name"), F.col("r_name").alias("path"), F.col("n").cast("int").alias("num_elements"))
    manifest = _document(per, J.place(spark, "manifest"), F.lit("now").alias("created_at"), _list(item, "n_regionkey").alias("files"))
    return files.parsed_elements(spark, manifest, text).select("source_file", F.regexp_replace("text", r"\n$", "").alias("text"))


@BOOK.add("SELECT r_name || '.txt' AS name, r_name || ' text' || chr(10) AS text, true AS is_utf8, left(sha256(r_name || ' text' || chr(10)), 16) AS hash FROM region")
def text_files(spark: SparkSession, d: str) -> DataFrame:
    folder = J.place(spark, "texts")
    for (name,) in table(spark, d, "region").select("r_name").collect():  # five regions
        spark.createDataFrame([(f"{name} text",)], "value string").coalesce(1).write.text(f"{folder}/{name}")
        _renamed(spark, f"{folder}/{name}", f"{name}.txt")
    listed = files.listing(spark, folder).where("name like '%.txt'").select("path", "name")
    return files.documents(spark, folder).join(listed, "path").select("name", "text", "is_utf8", "hash")


@BOOK.add("SELECT n_name AS text, 'f' || n_regionkey AS source_file, n_nationkey::INT AS page_number, ['x'] AS topics FROM nation")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    path, k = J.place(spark, "chunks"), F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.col("n_name").alias("text"), _text("f", F.col("n_regionkey")).alias("source_file"), k.cast("int").alias("page_number"), F.array(F.lit("x")).alias("topics"), F.lit(1).alias("unknown_field"))
    rows.write.json(path)
    return files.chunks(spark, path).select("text", "source_file", "page_number", "topics")


@BOOK.add("SELECT 'type' AS kind, 'n' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'individual', 'i' || n_nationkey, n_name FROM nation")
def voice_store(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    pairs = lambda prefix, value: F.map_from_entries(_list(F.struct(_text(prefix, k), value)))
    kind = F.struct(F.col("n_name").alias("name"), F.array(F.lit("calm")).alias("tensions"))
    path = _document(table(spark, d, "nation"), J.place(spark, "voices"), pairs("n", kind).alias("compound_types"), pairs("i", F.struct(F.col("n_name").alias("name"))).alias("individuals"))
    types, people = V.load(spark, path)
    return types.select(F.lit("type").alias("kind"), "id", "name").union(people.select(F.lit("individual"), "id", "name"))


@BOOK.add("SELECT c_custkey, left(sha256(c_name), 16) AS hash, list_sort(['trade', lower(c_mktsegment)]) AS topics FROM customer")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.content_hash(F.col("c_name")).alias("hash"), F.array_sort(F.array(F.lit("trade"), F.lower("c_mktsegment"))).alias("topics"))
