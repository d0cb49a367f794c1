"""Nested JSON registries: people and their publications, entity tables, resources and graphs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLICATION = "struct<title:string,year:int,venue:string,doi:string,citation_count:int,authors:array<string>,topics:array<string>>"
MEMBER = f"struct<id:string,name:string,role:string,institution:string,email:string,midway:struct<username:string>,openalex:struct<works_count:int,cited_by_count:int,h_index:int,topics:array<string>,recent_publications:array<{PUBLICATION}>>>"
ENTITIES = ("projects", "funding", "datasets", "code_repos", "compute", "events", "tools", "decisions", "guides")
_ENTITY = "struct<id:string,name:string,title:string,description:string,status:string,category:string,tags:array<string>,keywords:array<string>,members:array<string>,content:string,primary_use:string,use_cases:array<string>>"
REGISTRY = f"people struct<members:array<{MEMBER}>>, " + ", ".join(f"{e} array<{_ENTITY}>" for e in ENTITIES)
CATEGORIES = ("data_snapshots", "precomputed_resources", "embeddings", "social_media_datasets", "researcher_directories", "shared_infrastructure")
RESOURCE = "struct<id:string,name:string,description:string,path:string,entity_types:array<string>,domain:string,platform:string,content_description:string,username:string,directory_path:string,primary_focus:string,active_projects:array<string>,assessment:string,type:string,owner:string,created_by:string>"
GRAPH = "nodes array<struct<id:string,type:string,name:string,attributes:map<string,string>>>, edges array<struct<id:string,edge_type:string,agents:array<string>,inputs:array<string>,outputs:array<string>,context:array<string>,evidence:array<string>,timestamp:string,confidence:double,created_by:string>>"


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as one row; a missing file is an empty table of the same schema."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def people(spark: SparkSession, path: str) -> DataFrame:
    rows = _document(spark, path, REGISTRY).select(F.posexplode("people.members").alias("ord", "m"))
    topics = F.coalesce("m.openalex.topics", F.array().cast("array<string>"))
    return rows.select("ord", "m.id", "m.name", "m.role", F.col("m.institution").alias("institution"), "m.email", F.col("m.midway.username").alias("username"), topics.alias("topics"), F.col("m.openalex.h_index").alias("h_index"))


def publications(spark: SparkSession, path: str) -> DataFrame:
    rows = _document(spark, path, REGISTRY).select(F.posexplode("people.members").alias("p", "m"))
    rows = rows.select("p", F.col("m.name").alias("owner"), F.col("m.id").alias("person_id"), F.posexplode("m.openalex.recent_publications").alias("k", "pub"))
    none = F.array().cast("array<string>")
    return rows.select((F.col("p") * 100_000 + F.col("k")).cast("long").alias("ord"), "owner", "person_id", "pub.title", "pub.year", "pub.venue", "pub.doi", "pub.citation_count", F.coalesce("pub.authors", none).alias("authors"), F.coalesce("pub.topics", none).alias("topics"))


def entities(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One entity table of the registry in source order."""
    if kind not in ENTITIES:
        raise ValueError(f"no entity table {kind}")
    return _document(spark, path, REGISTRY).select(F.posexplode(kind).alias("ord", "e")).select("ord", "e.*")


def resources(spark: SparkSession, path: str) -> DataFrame:
    """All six resource categories with ``_category``; each may be a list or an object with ``items``."""
    raw = _document(spark, path, ", ".join(f"{c} string" for c in CATEGORIES))
    items = lambda c: F.coalesce(F.from_json(F.col(c), f"items array<{RESOURCE}>")["items"], F.from_json(F.col(c), f"array<{RESOURCE}>"))
    parts = F.array(*[F.struct(F.lit(c).alias("_category"), items(c).alias("items")) for c in CATEGORIES])
    rows = raw.select(F.explode(parts).alias("p")).select("p._category", F.posexplode("p.items").alias("ord", "r"))
    return rows.select("_category", "ord", "r.*")


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph document; unreadable times are null."""
    raw = _document(spark, path, GRAPH)
    edges = raw.select(F.explode("edges").alias("e")).select("e.*").withColumn("ts", F.try_to_timestamp("timestamp")).drop("timestamp")
    return raw.select(F.explode("nodes").alias("n")).select("n.*"), edges


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def refresh(spark: SparkSession, path: str) -> None:
    """Forget what is cached of a path, so that the next read sees the files of now."""
    spark.catalog.refreshByPath(path)


def summary(spark: SparkSession, path: str) -> DataFrame:
    """``(name, value)`` of a document's stored summary; a document without one has none.  Nested values are JSON texts."""
    return _document(spark, path, "summary map<string,string>").select(F.explode("summary").alias("name", "value"))
