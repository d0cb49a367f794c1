"""Texts, chunks, snapshots, logs, chats and captions as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash

CHUNK = (
    "text string, source_file string, source_path string, element_type string, chunk_index int, total_chunks int, page_number int, section string, doc_type string, date_year int, date_month int, char_start int, char_end int, timestamp_start string, "
    "timestamp_end string, speakers string, people array<string>, organizations array<string>, projects array<string>, grants array<string>, dates array<string>, topics array<string>, key_terms array<string>"
)
RESOURCE = "struct<id:string,name:string,path:string,resource_type:string,owner_username:string,owner_uid:int,size_bytes:bigint,mtime:string,description:string,assessment:string,is_valuable:boolean,is_active:boolean,subdirectory_count:int,file_count:int>"
SNAPSHOT = f"scan_timestamp string, base_path string, resource_count int, resources array<{RESOURCE}>, ownership_hyperedges array<struct<id:string,person_username:string,resource_id:string,timestamp:string,confidence:double,evidence:string>>"
LOG = "timestamp string, query string, classification struct<type:string,entity_types:array<string>,confidence:double,is_compound:boolean>, num_results int, latency_ms double, corrected_query string, corrections array<struct<original:string,corrected:string,similarity:double>>, error string"
CHAT = "text string, user string, ts string, thread_ts string, subtype string"
MANIFEST = "created_at string, files array<struct<name:string,path:string,num_elements:int>>"


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows; fields that the schema doesn't know are dropped."""
    return spark.read.schema(CHUNK).json(path)


def documents(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (".txt", ".md", ".vtt")) -> DataFrame:
    """Whole text files below a folder with path, time of change, size and content hash; bytes that are no UTF-8 are
    replaced, and ``is_utf8`` tells.  Empty files have no row, as Spark does not read them."""
    raw = F.col("content").cast("string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    wanted = files.where(F.col("path").rlike("(?i)(" + "|".join(map(re.escape, extensions)) + ")$"))
    return wanted.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"), F.make_valid_utf8(raw).alias("text"), F.is_valid_utf8(raw).alias("is_utf8"), content_hash(F.col("content")).alias("hash"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Names, sizes and times below a folder without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.regexp_replace("path", r"/[^/]+$", "").alias("parent"), "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The resources of snapshot documents, with the date in the file name."""
    raw = spark.read.schema(SNAPSHOT).json(path, multiLine=True).withColumn("snapshot_date", F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})", 1))
    return raw.select("snapshot_date", "scan_timestamp", F.posexplode("resources").alias("ord", "r")).select("snapshot_date", "scan_timestamp", "ord", "r.*")


def ownership(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).json(path, multiLine=True).select(F.explode("ownership_hyperedges").alias("e")).select("e.*")


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines; lines that are no JSON are dropped."""
    return spark.read.schema(LOG).json(path, mode="DROPMALFORMED")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def chat_messages(spark: SparkSession, folder: str, users: DataFrame | None = None, least: int = 20) -> DataFrame:
    """Messages of per-channel daily exports, without joins, leaves and bots, of at least ``least`` characters."""
    raw = spark.read.schema(CHAT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder, multiLine=True)
    folder_name = F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1)
    raw = raw.withColumn("channel", F.url_decode(F.replace(folder_name, F.lit("+"), F.lit("%2B"))))  # paths come URL-encoded
    said = raw.where(~F.coalesce("subtype", F.lit("")).isin("channel_join", "channel_leave", "bot_message") & (F.length("text") >= least))
    return said.join(users.select(F.col("id").alias("user"), F.col("name").alias("user_name")), "user", "left") if users is not None else said


def parsed_elements(spark: SparkSession, manifest: str, text: str) -> DataFrame:
    """Blank-line-separated elements of a full text, each with the file that the manifest's running sum gives it."""
    files = spark.read.schema(MANIFEST).json(manifest, multiLine=True).select(F.posexplode("files").alias("f", "file"))
    bounds = files.agg(F.array_sort(F.collect_list(F.struct("f", F.col("file.name").alias("name"), F.col("file.num_elements").alias("n")))).alias("files"))  # a manifest is one document
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<name:string,lo:int,hi:int>>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + x["n"]).alias("at"), F.array_append(s["out"], F.struct(x["name"].alias("name"), s["at"].alias("lo"), (s["at"] + x["n"]).alias("hi"))).alias("out"))
    bounds = bounds.select(F.explode(F.aggregate("files", begin, step)["out"]).alias("b")).select("b.*")
    places = bounds.where("hi > lo").select(F.col("name").alias("source_file"), F.explode(F.sequence("lo", F.col("hi") - 1)).alias("element"))
    elements = spark.read.text(text, wholetext=True).select(F.posexplode(F.split("value", r"\n\n")).alias("element", "text"))
    return elements.join(places, "element").select("element", "source_file", "text")


_STAMP = re.compile(r"((?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{3})\s*-->\s*((?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{3})")
_SPEAKER = re.compile(r"^(?:<v\s+([^>]+)>|([A-Z][\w .'-]{0,40}):\s)(.*)$", re.DOTALL)


def _seconds(stamp: str) -> float:
    total = 0.0
    for part in stamp.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def parse_captions(body: str) -> list[tuple[float, float, str | None, str]]:
    """Cues of a caption text: start and end in seconds, speaker where one is named, and text."""
    out = []
    marks = list(_STAMP.finditer(body))
    for m, after in zip(marks, [*marks[1:], None], strict=True):
        part = body[m.end() : after.start() if after else len(body)]
        lines = [x.strip() for x in part.strip("\n").split("\n")]
        if after and lines and (lines[-1].isdigit() or not lines[-1]):
            lines.pop()
        said = " ".join(x for x in lines if x).replace("</v>", "").strip()
        named = _SPEAKER.match(said)
        speaker, said = ((named[1] or named[2]).strip(), named[3].strip()) if named else (None, said)
        if said:
            out.append((_seconds(m[1]), _seconds(m[2]), speaker, said))
    return out


def captions(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Segments ``(key, start_s, end_s, speaker, text)`` of caption texts, one row per cue."""
    kind = dict(files.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *cue) for k, body in zip(frame[key], frame[text], strict=True) for cue in parse_captions(body or "")]
            yield pd.DataFrame(rows, columns=[key, "start_s", "end_s", "speaker", "text"])

    return files.select(key, text).mapInPandas(run, f"`{key}` {kind}, start_s double, end_s double, speaker string, text string")


def is_embedded_captions(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\d{1,2}:\d{2}[.,:]\d{2,3}\s*-->")) >= 5


def utterances(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``Speaker: text`` lines; only the first line of an utterance is kept."""
    line = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^([^:\n]+:[^\n]+)$"), F.lit(1))
    rows = files.select(key, F.posexplode(line).alias("pos", "line"))
    return rows.select(key, "pos", F.trim(F.split("line", ":", 2)[0]).alias("speaker"), F.trim(F.split("line", ":", 2)[1]).alias("said"))


def catalog_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a free-text catalog whose blocks are parted by long dashes; later entries of a name win."""
    blocks = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\n-{70,}\n")).alias("ord", "block"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("block", rf"(?mi)^\s*{name}\s*:\s*(.+)$", 1)), F.lit(""))
    rows = blocks.select("ord", field("name").alias("name"), field("path").alias("path"), field("owner").alias("owner"), field("size").alias("size"), field("description").alias("description"), field("assessment").alias("assessment"), F.col("block").rlike("(?i)valuable|important").alias("is_valuable"), F.col("block").rlike("(?i)active|in use").alias("is_active"))
    return rows.where("name is not null").groupBy("name").agg(F.max_by(F.struct("path", "owner", "size", "description", "assessment", "is_valuable", "is_active"), "ord").alias("e")).select("name", "e.*")
