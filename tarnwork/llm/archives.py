"""Web archives: ARC files of both versions, their conversion to WARC, and readers of both.

Reading goes by the formats' own means: a file's version block says how its header lines are to be read, and a
header line declares how many bytes follow, so a payload may hold anything, header lines too.

1. ``write_arc`` writes pages as ARC records (an HTTP response each).  ``convert`` reads ARC records and synthesises
   what WARC asks for: an identifier from the file's own name and the record's place (a rerun gives the same), a
   timestamp from the 14 digits, a type from the scheme and the block, SHA-1 digests of payload and block.
2. Of records with one payload (equal SHA-256 and length) that with the largest page_id is written whole, the others as
   revisits of it.  A payload's count of copies decides nothing: rows meet their group's choice on the payload and a
   salt, so a payload that a third of all records share is spread over many tasks.
3. Archives are written by Spark's text writer, a record per line whose separator is the record's last byte (casting to
   string keeps bytes as they are), ``per_file`` records a file, compressed as a whole.  They are read with Spark's
   binary file source, so any store will do; a file must fit into a task, its records are read from it one by one.

Defined cases: null html is an empty payload; a null url is ``-``; a null page_id ranks lowest and comes back null; of rows with
equal payload and page_id one is the response, the rest revisit it; an empty table gives empty archives; a
truncated file or one that is no archive ends the job with its name and place; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import _sweep_at_end, partitions, shared_dir, shared_table

ID_HEADER = "X-Page-Id"
#: Field names of a header line by version of the format; the last declares the length, the url comes first.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_BATCH = 8 << 20
_ROWS = (1 << 33) - 1


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _write(rows: DataFrame, opening: Callable[[Column, Column], Column], name: str, per_file: int) -> str:
    """Write ``value`` (binary, without its last byte, a line feed) as files that begin with ``opening`` of file and row."""
    spark = rows.sparkSession
    folder = shared_dir(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    value = F.concat(F.when(F.col("_row") % per_file == 0, opening(F.col("_part"), F.floor(F.col("_row") / per_file))).otherwise(F.lit("")).cast("binary"), F.col("value"))
    rows.select(value.cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)
    _sweep_at_end(spark, folder)
    return path


def _placed(rows: DataFrame) -> DataFrame:
    """Adds the part of each row and its place there, as the writer will see them."""
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    return rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit(_ROWS)))


def write_arc(pages: DataFrame, date: str = "20000101000000", ip: str = "0.0.0.0", per_file: int = 1000, version: int | None = None) -> str:
    """Write ``pages(page_id, url, html)`` as ARC files of the given version, or file by file of both, and return their
    folder."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    url = F.coalesce(F.nullif(F.col("url").cast("string"), F.lit("")), F.lit("-"))
    for char in " \t\n\r":
        url = F.replace(url, F.lit(char), F.lit(f"%{ord(char):02X}"))
    number = F.coalesce(_text(ID_HEADER + ": ", F.col("page_id").cast("string"), "\r\n"), F.lit(""))
    head = _text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.octet_length("body").cast("string"), "\r\n", number, "\r\n")
    rows = _placed(pages.select("page_id", url.alias("url"), body.alias("body")))
    rows = rows.withColumn("block", F.concat(head.cast("binary"), F.col("body")))
    chosen = lambda part, file: F.lit(version) if version else F.lit(1) + (part + file) % 2
    kind = chosen(F.col("_part"), F.floor(F.col("_row") / per_file))
    label = lambda part, file: _text("pages-", part.cast("string"), "-", file.cast("string"), ".arc.gz")
    length = F.octet_length("block").cast("string")
    first = _text(F.col("url"), f" {ip} {date} text/html ")
    more = _text("200 ", F.md5("block"), " - - ", label(F.col("_part"), F.floor(F.col("_row") / per_file)), " ")
    line = _text(first, F.when(kind == 2, more).otherwise(F.lit("")), length, "\n")

    def opening(part: Column, file: Column) -> Column:
        told = lambda v: f"{v} 0 tarnwork\n{' '.join(ARC_FIELDS[v])}\n"
        head = lambda v: _text("filedesc://", label(part, file), f" {ip} {date} text/plain ", "200 - - 0 " if v == 2 else "", *([label(part, file), " "] if v == 2 else []), f"{len(told(v))}\n{told(v)}\n")
        return F.when(chosen(part, file) == 2, head(2)).otherwise(head(1))

    return _write(rows.select("_part", "_row", F.concat(line.cast("binary"), F.col("block")).alias("value")), opening, "arc", per_file)


def _opened(content: bytes) -> io.BufferedIOBase:
    """The file's bytes, unpacked as they are read; a file of several gzip members is read through."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _exactly(stream: io.BufferedIOBase, length: int) -> bytes:
    data = stream.read(length)
    if len(data) < length:
        raise ValueError(f"truncated: {length} bytes declared, {len(data)} found")
    return data


def _header(stream: io.BufferedIOBase) -> tuple[int, bytes]:
    """The place and text of the next line that is not empty; an empty text at the end."""
    while True:
        at = stream.tell()
        line = stream.readline()
        if not line or line.strip(b"\r\n"):
            return at, line.rstrip(b"\r\n")


def arc_records(stream: io.BufferedIOBase) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """``(file name, place, version, fields, block)`` of the records behind a file's version block."""
    at, line = _header(stream)
    if not line:
        return
    if not line.startswith(b"filedesc://"):
        raise ValueError("no version block")
    name = line.split(b" ", 1)[0][len(b"filedesc://") :].decode("utf-8", "replace")
    told = _exactly(stream, int(line.rsplit(b" ", 1)[1])).split(b"\n")
    version = int(told[0].split()[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown version {version}")
    names = ARC_FIELDS[version]
    while True:
        at, line = _header(stream)
        if not line:
            return
        values = line.rsplit(b" ", len(names) - 1)  # a url may hold spaces, the other fields none
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"no header line of version {version} at {at}")
        yield name, at, version, dict(zip(names, (v.decode("utf-8", "replace") for v in values), strict=True)), _exactly(stream, int(values[-1]))


def warc_records(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(place, named fields in lower case, block)`` of a WARC file's records."""
    while True:
        at, line = _header(stream)
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        fields, name = {}, ""
        while (line := stream.readline()).strip(b"\r\n"):
            if line[:1] in b" \t" and name:  # goes on
                fields[name] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, value = line.decode("utf-8", "replace").split(":", 1)
            name = name.strip().lower()
            fields[name] = value.strip()
        yield at, fields, _exactly(stream, int(fields["content-length"]))


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head, its empty line included, and its payload; no head where the block is no such message."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(i + len(mark), i) for mark in (b"\r\n\r\n", b"\n\n") if (i := block.find(mark)) >= 0]
    end = min(ends, key=lambda x: x[1])[0] if ends else len(block)
    return block[:end], block[end:]


def sha1(data: bytes) -> str:
    """The bare upper-case base32 form that archives use."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _page_id(head: bytes) -> int | None:
    for line in head.split(b"\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == ID_HEADER.lower().encode():
            return int(value)
    return None


_ARC = pa.schema([("record_id", pa.string()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("page_id", pa.int64()), ("key", pa.binary()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("head_digest", pa.string()), ("head", pa.binary()), ("payload", pa.binary())])
_WARC = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("date", pa.string()), ("url", pa.string()), ("declared_digest", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") + 500
        if size > _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _files(batches: Iterator[pa.RecordBatch], rows: Callable[[io.BufferedIOBase], Iterator[tuple]]) -> Iterator[tuple]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            try:
                yield from rows(_opened(content.as_py()))
            except (ValueError, EOFError, OSError, KeyError) as error:
                raise ValueError(f"{path.as_py()}: {error}") from error


def _arc_rows(bodies: bool) -> Callable:
    def rows(stream: io.BufferedIOBase) -> Iterator[tuple]:
        for name, at, version, fields, block in arc_records(stream):
            head, payload = split_http(block)
            identity = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{name}#{at}')}"
            key = hashlib.sha256(payload).digest() + len(payload).to_bytes(8, "big")
            digests = (sha1(payload), sha1(block), sha1(head)) if bodies else (None, None, None)
            kept = (head, payload) if bodies else (None, None)
            yield (identity, version, fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], _page_id(head), key, *digests, *kept)

    return lambda batches: _batches(_files(batches, rows), _ARC)


def _warc_rows(bodies: bool) -> Callable:
    def rows(stream: io.BufferedIOBase) -> Iterator[tuple]:
        for _, fields, block in warc_records(stream):
            head, payload = split_http(block)
            told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            digest = sha1(payload)
            kind = fields.get("warc-type")
            if kind == "response" and told and told != digest:
                raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest")
            bare = lambda name: fields.get(name, "").strip("<>") or None  # noqa: B023, E731
            yield (bare("warc-record-id"), kind, bare("warc-refers-to"), fields.get("warc-date"), fields.get("warc-target-uri"), told or None, _page_id(head), len(payload), digest, payload if bodies else None)

    return lambda batches: _batches(_files(batches, rows), _WARC)


def _read(spark: SparkSession, path: str, parse: Callable, schema: pa.Schema) -> DataFrame:
    from pyspark.sql.pandas.types import from_arrow_schema

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, from_arrow_schema(schema))


def read_arc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """A row per ARC record of the files of a folder; without ``bodies`` neither heads, payloads nor digests but the key."""
    return _read(spark, path, _arc_rows(bodies), _ARC)


def read_warc(spark: SparkSession, path: str, bodies: bool = False) -> DataFrame:
    """A row per WARC record of the files of a folder, its payload's size and digest as read from its bytes."""
    return _read(spark, path, _warc_rows(bodies), _WARC)


def _meet(rows: DataFrame, light: DataFrame, key: str, table: DataFrame, apart: str) -> DataFrame:
    """``rows`` with the one row that ``table`` has for their key; keys that many rows have are salted by ``apart``.
    ``light`` has the rows' ``key`` and ``apart`` alone."""
    salt = F.pmod(F.xxhash64(apart), F.lit(max(64, partitions(rows.sparkSession)))).alias("_salt")
    needed = light.select(key, salt).distinct().join(table, key)
    return rows.select("*", salt).join(needed, [key, "_salt"]).drop("_salt")


def convert(spark: SparkSession, legacy: str, per_file: int = 1000) -> str:
    """Write the ARC records below ``legacy`` as WARC records and return their folder."""
    light = shared_table(read_arc(spark, legacy, bodies=False).select("key", "record_id", "page_id", "url", "date"), "arc_records")
    chosen = light.groupBy("key").agg(F.max(F.struct("page_id", "record_id", "url", "date")).alias("first"))
    rows = _meet(read_arc(spark, legacy), light, "key", chosen, "record_id")
    again = F.col("record_id") != F.col("first.record_id")
    http = F.octet_length("head") > 0
    kind = F.when(again, "revisit").when(http, "response").otherwise("resource")
    stamp = lambda d: F.regexp_replace(F.rpad(d, 14, "0"), r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).*", "$1-$2-$3T$4:$5:$6Z")
    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    field = lambda name, value: _text(name + ": ", value, "\r\n")
    refers = F.when(again, F.concat(field("WARC-Refers-To", _text("<", F.col("first.record_id"), ">")), field("WARC-Refers-To-Target-URI", F.col("first.url")), field("WARC-Refers-To-Date", stamp(F.col("first.date"))), F.lit(f"WARC-Profile: {REVISIT}\r\n")))
    head = _text(
        "WARC/1.0\r\n", field("WARC-Type", kind), field("WARC-Record-ID", _text("<", F.col("record_id"), ">")), field("WARC-Date", stamp(F.col("date"))), field("WARC-Target-URI", F.col("url")), field("WARC-IP-Address", F.col("ip")),
        field("WARC-Payload-Digest", _text("sha1:", F.col("payload_digest"))), field("WARC-Block-Digest", _text("sha1:", F.when(again, F.col("head_digest")).otherwise(F.col("block_digest")))), F.coalesce(refers, F.lit("")),
        field("Content-Type", F.when(http, "application/http;msgtype=response").otherwise(F.col("mime"))), field("Content-Length", F.octet_length(block).cast("string")), "\r\n",
    )
    value = F.concat(head.cast("binary"), block, F.lit("\r\n\r").cast("binary"))

    def opening(part: Column, file: Column) -> Column:
        name = _text("pages-", part.cast("string"), "-", file.cast("string"), ".warc.gz")
        identity = F.regexp_replace(F.md5(name), "(.{8})(.{4}).(.{3}).(.{3})(.{12})", "$1-$2-5$3-8$4-$5")
        told = "software: tarnwork\r\nformat: WARC File Format 1.0\r\ndescription: converted from ARC\r\n"
        return _text("WARC/1.0\r\nWARC-Type: warcinfo\r\n", field("WARC-Record-ID", _text("<urn:uuid:", identity, ">")), "WARC-Date: 2000-01-01T00:00:00Z\r\n", field("WARC-Filename", name), f"Content-Type: application/warc-fields\r\nContent-Length: {len(told)}\r\n\r\n{told}\r\n\r\n")

    return _write(_placed(rows.select(value.alias("value"))), opening, "warc", per_file)


def digest(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of the records that were pages."""
    names = ["page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type")]
    records = shared_table(records.drop("payload"), "warc_records")  # archives are read once
    whole = records.where("type IN ('response', 'resource')")
    first = whole.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of"), "payload_bytes", "payload_digest")
    again = records.where("type = 'revisit'").select("record_id", "refers_to", "page_id")
    found = _meet(again, again, "refers_to", first, "record_id")
    back = found.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("of").alias("refers_to"))
    return whole.select(*names, F.lit(None).cast("long").alias("refers_to")).unionByName(back)
