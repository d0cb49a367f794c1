"""Archives: round trips, both ARC versions, odd payloads and broken files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections import defaultdict

import pytest

pytest.importorskip("tarnwork.llm")

from tarnwork.llm import archives
from tarnwork.llm._shared import reachable

ODD = [
    (1, "http://a/ b", b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (2, None, None), (3, "", b""), (None, "x", b""), (5, "u\nv", b"\xff\xfe\x00\n\n"),
    (6, "q", b"\xff\xfe\x00\n\n"), (6, "q", b"\xff\xfe\x00\n\n"), (7, "z", b"filedesc://x 0 0 t 5\n1 0 a\n"), (8, "y", b"HTTP/1.1 200 OK\r\n\r\nnested"), (9, "long", b"<p>" * 400_000),
]


def rows():
    return ODD + [(i, f"http://h/{i}", b"<p>%d" % (i % 7) * (i % 50)) for i in range(10, 300)]


def wanted(pages):
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[html or b""].append(i)
    out = []
    for html, ids in groups.items():
        top = max(ids, key=lambda i: -1 if i is None else i)
        digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
        rest = list(ids)
        rest.remove(top)
        out += [(top, len(html), digest, "response", None)] + [(i, len(html), digest, "revisit", top) for i in rest]
    return sorted(out, key=repr)


@pytest.mark.parametrize("version", [None, 1, 2])
def test_pages_come_back(spark, version):
    reachable(spark)
    frame = spark.createDataFrame([(*r, "x") for r in rows()], "page_id long, url string, html binary, head string").repartition(3)
    legacy = archives.write_arc(frame, per_file=30, version=version)
    read = archives.read_arc(spark, legacy).collect()
    assert {r.version for r in read} == ({1, 2} if version is None else {version})
    assert sorted(((r.page_id, bytes(r.payload)) for r in read), key=repr) == sorted(((i, h or b"") for i, _, h in rows()), key=repr)
    found = archives.digest(archives.read_warc(spark, archives.convert(spark, legacy, per_file=25))).collect()
    assert sorted(map(tuple, found), key=repr) == wanted(rows())


def test_synthesised_fields(spark):
    reachable(spark)
    frame = spark.createDataFrame([(1, "http://a/", "<p>same"), (2, "http://b/", "<p>same")], "page_id long, url string, html string").coalesce(1)
    legacy = archives.write_arc(frame, date="19991231235958", ip="10.0.0.1", version=1)
    once, twice = (archives.read_warc(spark, archives.convert(spark, legacy), bodies=True).where("type <> 'warcinfo'").orderBy("page_id").collect() for _ in range(2))
    assert [r.record_id for r in once] == [r.record_id for r in twice] and once[0].record_id.startswith("urn:uuid:")
    assert [(r.type, r.date, r.url) for r in once] == [("revisit", "1999-12-31T23:59:58Z", "http://a/"), ("response", "1999-12-31T23:59:58Z", "http://b/")]
    assert once[0].refers_to == once[1].record_id and once[0].declared_digest == once[1].payload_digest and bytes(once[1].payload) == b"<p>same"


def test_foreign_arc_records_keep_their_type(spark, tmp_path):
    reachable(spark)
    told = b"1 0 Other\nURL IP-address Archive-date Content-type Archive-length\n"
    lines = [(b"dns:a.org 1.2.3.4 20040102 text/dns", b"a.org. 60 IN A 1.2.3.4\n"), (b"http://a.org/x y 1.2.3.4 20040102030405 text/html", b"HTTP/1.0 404 No\n\nnot here"), (b"http://a.org/none - 20040102030405 text/plain", b"")]
    content = b"filedesc://other.arc 0.0.0.0 20040102030405 text/plain %d\n%s\n" % (len(told), told) + b"".join(b"%s %d\n%s\n" % (h, len(b), b) for h, b in lines)
    (tmp_path / "a.arc").write_bytes(content)
    found = {r.url: r for r in archives.read_warc(spark, archives.convert(spark, str(tmp_path)), bodies=True).where("type <> 'warcinfo'").collect()}
    assert {u: (r.type, bytes(r.payload)) for u, r in found.items()} == {"dns:a.org": ("resource", lines[0][1]), "http://a.org/x y": ("response", b"not here"), "http://a.org/none": ("resource", b"")}
    assert found["dns:a.org"].date == "2004-01-02T00:00:00Z"
    members = b"".join(gzip.compress(p) for p in (content[:150], content[150:]))
    assert len(list(archives.arc_records(archives._opened(members)))) == 3


def test_broken_files_are_named(spark, tmp_path):
    reachable(spark)
    (tmp_path / "cut.arc").write_bytes(b"filedesc://c 0.0.0.0 2004 text/plain 9\n1 0 abcd\n\nhttp://x 1 2004 text/html 50\nshort")
    with pytest.raises(Exception, match=r"cut\.arc: truncated: 50 bytes declared, 5 found"):
        archives.read_arc(spark, str(tmp_path)).count()
    with pytest.raises(ValueError, match="no version block"):
        list(archives.arc_records(io.BytesIO(b"hello\n")))


def test_empty_table(spark):
    reachable(spark)
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.digest(archives.read_warc(spark, archives.convert(spark, archives.write_arc(frame)))).count() == 0
