"""Restarts, odd bytes and empty inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.operators import enrichment, voices
from tarnwork.sources import files
from tarnwork.streaming import jobs


def test_an_index_goes_on_after_a_restart(spark, tmp_path):
    chunker = lambda rows: enrichment.chunks(rows, "path")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "path string, text string")
    folder = str(tmp_path / "index")
    first = jobs.IncrementalIndex(spark, folder, chunker)
    assert first.files().count() == 0 and first.version == 0
    first.remove(rows(("a", "")))
    first.apply(rows(("a", "one text. " * 30), ("b", "two texts. " * 30)))
    # A batch that failed before its mark is no version.
    rows(("x", "y")).write.parquet(f"{folder}/v2/chunks")
    again = jobs.IncrementalIndex(spark, folder, chunker)
    assert again.version == 1 and {r.path for r in again.files().collect()} == {"a", "b"}
    again.apply(rows(("b", "changed. " * 30), ("c", "three. " * 30), ("a", "one text. " * 30)))
    again.remove(rows(("a", "")))
    assert {r.path for r in again.chunks().select("path").distinct().collect()} == {"b", "c"}
    assert again.chunks().where("path = 'b'").first().chunk.startswith("changed")
    again.compact()
    kept = jobs.IncrementalIndex(spark, folder, chunker)
    assert jobs.versions(spark, folder, "_done") == [kept.version] and kept.status().first().total_files == 2
    kept.export(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where(F.size("tokens") > 0).count() == kept.chunks().count()
    kept.reindex(rows(("z", "new. " * 30)))
    assert [r.path for r in kept.files().collect()] == ["z"]


def test_files_of_any_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"good \xc3\xa9")
    (tmp_path / "b.txt").write_bytes(b"bad \xff\xfe end")
    (tmp_path / "c.txt").write_bytes(b"")
    found = {r.path.rsplit("/", 1)[1]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert found["a.txt"].text == "good é" and found["a.txt"].is_utf8
    assert found["b.txt"].text.startswith("bad ") and found["b.txt"].text.endswith(" end") and not found["b.txt"].is_utf8
    assert set(found) == {"a.txt", "b.txt"}  # an empty file has no row


def test_many_voices(spark):
    rows = spark.range(3000).select(F.concat(F.lit("v "), F.col("id").cast("string")).alias("id"), F.array(F.lit("v_2999")).alias("tensions"))
    picked = voices.choose(rows, 3, seed=4)
    assert len(picked) == 3 == len(set(picked)) and picked[1] == "v 2999" and picked == voices.choose(rows, 3, seed=4)
    assert voices.choose(rows.where("false"), 3) == []


def test_hints_lose_no_date():
    """Every family with and without its hints: all patterns on texts of parts of dates."""
    import random
    import re

    from tarnwork.functions import dates

    rng = random.Random(3)
    parts = ["March", "mar", "Sept", "4", "12th", "2024", "2019", "-", "/", "–", "Q3", "q", "FY", "fy24", "FY-2023", "Spring", "autumn", "in", "by", " ", " ", "03", "2024-01-05", "1/2/24", "until", ",", "İ", "K"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 9)))
        plain = {(m.start(), m.end()) for f, (p, _) in dates.FAMILIES.items() for m in re.finditer(p, text, re.I) if dates._parts(f, m.groups())}
        told = {(d["char_start"], d["char_end"]) for d in dates.find(text)}
        assert told <= plain and bool(told) == bool(plain), text


def test_similar_entries_equal_numpy(spark):
    import numpy as np

    from tarnwork.operators import index

    entries = spark.createDataFrame([(f"p{i}", "part", f"word{i % 7} gear{i % 5} x{i}") for i in range(60)], "id string, doc_type string, text string")
    built = index.build(entries)
    held = {r.id: np.array(r.embedding, dtype=float) for r in built.collect()}
    cosine = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    want = sorted(((-round(cosine(held["p1"], v), 6), i) for i, v in held.items() if i != "p1"))[:5]
    assert [(r.id, round(r.score, 5)) for r in index.similar(built, "p1", 5).collect()] == [(i, round(-s, 5)) for s, i in want]
