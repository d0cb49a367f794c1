"""Stored postings, reloads, snapshot ingestion, panels by date and exact quantiles."""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import retrieval, snapshots
from tarnwork.operators.enrichment import chunks
from tarnwork.operators.postings import Postings
from tarnwork.operators.quantiles import quantiles
from tarnwork.sources.published import Published, Watched, differences, manifest
from tarnwork.streaming import files
from tarnwork.streaming.ingest import SnapshotIngest


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(40)] + ["the"] * 30 + ["rare"]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))) + ("." if i % 3 else " the the")) for i in range(n)] + [(n, None), (n + 1, ""), (None, "the")]


def brute(rows, query, k):
    docs = {i: retrieval.query_tokens(t or "") for i, t in rows if i is not None}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for t in docs.values() for w in set(t))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    out = {}
    for i, t in docs.items():
        tf = Counter(t)
        out[i] = sum(m * (idf[w] if idf[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w, m in Counter(retrieval.query_tokens(query)).items() if w in idf)
    best = sorted(((-round(s, 9), i) for i, s in out.items() if s > 0))[:k]
    return [(i, round(s / best[0][0], 6)) for s, i in best]


def test_postings_equal_a_scan_after_changes(spark, tmp_path):
    rows = texts(150)
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    index = Postings(spark, str(tmp_path / "p"), buckets=4, block=20)
    assert index.search("the", 3).count() == 0 and index.scores("the").count() == 0
    index.add(frame(rows))
    found = lambda q, k, i=index: [(r.doc_id, r.score) for r in i.search(q, k, first=2).orderBy(F.desc("score"), "doc_id").collect()]
    for query in ("word3 word7 word7", "the rare word1", "nothing here"):
        want = brute(rows, query, 10) if query != "nothing here" else []
        assert found(query, 10) == want
    changed = [(i, "rare word3 rare") for i in range(0, 60, 7)]
    index.add(frame(changed))
    index.remove(frame([(i, None) for i in range(1, 150, 5)] + [(9999, None)]))
    now = {i: t for i, t in rows if i is not None} | dict(changed)
    now = [(i, t) for i, t in now.items() if not (i % 5 == 1 and i < 150)]
    assert found("the", 12) == brute(now, "the", 12)
    again = Postings(spark, str(tmp_path / "p"), buckets=4, block=20)  # another session's reader
    again.compact()
    assert len(again.versions()) == 1 and found("rare word3", 12, again) == brute(now, "rare word3", 12)


def test_postings_read_few_buckets_and_no_texts(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "p"), buckets=16, block=20)
    index.add(spark.createDataFrame(texts(200), "doc_id long, text string"))
    weights, mean = index.weights("word3 rare")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not tell
    plan = index.bounds(weights, mean)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 2 out of 16" in plan or "SelectedBucketsCount: 1 out of 16" in plan
    assert "docs#" not in plan.split("ReadSchema")[-1].split("\n")[0] and "text" not in plan
    unfinished = tmp_path / "p" / "v9"
    spark.range(1).write.parquet(str(unfinished / "documents"))  # a version without its mark is none
    assert index.versions() == [1]


def test_manifests_and_reload(spark, tmp_path):
    source, clock = str(tmp_path / "src"), [0.0]
    watched = Watched(spark, source, lambda s, p: s.read.schema("id long").json(p), str(tmp_path / "pub"), interval=5, clock=lambda: clock[0])
    assert watched.reload_if_changed() is None  # nothing there
    spark.range(10).write.json(source)
    clock[0] = 1
    assert watched.reload_if_changed() is None  # too soon
    clock[0] = 7
    assert watched.reload_if_changed() == {"status": "reloaded", "previous": 0, "current": 10}
    reader = watched.table()
    before = manifest(spark, source).collect()
    spark.range(3).write.mode("overwrite").json(source)
    assert {r.change for r in differences(spark.createDataFrame(before, manifest(spark, source).schema), manifest(spark, source)).collect()} == {"added", "removed"}
    clock[0] = 20
    assert watched.reload_if_changed() == {"status": "reloaded", "previous": 10, "current": 3}
    assert reader.count() == 10 and watched.table().count() == 3
    assert len(watched.store.sweep(1)) == 1 and watched.table().count() == 3


def test_a_failed_load_leaves_the_pointer(spark, tmp_path):
    store = Published(spark, str(tmp_path / "t"))
    with pytest.raises(LookupError):
        store.table("rows")
    store.publish(rows=spark.range(4))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        store.publish(rows=spark.range(4).select((F.lit(1) / (F.col("id") - F.col("id"))).alias("id")))
    assert store.table("rows").count() == 4 and len(store.versions()) == 2
    files.write_text(spark, str(tmp_path / "x"), "é")
    files.write_text(spark, str(tmp_path / "x"), "ü")
    assert files.read_text(spark, str(tmp_path / "x")) == "ü" and files.read_text(spark, str(tmp_path / "y")) is None


def scan(folder, day, rows, text=None, name=None):
    doc = {"scan_timestamp": day, "resources": [{"name": n, "mtime": m, "size_bytes": s, "owner_username": o} for n, m, s, o in rows]}
    (folder / (name or f"snapshot_{day}.json")).write_text(text if text is not None else json.dumps(doc))


def test_ingestion_replays_and_sets_aside(spark, tmp_path):
    source = tmp_path / "scans"
    source.mkdir()
    catalog = spark.createDataFrame([("a", True, False)], "name string, is_valuable boolean, is_active boolean")
    job = SnapshotIngest(spark, str(source), str(tmp_path / "job"), lambda rows: chunks(rows, "path"), catalog)
    scan(source, "2024-01-01", [("a", "t1", 1, "x"), ("b", "t1", 5, "y"), ("b", "t1", 6, "y"), (None, "t", 1, "z")])
    scan(source, "2024-01-03", [("a", "t2", 3, "x"), ("c", "t1", 5, "y")])
    scan(source, "2024-01-04", [], '{"resources": [')
    scan(source, "", [], '{"resources": []}', "undated.json")
    job.run()
    log = lambda: sorted((r.date, r.name, r.change, r.delta) for r in job.changes().collect())
    first = [("2024-01-03", "a", "grown", 2), ("2024-01-03", "a", "modified", None), ("2024-01-03", "b", "removed", None), ("2024-01-03", "c", "added", None)]
    assert log() == first
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in job.errors().collect()) == [("snapshot_2024-01-04.json", "no scan document"), ("undated.json", "no date in the path")]
    assert {(r.name, r.is_valuable) for r in job.panel().where("snapshot_date = '2024-01-03'").collect()} == {("a", True), ("c", None)}
    # The same batch once more, marked and (as after a crash before its mark) unmarked.
    batch = spark.read.text(str(source)).select(F.col("_metadata.file_path").alias("path"), "value")
    job.apply(batch, 0)
    files.remove(spark, str(tmp_path / "job" / "batches" / "0"))
    version = job.index.version
    job.apply(batch, 0)
    assert log() == first and job.errors().count() == 2 and job.panel().count() == 4 and job.batches() == [0]
    assert job.index.files().count() == job.status().first().inventories and job.index.version >= version
    # A date in between changes what the next one is compared with.
    scan(source, "2024-01-02", [("a", "t2", 3, "x"), ("c", "t1", 5, "y")])
    job.run()
    assert {d for d, *_ in log()} == {"2024-01-02"} and job.status().first().snapshots == 3
    job.reindex()
    assert job.index.files().count() == job.status().first().inventories > 0


def test_a_date_reads_and_writes_one_partition(spark, tmp_path):
    path = str(tmp_path / "panel")
    rows = spark.range(90).select(F.concat(F.lit("2024-01-0"), (F.col("id") % 3 + 1).cast("string")).alias("snapshot_date"), F.col("id").cast("string").alias("name"))
    snapshots.save_panel(rows, path)
    one = snapshots.load_range(snapshots.load_panel(spark, path), "2024-01-02", "2024-01-02")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan and one.count() == 30
    assert len({r[0] for r in one.select(F.input_file_name()).distinct().collect()}) <= 4 and all("snapshot_date=2024-01-02" in r[0] for r in one.select(F.input_file_name()).distinct().collect())
    others = {r[0] for r in snapshots.load_panel(spark, path).where("snapshot_date <> '2024-01-02'").select(F.input_file_name()).distinct().collect()}
    snapshots.save_panel(rows.where("snapshot_date = '2024-01-02'").limit(2), path)
    after = snapshots.load_panel(spark, path)
    assert after.where("snapshot_date = '2024-01-02'").count() == 2
    assert {r[0] for r in after.where("snapshot_date <> '2024-01-02'").select(F.input_file_name()).distinct().collect()} == others


@pytest.mark.parametrize(("width", "settle"), [(4096, 20_000), (4, 5), (64, 1)])
def test_quantiles_equal_sorting(spark, width, settle):
    rng = random.Random(1)
    rows = [(g, rng.choice([rng.gauss(0, 1), 5.0, -1e300, 1e300, rng.random() * 1e-300, float(rng.randint(0, 9))])) for g, n in (("a", 1500), ("b", 57), (None, 20)) for _ in range(n)]
    rows += [("c", float("inf")), ("c", float("-inf")), ("c", 1.0), ("b", None), ("nulls", None), ("one", 3.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    wanted = {"q0": 0.0, "q1": 0.31, "q5": 0.5, "q9": 0.95, "qq": 1.0}
    got = {r.g: [r[n] for n in wanted] for r in quantiles(frame, "v", wanted, "g", width=width, settle=settle).collect()}
    want = {r.g: [r[n] for n in wanted] for r in frame.groupBy("g").agg(*[F.percentile("v", q).alias(n) for n, q in wanted.items()]).collect()}
    for g in want:
        for x, y in zip(got.pop(g), want[g], strict=True):
            assert (x is None and y is None) or x == y or abs(x - y) <= 1e-12 * abs(y), (g, x, y)
    assert not got
    assert quantiles(frame.where("false"), "v", {"m": 0.5}).first().m is None and quantiles(frame.where("false"), "v", {"m": 0.5}, "g").count() == 0


def test_quantiles_of_many_distinct_values(spark):
    """10^7 distinct values of three groups: what a task holds is bounded by the ranges and by the few rows that settle."""
    rows = spark.range(0, 10_000_000, 1, 4).select(F.when(F.col("id") % 100 < 98, "hot").otherwise("cold").alias("g"), F.pow(F.col("id").cast("double"), 1.5).alias("v"))
    got = {r.g: r.m for r in quantiles(rows, "v", {"m": 0.5}, "g", width=1024, settle=5000).collect()}
    hot = [i for i in range(4_999_900, 5_000_100) if i % 100 < 98]
    assert abs(got["hot"] - (hot[97] ** 1.5 + hot[98] ** 1.5) / 2) < 1e-3
    cold = [i for i in range(4_999_800, 5_000_200) if i % 100 >= 98]
    assert abs(got["cold"] - (cold[3] ** 1.5 + cold[4] ** 1.5) / 2) < 1e-3


def test_overlapping_chunks_of_whole_documents(spark, data):
    from tarnwork.operators.chunk_tables import overlapping, overlapping_pieces
    from tarnwork.session import reachable

    reachable(spark)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "text")
    want = sorted((r.doc_id, i, *p) for r in docs.collect() for i, p in enumerate(overlapping_pieces(r.text)))
    found = overlapping(docs)
    assert found.columns == ["doc_id", "lang", "text", "chunk_index", "chunk", "char_start", "char_end"]
    assert sorted((r.doc_id, r.chunk_index, r.chunk, r.char_start, r.char_end) for r in found.collect()) == want
    # By hand: the second chunk begins with the tail of the first, places count a gap as one.
    one, two, three = "A" * 39 + ".", "B" * 39 + "!", "C" * 9 + "?"
    assert overlapping_pieces(f"{one}  {two} {three}", 60, 10, 20) == [(one, 0, 41), (f"{one[-10:]} {two}", 31, 82), (f"{two[-10:]} {three}", 72, 93)]
    assert overlapping_pieces(None) == overlapping_pieces("") == [] and overlapping_pieces("short") == [("short", 0, 5)]
    assert overlapping_pieces(f"{one} {three}", 45, 0, 20) == [(f"{one} {three}", 0, 51)]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x. y")], "id long, text string")
    assert [(r.id, r.chunk) for r in overlapping(odd).where("chunk is not null").collect()] == [(3, "x. y")]


def test_buckets_follow_the_corpus(spark, tmp_path, monkeypatch):
    """More words make more buckets, also for a reader that comes later; of equal ids in a batch the smallest text counts."""
    from tarnwork.operators import postings

    monkeypatch.setattr(postings, "_BUCKET", 50)
    docs = spark.range(200).selectExpr("id % 190 as doc_id", "concat(if(id >= 190, 'zeta', 'alpha'), ' word', id % 7, ' word', id % 90) as text")
    index = postings.Postings(spark, str(tmp_path / "p"), buckets=4, block=20)
    index.add(docs)
    assert index._wide(1) == -(-190 * 3 // 50)
    for name in [t.name for t in spark.catalog.listTables() if t.name == index._name(1)]:
        spark.sql(f"DROP TABLE {name}")
    again = postings.Postings(spark, str(tmp_path / "p"), buckets=4, block=20)
    found = {r.term: r.n for r in again.postings().groupBy("term").sum("n").toDF("term", "n").collect()}
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {again._name(1)}").collect()}
    assert told["Num Buckets"] == str(index._wide(1))
    assert found["alpha"] == 190 and "zeta" not in found and sum(found.values()) == 190 * 3 - sum(i % 7 == i % 90 for i in range(190))
