"""Small cases for semantics that are easy to get wrong."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import dates as D
from tarnwork.functions import text as T
from tarnwork.functions.aliases import closure
from tarnwork.operators import audit, enrichment, graph, registry, retrieval, snapshots, state
from tarnwork.plans import routing, steps
from tarnwork.sources import files, registries
from tarnwork.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_bm25_floor_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "common apple"), (2, "common apple apple"), (3, "common pear"), (4, "common"), (5, "common plum")], "doc_id long, text string")
    scores = {r.doc_id: r.bm25 for r in retrieval.bm25_scores(docs, "common").collect()}
    assert all(s > 0 for s in scores.values())  # in every document, yet the floor keeps it positive
    once = {r.doc_id: r.bm25 for r in retrieval.bm25_scores(docs, "plum").collect()}
    twice = {r.doc_id: r.bm25 for r in retrieval.bm25_scores(docs, "plum plum").collect()}
    assert math.isclose(twice[5], 2 * once[5])
    assert retrieval.bm25_search(docs, "a of", 5).count() == 0


def test_fusion_modes_differ_outside_the_candidates(spark):
    keyword = spark.createDataFrame([(9, 5.0), (1, 1.0)], "id long, bm25 double")
    near = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, score double")
    assert 9 not in {r.id for r in retrieval.fuse_candidates(near, keyword, (0.5, 0.5), 5).collect()}
    full = retrieval.fuse_full(keyword.select("id", (F.col("bm25") / 5).alias("score")), near, (0.5, 0.5), 5)
    assert 9 in {r.id for r in full.collect()}


def test_mmr_skips_near_copies_and_keeps_the_first_of_ties(spark):
    rows = [(1, 0.9, [1.0, 0.0]), (2, 0.89, [1.0, 0.01]), (3, 0.7, [0.0, 1.0]), (4, 0.7, [0.0, 1.0])]
    found = retrieval.mmr(spark.createDataFrame(rows, "id long, score double, embedding array<double>"), 2).orderBy("rank").collect()
    assert [r.id for r in found] == [1, 3]


@pytest.mark.parametrize(("query", "kind"), [("network science", "name_lookup"), ("what is life", "name_lookup"), ('"deep" why', "exact_match"), ("how do 2 nets differ?", "conceptual"), ("x1 y2", "mixed")])
def test_query_kinds(spark, query, kind):
    assert one(spark, retrieval.query_kind(F.lit(query))) == kind


def test_expander_replaces_substrings():
    assert T.expand_acronyms("ai paint") == ["ai paint", "artificial intelligence partificial intelligencent"]


def test_unknown_years_and_globs(spark):
    assert one(spark, T.year_of_filename(F.lit("notes.txt"))) is None
    assert one(spark, T.year_of_filename(F.lit("plan FY24"))) == 2024 and one(spark, T.year_of_filename(F.lit("FY75"))) == 1975
    assert one(spark, T.glob_matches(F.lit("A_report.pdf"), "*report*.pdf")) and not one(spark, T.glob_matches(F.lit("reportxpdf"), "report.pdf"))
    assert one(spark, T.infer_doc_type(F.lit("agenda.docx"))) == "other" and one(spark, T.detect_doc_type(F.lit("agenda.docx"))) == "meeting"


def test_topic_rules(spark):
    rows = spark.createDataFrame([(1, ["Complex Systems and Networks"]), (2, ["Natural Language Processing"]), (3, ["Rock Music"]), (4, None)], "ord long, topics array<string>")
    assert [r.ord for r in registry.match_topics(rows, "topics", "nlp", "ord").collect()] == [2]
    assert one(spark, registry.term_matches(F.lit("deep sea learning"), "deep learning theory"))  # two of three words
    assert not one(spark, registry.term_matches(F.lit("deep sea"), "deep learning theory"))
    assert "network science" in closure("network") and "graph theory" in closure("network")


def test_publication_rules(spark):
    rows = [("Ann Lee", "On Gears", "V", ["mech"], ["Bo Ray"], "d1", 2020, 5, 0), ("Bo Ray", "On Gears", "V", ["mech"], ["Ann Lee"], "d1", 2020, 5, 1), ("Cy", "Nuts", None, [], [], "", 2021, None, 2), ("Cy", "Nuts", None, [], [], None, 2021, None, 3)]
    pubs = spark.createDataFrame(rows, "owner string, title string, venue string, topics array<string>, authors array<string>, doi string, year int, citation_count int, ord long")
    found = registry.publication_search(pubs, "gears").collect()
    assert len(found) == 1 and found[0].ord == 0 and found[0].match_reason == "Title match"
    assert registry.publication_search(pubs, "of a").count() == 3  # no long word: every owner matches; DOI-less rows all stay
    assert registry.publication_search(pubs, "ray").first().match_reason == "Co-author: Bo Ray"


def test_diff_of_owners_only(spark):
    schema = "name string, mtime string, size_bytes long, owner string, ord int"
    old = spark.createDataFrame([("a", "1", 10, "x", 0), ("b", "1", 10, "x", 1), ("b", "1", 9, "y", 2)], schema)
    new = spark.createDataFrame([("a", "1", 10, "z", 0), ("b", "1", 4, "y", 1)], schema)
    changes = snapshots.diff(old, new)
    assert {(r.name, r.change, r.delta) for r in changes.collect()} == {("a", "owner_changed", None), ("b", "shrunk", 5)}
    assert not snapshots.diff_summary(changes.where("name = 'a'")).first().has_changes


def test_terminal_nodes(spark):
    rows = [("o", "output", "2024-01-02"), ("o", "input", "2024-01-02"), ("p", "output", "2024-01-01"), ("p", "input", "2024-01-03"), ("q", "output", None)]
    members = spark.createDataFrame(rows, "node_id string, role string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.node_id for r in graph.terminal_nodes(members).collect()] == ["o"]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("on 2024-03-15 it", [("2024-03-15", "unknown")]), ("02/30/2024", []), ("due 3/15/24", [("2024-03-15", "deadline")]), ("March 20-25, 2024 conference", [("2024-03-20", "event")]), ("15 March 2024", [("2024-03-15", "unknown")]),
        ("since 2024-05", [("2024-05", "unknown")]), ("Q2 2024", [("2024-04", "unknown")]), ("FY24", [("2024", "unknown")]), ("FY2025", [("2025", "unknown")]), ("Fall 2023", [("2023-09", "unknown")]), ("2020-2022", [("2020", "project")]), ("in 1999", []),
    ],
)
def test_dates(text, found):
    assert [(d["normalized"], d["context"]) for d in D.find(text)] == found


def test_primary_date(spark):
    rows = spark.createDataFrame([(1, "since 2020; " + "x" * 60 + " the deadline is Q1 2024"), (2, "nothing"), (3, None)], "id long, text string")
    found = {r.id: r.d for r in D.extract(rows).select("id", D.primary(F.col("dates")).alias("d")).collect()}
    assert found[1].normalized == "2024-01" and found[2] is None and found[3] is None


def test_key_terms_case(spark):
    assert one(spark, enrichment.key_tokens(F.lit("The NSF funded well-known Title work"))) == ["nsf", "funded", "well-known", "work"]
    rows = spark.createDataFrame([(1, "graph graph zebra")], "id long, text string")
    found = {r.term: r.score for r in enrichment.key_terms(rows, "id").collect()}
    assert math.isclose(found["graph"], round(2 / 3 * 2.0 * 1.3, 6)) and math.isclose(found["zebra"], round(1 / 3 * 2.0, 6))


def test_top_topic_confidence(spark):
    rows = spark.createDataFrame([(1, "one gear and a bolt in the gear box")], "id long, text string")
    found = enrichment.classify_topics(rows, "id", {"a": {"keywords": {"gear": 2.0}}, "b": {"keywords": {"bolt": 1.0}}}).orderBy("rank").collect()
    assert (found[0].topic, found[0].confidence) == ("a", 0.953) and found[1].topic == "b"


def test_chunks():
    text = "One sentence here. " * 60
    found = enrichment.chunk_text(text, 200, 40, 50)
    assert all(len(c) <= 200 + 40 + 20 for c, _, _ in found) and found[-1][2] == len(text)
    assert enrichment.chunk_text("short") == [("short", 0, 5)] and enrichment.chunk_text("") == []
    tail = enrichment.chunk_text("A" * 190 + ". " + "B" * 190 + ". tiny.", 200, 0, 50)
    assert len(tail) == 2 and tail[-1][0].endswith("tiny.")


def test_grants_and_names(spark):
    text = F.lit("NSF 2033345, R01-GM123456 and FA9550-12-1-0123; CAREER")
    assert one(spark, enrichment.grant_ids(text)) == ["AFOSR-FA9550-12-1-0123", "NIH-R01-GM-123456", "NSF-2033345"]
    assert one(spark, enrichment.clean_name(F.lit("Dr.  Ann   Lee"))) == "Ann Lee"
    assert one(spark, enrichment.drop_contained(F.array(F.lit("Ann"), F.lit("Ann Lee"), F.lit("Bo")))) == ["Ann Lee", "Bo"]


def test_captions_and_transcripts(spark):
    body = "WEBVTT\n\n1\n00:00:01.000 --> 00:01:40.000\n<v Ann>Hello there</v>\n\n2\n00:01:40.000 --> 00:03:05.000\nBo: and you\n\n3\n03:05.000 --> 03:20.000\nplain\n"
    rows = files.captions(spark.createDataFrame([(1, body)], "id long, text string"), "id")
    assert [(r.speaker, r.text) for r in rows.orderBy("start_s").collect()] == [("Ann", "Hello there"), ("Bo", "and you"), (None, "plain")]
    found = enrichment.transcript_chunks(rows, "id").orderBy("chunk_index").collect()
    assert [r.speakers for r in found] == ["Ann, Bo", ""] and found[0].chunk == "Ann: Hello there\n\nBo: and you"
    said = files.utterances(spark.createDataFrame([(1, "Ann: first\nsecond line\nBo: third")], "id long, text string"), "id")
    assert [(r.speaker, r.said) for r in said.orderBy("pos").collect()] == [("Ann", "first"), ("Bo", "third")]
    assert one(spark, D.vtt_seconds(F.lit("01:02:03.500"))) == 3723.5 and one(spark, D.clock(F.lit(3723.5))) == "01:02:03" and one(spark, D.clock(F.lit(65.0))) == "01:05"


def test_latency_of_one_and_many(spark):
    rows = spark.createDataFrame([("a", 7.0), *[("b", float(i)) for i in range(5)]], "c string, ms double")
    found = {r.c: r for r in state.latency_stats(rows, "c", "ms").collect()}
    assert found["a"].stddev_ms == 0.0 and found["a"].p99 == 7.0 and math.isclose(found["b"].p95, 3.8)


def test_common_failures_cut_before_the_minimum(spark):
    rows = [(f"q{i}", 0) for i in range(25)] + [("q24", 0), ("Q24 ", 0), ("fine", 3)]
    found = state.common_failures(spark.createDataFrame(rows, "query string, num_results int"), 2, 20).collect()
    assert [(r["query"], r.n) for r in found] == [("q24", 3)]


def test_conversation_fold():
    messages = [("user" if i % 2 == 0 else "assistant", f"message {i}. rest of a text that is long enough to be told") for i in range(15)]
    summary, done, kept = state.fold_messages(messages)
    assert (done, kept) == (5, 10) and summary.startswith("User asked: message 0 | Discussed: message 1")
    assert state.fold_messages(messages[:14]) == ("", 0, 14)


def test_audit_medians_on_the_low_side(spark):
    rows = [(i, float(i), float(i), "Director" if i % 2 else "Director; PhD Student", float(i) if i else None) for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text_surprise_score double, representation_contrast_proxy double, lab_author_roles string, citation_count double")
    found = audit.quadrants(frame)
    assert {r.doc_id: r.reward_quadrant for r in found.collect()} == {0: "Routine", 1: "Routine", 2: "Aligned Surprise", 3: "Aligned Surprise"}
    summary = {r.reward_quadrant: r for r in audit.summarize(found, "reward_quadrant").collect()}
    assert (summary["Routine"].n, summary["Routine"].n_with_citations) == (2, 1) and audit.hidden_ratio(audit.summarize(found, "reward_quadrant")).first().ratio is None


def test_routes(spark):
    rows = spark.createDataFrame([("who is ann lee",), ("papers about networks",), ("gears",)], "query string")
    assert {r["query"]: r.decision for r in routing.route(rows).collect()} == {"who is ann lee": "registry_only", "papers about networks": "rag_only", "gears": "hybrid"}


def test_plan_steps(spark):
    order = steps.in_order([steps.Step("c", "x", "q", "b"), steps.Step("b", "x", "q", "a"), steps.Step("a", "x", "q")])
    assert [s.id for s in order] == ["a", "b", "c"]
    actions = {"registry": lambda q, _: spark.range(0), "search": lambda q, parent: spark.range(8), "broken": lambda q, _: 1 / 0}
    run = steps.execute([steps.Step("s1", "registry", "q")], actions, ["broken", "search", "search"])
    # An empty lookup (0.2) is no success; the broken fallback is no retry; the search (8 rows) reaches the gate.
    assert run.fallbacks == 1 and run.quality == 0.8 and [o.success for o in run.outcomes] == [False, True]
    plan = steps.make_plan("papers on gears and bolts")
    run = steps.execute(plan, {"registry": lambda q, _: spark.range(2), "search": lambda q, parent: parent.limit(1)})
    assert [o.step for o in run.outcomes] == ["s1", "s2", "s3"] and run.outcomes[2].rows.count() == 3 and run.success
    skipped = steps.execute([steps.Step("a", "broken", "q"), steps.Step("b", "search", "q", "a")], actions)
    assert [o.step for o in skipped.outcomes] == ["a"] and skipped.quality == 0.0 and not skipped.success


def test_registries(spark, tmp_path):
    lab, hpc, net = tmp_path / "lab.json", tmp_path / "hpc.json", tmp_path / "net.json"
    lab.write_text(json.dumps({"people": {"members": [{"id": "p1", "name": "Ann Lee", "unknown": 1, "openalex": {"topics": ["x"], "recent_publications": [{"title": "t", "year": 2020, "doi": "d"}]}}, {"id": "p2", "name": "Bo"}]}, "projects": [{"id": "j", "name": "J"}]}))
    hpc.write_text(json.dumps({"data_snapshots": {"items": [{"id": "s1", "name": "one"}]}, "embeddings": [{"id": "e1"}, {"id": "e2"}]}))
    net.write_text(json.dumps({"nodes": [{"id": "n", "type": "Person", "name": "N", "attributes": {"a": "b"}}], "edges": [{"id": "e", "edge_type": "Usage", "agents": ["n"], "inputs": [], "outputs": [], "context": [], "timestamp": "2024-01-01T00:00:00"}, {"id": "f", "agents": ["n"], "timestamp": "soon"}]}))
    assert [r.name for r in registries.people(spark, str(lab)).orderBy("ord").collect()] == ["Ann Lee", "Bo"]
    assert registries.publications(spark, str(lab)).first().owner == "Ann Lee" and registries.entities(spark, str(lab), "projects").count() == 1
    assert {(r._category, r.id) for r in registries.resources(spark, str(hpc)).collect()} == {("data_snapshots", "s1"), ("embeddings", "e1"), ("embeddings", "e2")}
    nodes, edges = registries.graph(spark, str(net))
    assert nodes.count() == 1 and {r.id: r.ts is None for r in edges.collect()} == {"e": False, "f": True}
    registries.save_graph(nodes, edges, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph" / "edges")).count() == 2
    assert registries.people(spark, str(tmp_path / "missing.json")).count() == 0


def test_files(spark, tmp_path):
    folder = tmp_path / "texts"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("first")
    (folder / "sub" / "b.md").write_text("second")
    (folder / "c.bin").write_text("third")
    assert {r.text for r in files.documents(spark, str(folder)).collect()} == {"first", "second"} and files.listing(spark, str(folder)).count() == 3
    log = tmp_path / "log.jsonl"
    log.write_text('{"timestamp": "t", "query": "q", "num_results": 0}\nnot json\n')
    assert files.query_log(spark, str(log)).count() == 1
    chat = tmp_path / "chat" / "general"
    chat.mkdir(parents=True)
    (chat / "2024-01-01.json").write_text(json.dumps([{"text": "a message of some length", "user": "u1", "ts": "1"}, {"text": "someone joined the channel", "subtype": "channel_join"}, {"text": "short", "user": "u1"}]))
    users = spark.createDataFrame([("u1", "Ann")], "id string, name string")
    assert [(r.channel, r.user_name) for r in files.chat_messages(spark, str(tmp_path / "chat"), users).collect()] == [("general", "Ann")]
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"name": "x", "num_elements": 2}, {"name": "y", "num_elements": 1}]}))
    (tmp_path / "t.txt").write_text("one\n\ntwo\n\nthree")
    assert [r.source_file for r in files.parsed_elements(spark, str(tmp_path / "m.json"), str(tmp_path / "t.txt")).orderBy("element").collect()] == ["x", "x", "y"]
    entry = tmp_path / "catalog.txt"
    entry.write_text("Name: a\nPath: /p1\nnote: valuable\n" + "-" * 75 + "\nName: a\nPath: /p2\nin use\n")
    found = files.catalog_entries(spark, str(entry)).collect()
    assert [(r.name, r.path, r.is_active) for r in found] == [("a", "/p2", True)]


def test_snapshot_files_and_daily_diff(spark, tmp_path):
    for day, size in (("2024-01-01", 5), ("2024-01-02", 8)):
        (tmp_path / f"snap_{day}.json").write_text(json.dumps({"scan_timestamp": day, "resources": [{"name": "a", "size_bytes": size, "mtime": day, "owner_username": "x"}]}))
    panel = files.snapshot(spark, str(tmp_path / "snap_*.json")).withColumnRenamed("owner_username", "owner").select("snapshot_date", "name", "mtime", "size_bytes", "owner")
    log = str(tmp_path / "log")
    jobs.daily_diff(spark, panel, log)(panel.where("snapshot_date = '2024-01-02'"), 0)
    assert {(r.change, r.delta) for r in spark.read.parquet(log).collect()} == {("modified", None), ("grown", 3)}


def test_incremental_index(spark, tmp_path):
    index = jobs.IncrementalIndex(spark, str(tmp_path / "index"), lambda rows: enrichment.chunks(rows, "path"))
    frame = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    index.apply(frame(("a", "text a"), ("b", "text b")))
    index.apply(frame(("a", "text a"), ("b", "new b"), ("c", "text c")))
    assert {(r.path, r.chunk) for r in index.chunks().collect()} == {("a", "text a"), ("b", "new b"), ("c", "text c")}
    index.remove(spark.createDataFrame([("a",)], "path string"))
    assert {r.path for r in index.files().collect()} == {"b", "c"}


def test_text_accumulator():
    now = [0.0]
    held = jobs.TextAccumulator(0.5, 10, lambda: now[0])
    assert held.add("0123456789abc") is None
    now[0] = 0.6
    assert held.add("d") == "0123456789abcd" and held.add("x") is None


def test_correct_and_ngrams(spark):
    assert one(spark, T.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2)) == ["a b", "b c"] and one(spark, T.ngrams(F.array(F.lit("a")), 2)) == []
    assert one(spark, T.similarity_ratio(F.lit(""), F.lit(""))) == 1.0 and one(spark, T.sanitize(F.lit(float("inf")))) is None
    assert one(spark, T.citation(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(""))) == "Unknown"
    assert len(one(spark, T.make_id("doc", F.lit("x" * 100)))) == 59


def test_chunk_filter(spark):
    rows = spark.createDataFrame([(1, "report", 2020, "a.txt"), (2, None, None, "weekly_2021.txt"), (3, "", None, "report.txt"), (4, "Report", 2021, "b_report.pdf")], "id long, doc_type string, date_year int, source_file string")
    ids = lambda **kw: [r.id for r in rows.where(T.chunk_filter(**kw)).orderBy("id").collect()]
    assert ids() == [1, 2, 3, 4] and ids(doc_type="report") == [1, 3, 4] and ids(year=2021) == [2, 3, 4] and ids(file_pattern="*report*") == [3, 4] and ids(doc_type="meeting", year=2021) == [2]


def test_similarity_synonyms_and_keyed_enrichment(spark):
    import difflib

    assert T.expand_synonyms("find ai work", {"find": ("get", "seek", "spot")}) == ["find ai work", "find artificial intelligence work", "get ai work", "seek ai work"]
    assert one(spark, T.sequence_ratio(F.lit("Ann Lee"), F.lit("An Leigh"))) == difflib.SequenceMatcher(None, "Ann Lee", "An Leigh").ratio()
    table = {"reddit|tweets": ("social", ("posts",), ("b", "a")), "archive": ("store", (), ("a",))}
    found = one(spark, T.keyed_enrichment(F.lit("Reddit archive"), F.lit(None).cast("string"), table))
    assert (found.category, found.aliases, found.keywords) == ("social", ["posts"], ["a", "b"])
    assert one(spark, T.keyed_enrichment(F.lit("x"), F.lit("y"), table)).category is None
    assert one(spark, D.month_of_filename(F.lit("notes_March_2021.txt"))) == 3 and one(spark, D.month_of_filename(F.lit("2021-11-notes"))) == 11


def test_voices(spark, tmp_path):
    from tarnwork.operators import voices

    (tmp_path / "v.json").write_text(json.dumps({"compound_types": {"a_one": {"name": "One", "tensions": ["b_two"]}, "b_two": {"name": "Two", "tensions": ["a_one"]}, "c": {"name": "C", "tensions": []}}, "individuals": {"x": {"name": "X"}}}))
    types, people = voices.load(spark, str(tmp_path / "v.json"))
    assert types.count() == 3 and people.first().name == "X"
    for seed in range(4):
        chosen = voices.choose(types, 2, seed)
        assert chosen == voices.choose(types, 2, seed) and len(set(chosen)) == 2
        if chosen[0] != "c":
            assert set(chosen) == {"a_one", "b_two"}


def test_index_round_trip(spark, tmp_path):
    from tarnwork.operators import index

    rows = spark.createDataFrame([("a", "t", "red gear", 1), ("a", "t", "other", 2), ("b", "u", "blue bolt", 1)], "id string, doc_type string, text string, ord int")
    made = index.build(rows)
    index.save(made, str(tmp_path / "i"))
    held = index.load(spark, str(tmp_path / "i"))
    assert {r.id: r.text for r in held.collect()} == {"a": "red gear", "b": "blue bolt"}
    assert index.search(held, "gear red", 1).first().id == "a" and [r.id for r in index.similar(held, "a", 5).collect()] == ["b"]
    assert index.search(held, "gear red", 5, doc_types=["u"]).count() == 1


def test_questions_end_words_as_their_sql(spark):
    import duckdb
    import pandas as pd

    texts = ["Doó ciónado", "do", "Do_it", "does\u0301", "\u0130s it", "\u00a0who", "\u3000why not", "\twhy", "can't", "candle", "is1", "x?", None, "", "hówhow"]
    conversations = pd.DataFrame({"conv_id": range(len(texts)), "turn": 0, "text": texts})
    from tarnwork import catalog

    want = duckdb.sql(catalog.oracle_sql()["questions"]).fetchall()
    rows = spark.createDataFrame(list(conversations.itertuples(index=False, name=None)), "conv_id long, turn int, text string")
    assert {r.conv_id for r in enrichment.questions(rows).collect()} == {r[0] for r in want}
    assert {0, 4, 5, 6} <= {r[0] for r in want}


def test_rows_of_texts_come_in_small_batches():
    import pyarrow as pa

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    run = enrichment._rows_of_texts(Rows(), "id long, i int", lambda key, n: ((key, i) for i in range(n)))
    sizes = [0, 1, 30_000, 5, *[100] * 300]
    out = list(run(iter([pa.RecordBatch.from_pydict({"id": list(range(len(sizes))), "n": sizes})])))
    assert max(b.num_rows for b in out) <= enrichment._GIVEN < sum(sizes)
    assert [(r["id"], r["i"]) for b in out for r in b.to_pylist()] == [(k, i) for k, n in enumerate(sizes) for i in range(n)]
