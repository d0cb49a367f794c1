"""The pipeline against brute force, stage by stage: each on what the one before kept."""

from __future__ import annotations

import collections
import math
import re
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tarnwork.llm import language_id, packing, pii
from tarnwork.llm.queries import PII_KEY

from .test_near_rows import brute as near_groups
from .test_substring_names import brute as without_repeats


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    passage = " ".join(f"passage{i}" for i in range(70))
    letters = "это русский текст без всякого сходства с прочими " * 4
    more = [(9001, f"The {passage} ends here.", "en"), (9002, f"Another text {OWN} with {passage}", "en"), (9003, letters, None), (9004, None, "en"), (9005, "12345 !!", "en"), (9006, "mail bob@example.org or call +44 20 7946 0958", None)]
    rows = [(i, t, lang, "planted", len(t or "")) for i, t, lang in more]
    return base.unionByName(spark.createDataFrame(rows, base.schema))


OWN = " ".join(f"of{i}" for i in range(60))


def letter_runs(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    return [w[i : i + n] for w in words for n in (2, 3) for i in range(len(w) - n + 1)]


def held(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_equal_brute_force(spark, docs):
    from tarnwork.llm._shared import shared_table

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "substring_dedup", "pii", "packing"]
    before = held(docs)

    now = shared_table(stages["language_id"](spark, docs, ""), "t1")
    found = held(now)
    from pyspark.sql import functions as F

    model = language_id.fit(docs, ~language_id.held_out(F.col("doc_id")))
    learned = [r.text for i, r in before.items() if r.lang is not None and r.text is not None and zlib.crc32(str(i).encode()) % 5]
    known = {g for t in learned for g in letter_runs(t)}  # fewer ids than the sample's bound: all are learned from

    def strange(text):
        runs = letter_runs(text)
        return bool(runs) and sum(g in known for g in runs) / len(runs) < 0.5 - math.sqrt(math.log(1000) / (2 * len(runs)))

    kept = {i for i, r in before.items() if r.text and any(c.isalpha() for c in r.text) and not strange(r.text)}
    assert set(found) == kept and not {9003, 9004, 9005} & kept and 9006 in kept
    assert found[9006].lang == language_id.predict(docs.where("doc_id = 9006"), model).first().lang_pred
    assert now.columns == docs.columns

    after = shared_table(stages["near_dedup"](spark, now, ""), "t2")
    groups = near_groups([(i, r.text) for i, r in found.items()], 5)
    assert set(held(after)) == {i for i, g in groups.items() if i == g}

    passed = held(after)
    then = shared_table(stages["substring_dedup"](spark, after, ""), "t3")
    order = sorted(passed)
    want = dict(zip(order, without_repeats([passed[i].text for i in order], corpus_pipeline.PASSAGE), strict=True))
    stripped = held(then)
    for i in order:
        words = " ".join(packing.re.findall(r"[^\x20\x09-\x0D]+", passed[i].text))
        assert stripped[i].text == (passed[i].text if words == want[i] else want[i]), i
    assert stripped[9002].text == f"Another text {OWN} with"

    safe = held(shared_table(stages["pii"](spark, then, ""), "t4"))
    assert {i: r.text for i, r in safe.items()} == {i: pii.surrogates(r.text, PII_KEY)[0] for i, r in stripped.items()}
    assert "bob@example.org" not in safe[9006].text and safe[9006].n_chars == len(safe[9006].text)

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = stages["packing"](spark, spark.createDataFrame(list(safe.values()), docs.schema), "").collect()
    lengths = collections.Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in safe.items()}
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    free = []  # best-fit decreasing, piece by piece
    for length in sorted((r.length for r in rows), reverse=True):
        fits = [i for i, room in enumerate(free) if room >= length]
        if fits:
            best = min(fits, key=lambda i: free[i])
            free[best] -= length
        else:
            free.append(2048 - length)
    assert len(bins) == len(free)


CLASHES = ["__null", "x.y", "TEXT2", "rest", "_told", "component_id", "kept", "again", "Lang.2", "alt"]


@pytest.mark.parametrize("name", ["language_id", "near_dedup", "substring_dedup", "pii", "packing"])
def test_stages_bear_any_columns(spark, docs, name):
    from pyspark.sql import functions as F

    stage = dict(corpus_pipeline.STAGES)[name]
    small = docs.where("doc_id < 40 or doc_id > 9000")
    wide = small.select("*", *[F.col("doc_id").alias(c) for c in CLASHES])
    told, plain = stage(spark, wide, ""), stage(spark, small, "")
    if name == "packing":
        assert told.count() == plain.count()
        return
    assert told.columns == wide.columns
    assert sorted(map(tuple, told.select(*docs.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    for c in CLASHES:
        assert told.where(~F.col(f"`{c}`").eqNullSafe(F.col("doc_id"))).count() == 0


@pytest.mark.parametrize("length", [3, 20_000])
def test_no_size_of_text_decides_its_language(spark, length):
    """Texts of one to five letters and of a megabyte stay, whether labelled texts are short or long; other scripts go."""
    import random

    rng = random.Random(5)
    lexicon = {"en": "the house and water with morning people small yes no ok hi I river stone light under over every".split(), "fr": "la maison avec des gens petit oui non bien matin riviere pierre sous chaque".split()}
    rows = [(i, " ".join(rng.choices(lexicon[lang], k=length)), lang) for i, lang in enumerate(["en", "fr"] * (60 if length < 100 else 8))]
    short = ["Hi", "I", "ok", "No.", "Yes", "OK!", "Oui", "a b", "water"]
    large = [" ".join(rng.choices(lexicon[lang], k=180_000)) for lang in lexicon]
    alien = ["это русский текст без всякого сходства " * n for n in (2, 20_000)] + ["这是一个没有任何相似之处的中文文本", "αυτό είναι ένα ελληνικό κείμενο"]
    asked = [(1000 + i, t, None) for i, t in enumerate(short + large)] + [(2000 + i, t, None) for i, t in enumerate(alien)]
    docs = spark.createDataFrame([(*r, "s", len(r[1])) for r in rows + asked], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, "").select("doc_id").collect()}
    assert {1000 + i for i in range(len(short + large))} <= kept
    assert not any(i >= 2000 for i in kept)
