"""Near duplicates, substrings, packing, BPE, language, personal data: against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tarnwork.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tarnwork.llm import bpe, language_id, near_dedup, packing, pii, substring_dedup
from tarnwork.llm._components import connected_components
from tarnwork.llm._words import WORD, ngram_hashes, shingle_set, word_hashes

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 5000}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three"), (6, "one two three"), (6, "one two three"), (7, "🙂 ünï code x"), (8, LONG), (9, LONG + " tail"), (10, "a" * 50_000), (None, "no id here at all")]


def odd(spark, n=None):
    """Odd rows with extra columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1, "y") for i, t in (ODD if n is None else ODD[:n])]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, units int, rest string")


def lower(text):
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def brute_components(docs, words, percent):
    sets = {}
    for i, t in docs:
        w = WORD.findall(lower(t or ""))
        sets[i] = set(zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(400)]
    docs, n = [], 0
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(1, 90))
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((n, " ".join(copy) if rng.random() < 0.9 else " ".join(copy).upper()))
            n += 1
    return docs


@pytest.mark.parametrize(("seed", "chunk"), [(1, 1000), (2, 4), (3, 3)])
def test_near_duplicates_equal_brute_force(spark, seed, chunk):
    docs = near_corpus(seed)
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=4, chunk=chunk, leaders=2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(docs, 4, 80)


def test_near_duplicates_odd_rows(spark):
    found = [tuple(r) for r in near_dedup.near_duplicates(odd(spark)).collect()]
    assert len(found) == len(ODD)
    by = {r[0]: r for r in found}
    assert by[1][1:] == (0, 1, True) and by[2][1:] == (0, 2, True) and by[3][1] == 0
    assert by[5][2:] == (5, True) and by[6][2:] == (5, False) and by[9][2] == 8 and by[None][3]
    assert near_dedup.near_duplicates(odd(spark, 0)).count() == 0


def test_least_matches_bound_the_miss():
    for n, m in near_dedup.least_matches(0.8, 1e-6):
        assert 0 <= m <= 0.8 * n


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7), (200, 200), (None, 3)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {found[i] for i in range(51)} == {0} and {found[i] for i in (100, 101, 102)} == {100} and found[200] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(docs, words):
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - words + 1):
            key = tuple(w[a : a + words])
            if key in seen:
                gone[a : a + words] = [True] * words
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "words", "shard"), [(1, 5, 5000), (2, 20, 5000), (3, 5, 1), (4, 8, 6), (5, 70, 100)])
def test_repeats_equal_brute_force(spark, seed, words, shard):
    rng = random.Random(seed)
    pool = [rng.choices("abcdefghij", k=rng.randint(words, 3 * words)) for _ in range(6)]
    docs = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(pool) if rng.random() < 0.6 else rng.choices(["x", "y", "be", "zz" + str(i)], k=rng.randint(1, 40))
        docs.append((i, " ".join(text)))
    found = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), words, shard, digest=True)
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == brute_repeats(docs, words)


def test_repeats_odd_rows(spark):
    found = substring_dedup.remove_repeats(odd(spark), 20)
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[6]) == 2 and by[1][0].text == "" and by[3][0].n_words == 0 and by[None][0].n_removed == 0
    assert by[8][0].n_removed == 60_000 - 5000 and by[9][0].n_removed >= 60_000 and by[9][0].text.endswith("tail")
    kept = substring_dedup.remove_repeats(odd(spark), 20, keep=True)
    assert kept.columns == ["doc_id", "text", "kept", "units", "rest"] and kept.where("doc_id = 1").first().text is None
    assert kept.count() == len(ODD) and substring_dedup.remove_repeats(odd(spark, 0), 20, keep=True).count() == 0


def test_suffix_automaton_statistics():
    rng = random.Random(5)
    for _ in range(30):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(4, 20))] for _ in range(4)]
        masks = substring_dedup.repeated_windows(texts, 4)
        seen = set()
        for text, mask in zip(texts, masks, strict=True):
            for a in range(len(text) - 3):
                key = tuple(text[a : a + 4])
                assert bool(mask >> a & 1) == (key in seen)
                seen.add(key)


def test_word_hashes_follow_words():
    for text in ("a b  a", "x y z", LONG[:1000], "é ü\x0bé", ""):
        words, hashes = WORD.findall(text), word_hashes(text)
        assert len(words) == len(hashes)
        assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))
    assert shingle_set("A b c d", 4).tolist() == shingle_set("a B c d", 4).tolist() != shingle_set("a b c e", 4).tolist()
    assert len(ngram_hashes(word_hashes("a b c"), 4)) == 0


def brute_best_fit(lengths, size):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in free if r >= n]
        if fits:
            free[free.index(min(fits))] -= n
        else:
            free.append(size - n)
    return sorted(free)


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_plan_equals_single_pieces(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 20, 64])
    lengths = Counter(rng.randint(1, size) for _ in range(rng.randint(0, 150)))
    runs = packing.best_fit_plan(lengths, size)
    bins = {}
    for length, n in lengths.items():
        own = sorted((r for r in runs.tolist() if r[0] == length), key=lambda r: r[1])
        for k in range(n):
            _, first, b, each, offset = [r for r in own if r[1] <= k][-1]
            bins.setdefault(b + (k - first) // each, []).append((offset + (k - first) % each * length, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    assert sorted(size - sum(n for _, n in p) for p in bins.values()) == brute_best_fit(lengths.elements(), size)


def test_pack_odd_rows(spark):
    reference = tokenizers.Tokenizer.from_file(WORDS)
    rows = packing.pack(odd(spark), WORDS, size=512).collect()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    for i, text in {i: t for i, t in ODD}.items():
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i})
        assert pieces == [(k, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes())) for k, a in enumerate(range(0, len(ids), 512))]
    assert packing.pack(odd(spark, 0), WORDS).count() == 0


ALPHABET = [*"aaabbt  \n\t'sréλΣςİ漢🙂١½ſK\x1c\x85 ,.0123<|>endofxt́", "<|endoftext|>", "<|startoftext|>", "'ll", "  \n", " the"]


@pytest.mark.parametrize("seed", range(3))
def test_encoders_equal_the_library(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["", "a" * 3000, " " * 99, "ab" * 500]
    whole = tokenizers.Tokenizer.from_file(BYTES)
    codec = bpe.ByteBPE(BYTES)
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        assert ids == whole.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == whole.decode(ids, skip_special_tokens=False)
    whole = tokenizers.Tokenizer.from_file(WORDS)
    for text, ids in zip(texts, packing.WordEncoder(WORDS).encode(texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_round_trip_odd_rows(spark):
    encoded = bpe.encode(odd(spark), BYTES)
    texts = {r.doc_id: r.text for r in bpe.decode(encoded, BYTES).collect()}
    assert texts == {i: t or "" for i, t in ODD}
    found = {r.doc_id: r for r in bpe.round_trip(odd(spark), BYTES).collect()}
    assert found[1].n_tokens == 0 and found[8].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.round_trip(odd(spark, 0), BYTES).count() == 0


def test_language_accuracy_and_odd_rows(spark, data):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, ~language_id.held_out(F.col("doc_id")))
    told = docs.select("doc_id", "lang", language_id.held_out(F.col("doc_id")).alias("held_out")).join(language_id.predict(docs, model), "doc_id").where("held_out")
    right, n = told.selectExpr("avg(cast(lang = lang_pred as double))", "count(*)").first()
    assert n > 100 and right > 0.97
    found = {r.doc_id: r for r in language_id.predict(odd(spark), model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 3)) and found[8].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in found.values()) and language_id.predict(odd(spark, 0), model).count() == 0
    empty = language_id.fit(docs.where("false"), F.lit(True))
    assert language_id.predict(odd(spark), empty).where("lang_pred <> 'und'").count() == 0
    tagged = language_id.tag(odd(spark), model, "language")
    assert tagged.columns[-1] == "language" and tagged.count() == len(ODD)


KEY = b"test key"


def test_surrogates_are_distinct_and_none_stays():
    for kind, values in {"phone": [f"{i:010d}" for i in range(2000)], "ssn": [f"{i:09d}" for i in range(500)], "email": [f"user{i}@mail.example.com" for i in range(500)], "ip": [f"52.{i}.7.9" for i in range(256)]}.items():
        found = [pii._next(KEY, kind, v, 0) for v in values]
        assert len(set(found)) == len(values) and not any(a == b for a, b in zip(values, found, strict=True))
    for (script, gender), names in pii.NAMES.items():
        found = {pii._next(KEY, "person", f"{n} Xy", 0).split()[0] for n in names}
        assert found == set(names), (script, gender)


def test_surrogates_keep_format_and_coreference():
    text = "Mrs. Anna Kowalska (ANNA@X.org, anna@x.org) called +1 (656) 555-1234 or 656-555-1234 from 49.37.233.206; card 4539 1488 0343 6467 99."
    new, rows = pii.surrogates(text, KEY)
    kinds = Counter(r["kind"] for r in rows)
    assert kinds == {"person": 1, "email": 2, "phone": 2, "ip": 1, "card": 1}
    for row in rows:
        assert row["surrogate"] != text[row["start"] : row["end"]] and row["surrogate"] in new
    mails = [r["surrogate"] for r in rows if r["kind"] == "email"]
    assert mails[0].lower() == mails[1].lower() and mails[0].isupper() is False and mails[1].islower()
    phones = [re.sub(r"\D", "", r["surrogate"])[-10:] for r in rows if r["kind"] == "phone"]
    assert phones[0] == phones[1]
    card = next(r for r in rows if r["kind"] == "card")
    assert pii.luhn(card["surrogate"].replace(" ", "")) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", card["surrogate"])
    kinds = [r["kind"] for r in pii.surrogates("(636) 555-9331 4913187196670932 53.121.55.90, 1234 5678 9012 3456 53.121.55.91 then 1234-5678-9012-34566 656-555-1234", KEY)[1]]
    assert kinds == ["phone", "card", "ip", "ip", "phone"]
    assert pii.surrogates("plain words 12 and 3.14 only", KEY) == ("plain words 12 and 3.14 only", [])


def test_redact_odd_rows(spark):
    found = {r.doc_id: r for r in pii.redact(odd(spark), KEY).collect()}
    assert found[1].text is None and found[2].text == "" and all(r.n_entities == 0 for r in found.values())
    assert pii.redact_column(odd(spark), KEY).columns == odd(spark).columns and pii.redact(odd(spark, 0), KEY).count() == 0
