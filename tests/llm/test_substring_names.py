"""Rows without an id, and rows of one id, are told apart by their texts; no unique word is lost."""

from __future__ import annotations

import random

import pytest

from tarnwork.llm import substring_dedup
from tarnwork.llm._words import WORD


def brute(rows, words):
    """Kept words of documents in their order: a window that starts earlier somewhere goes."""
    seen, out = set(), []
    for text in rows:
        tokens = WORD.findall(text or "")
        gone = [False] * len(tokens)
        for i in range(len(tokens) - words + 1):
            window = tuple(tokens[i : i + words])
            if window in seen:
                gone[i : i + words] = [True] * words
            seen.add(window)
        out.append(" ".join(t for t, g in zip(tokens, gone, strict=True) if not g))
    return out


def test_rows_without_id_keep_what_is_theirs(spark):
    w, v = (" ".join(f"{c}{i}" for i in range(30)) for c in "wv")
    frame = spark.createDataFrame([(None, w), (None, v), (None, f"{w} {v}"), (None, None), (5, w)], "doc_id long, text string")
    found = substring_dedup.remove_repeats(frame, words=20).collect()
    assert len(found) == 5 and sum(r.doc_id is None for r in found) == 4
    kept = [t for r in found for t in r.text.split()]
    assert set(kept) >= set(f"{w} {v}".split())
    # Each window stands somewhere, and once only, but for the words about a cut.
    windows = [tuple(t[i : i + 20]) for r in found for t in [r.text.split()] for i in range(len(t) - 19)]
    for text in (w, v):
        t = text.split()
        assert all(any(tuple(t[i : i + 20]) == x for x in windows) for i in range(11))
    assert next(r for r in found if r.doc_id == 5).n_removed == 30


def test_one_id_with_different_texts(spark):
    w, v = (" ".join(f"{c}{i}" for i in range(30)) for c in "wv")
    frame = spark.createDataFrame([(1, w), (1, v), (1, w), (2, v)], "doc_id long, text string")
    found = sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(frame, words=20).collect())
    assert found == [(1, 0), (1, 0), (1, 0), (2, 30)]


@pytest.mark.parametrize("shard", [2, 5000])
def test_long_words_and_odd_spaces(spark, shard):
    rng = random.Random(1)
    pool = ["a", "b", "é", "x" * 65, "x" * 64 + "y", "z" * 300_000, "\0q", " ", " w"]
    texts = [rng.choice([" ", "\t", "\n\n", "\x0b"]).join(rng.choices(pool[:5] + pool[6:], k=rng.randint(3, 40))) for _ in range(60)] + [" ".join([pool[5], "a", "b", "a", "b"])] * 2
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in substring_dedup.remove_repeats(frame, words=4, shard=shard).collect()}
    want = brute(texts, 4)
    assert all(" ".join(WORD.findall(found[i])) == want[i] for i in range(len(texts)))
