"""Near duplicates on real tables at the pipeline's setting, rows of one id, and groups that chance alone makes."""

from __future__ import annotations

import itertools
import random

import pytest

from tarnwork.llm import near_dedup
from tarnwork.llm._words import WORD


def shingles(text, n):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent=80):
    """Components of the ids of all rows, every pair that shares a shingle compared."""
    sets = [shingles(t, n) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    root = {d: d for d, _ in rows}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    pairs = {p for h in holders.values() for p in itertools.combinations(h, 2)}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((top(rows[i][0]), top(rows[j][0])))
            root[b] = a
    return {d: top(d) for d, _ in rows}


@pytest.mark.parametrize("words", [4, 5])
def test_documents_equal_brute_force(spark, data, words):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, words=words).collect()}
    assert found == brute(rows, words)


def test_rows_of_one_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(5, a), (5, b), (3, a + " more"), (9, b + " more"), (5, a), (7, "other words of no kin at all")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame, words=4).collect())
    assert found == [(3, 3, True), (5, 3, False), (5, 3, False), (5, 3, False), (7, 7, True), (9, 3, False)]


def test_pairs_that_share_bands_by_chance_make_no_group(spark):
    """Texts of similarity about 0.4 share bands often; the groups that texts are fetched for hold only likely pairs."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"u{i}_{k}" for k in range(45)])) for i in range(40)] + [(100, " ".join(common)), (101, " ".join(common + ["end"]))]
    rng.shuffle(rows)
    seen = []
    real = near_dedup._joining

    def spy(groups, signed, texts, *rest):
        if texts is not None:
            seen.append(groups.count())
        return real(groups, signed, texts, *rest)

    near_dedup._joining = spy
    try:
        found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    finally:
        near_dedup._joining = real
    assert seen == [2] and found[101] == 100 and all(found[i] == i for i in range(40))


@pytest.mark.parametrize("chunk", [3, 10])
def test_cut_buckets_and_groups_lose_no_link(spark, chunk):
    rng = random.Random(chunk)
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(60)]
        for i in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            rows.append((g * 100 + i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame, words=4, chunk=chunk, leaders=1).collect()}
    assert found == brute(rows, 4)
