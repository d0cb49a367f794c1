"""The divergence audit against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("tarnwork.llm")

from pyspark.sql import functions as F

from tarnwork.llm import divergence
from tarnwork.llm._shared import reachable

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, k):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(LOWER))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def chances(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: chances(counts[lang, s]) for s in sources}
        q = chances(whole)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, k)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "The", "ÄPFEL", "äpfel", "naïve", "z", "日本", "a1b", "x\x00y", "don't", "Ωmega"] + [f"w{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}{'qrs'[i % 3]}" for i in range(60)]
    rows = [(None, "en", "s1"), ("", None, None), ("123 !!", "en", "empty"), ("only once", "xx", "alone"), ("the the", None, "s1")]
    for _ in range(900):
        lang = rng.choice(["en", "en", "de", None])
        source = "hot" if rng.random() < 0.4 else f"s{rng.randint(1, 6)}"
        own = words[: 20 + 7 * len(source)] if source != "s3" else words[40:]
        rows.append((" ".join(rng.choices(own, k=rng.randint(0, 30))), lang, source))
    return rows + rows[:3]


@pytest.mark.parametrize(("seed", "least", "k", "flush", "cells"), [(1, 10, 10, 300_000, 1 << 21), (2, 3, 2, 25, 40), (3, 2000, 10, 300_000, 1 << 21)])
def test_equals_plain_python(spark, monkeypatch, seed, least, k, flush, cells):
    reachable(spark)
    monkeypatch.setattr(divergence, "_FLUSH", flush)
    monkeypatch.setattr(divergence, "_CELLS", cells)
    rows = corpus(seed)
    frame = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "text string, lang string, source string, doc_id long, term string").repartition(3)
    found = [tuple(r) for r in divergence.audit(frame, least, k).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(found) == brute(rows, least, k)


def test_partial_counts_flush_and_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "_FLUSH", 7)
    monkeypatch.setattr(divergence, "_PIECE", 5)
    texts = ["Aa bb aa " * 9, "", "ccc-ddd éé", "q" * 50 + " " + "r" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts * 3]), pa.array(["l"] * 12), pa.array(["s"] * 12)], ["text", "lang", "source"])
    total = Counter()
    for part in divergence._partial_counts(iter([batch])):
        for row in part.to_pylist():
            total[row["term"], "n"] += row["n"]
            total[row["term"], "d"] += row["d"]
    assert total[b"aa", "n"] == 54 and total[b"aa", "d"] == 3 and total[b"q" * 50, "n"] == 3 and total["éé".encode(), "d"] == 3


def test_buckets_bound_and_large_counts(spark):
    rows = spark.createDataFrame([(10**12, 10**13, 10**6), (0, 7, 0), (5, 100, 10)], "n long, total long, v long")
    got = [r[0] for r in rows.select(divergence.probability(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (10**12 + 2) // (10**13 + 2 * 10**6), None, 1 + 10**9 * 7 // 120]


def test_empty_table(spark):
    reachable(spark)
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
