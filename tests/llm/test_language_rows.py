"""What the language model learns from, and its kernel against the exact one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import language_id


def test_a_language_of_one_id_is_learned(spark):
    rows = [(1, f"le chat noir {i % 7}", "fr") for i in range(3000)] + [(i + 10, f"the black cat {i % 9}", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True), per_language=20)
    assert model.languages == ("en", "fr")
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs.dropDuplicates(["doc_id"]), model).collect()}
    assert found[1] == "fr" and found[11] == "en"


def test_bounds_hold(spark):
    rows = [(i, f"word{i} of{k}", f"l{k}") for k in range(5) for i in range(40 * (k + 1))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True), per_language=10, most_languages=3)
    assert model.languages == ("l2", "l3", "l4") and len(model.landmarks) <= 30


@pytest.mark.parametrize("texts", [["abca", "abcb", "xyz", "ab"], ["ein Wort und", "ein Ort", "une mot", "a word and"]])
def test_kernel_is_the_blended_spectrum_one(texts):
    """Hashed presence against the exact kernel on sets of n-grams: few n-grams, so hashes hardly meet."""

    def grams(t):
        return {t[i : i + n] for n in range(1, language_id.LONGEST + 1) for i in range(len(t) - n + 1)}

    x = np.zeros((len(texts), 1 << language_id.BITS), dtype=np.uint8)
    for row, t in zip(x, texts, strict=True):
        language_id.presence(t, row)
    hashed = x.astype(int) @ x.astype(int).T
    exact = np.array([[len(grams(a.lower()) & grams(b.lower())) for b in texts] for a in texts])
    assert np.abs(hashed - exact).max() <= 1


def test_texts_of_no_learned_language_are_told(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model, known = language_id.fit(docs, F.lit(True)), language_id.known_runs(docs, F.lit(True))
    odd = [(1, "这是一个中文句子，用来测试。" * 20), (2, "Это русский текст для проверки " * 9), (3, "xqzj kvvw qqzx " * 20)]
    told = language_id.tag(spark.createDataFrame(odd, "doc_id long, text string"), model, "told", known)
    assert {r.told for r in told.collect()} == {"und"}
    clean = language_id.tag(docs.where("regexp_like(text, '[a-zA-Z]')"), model, "told", known)
    assert clean.where("told = 'und'").count() == 0
