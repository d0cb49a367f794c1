"""Fill-in-middle against plain Python, on odd rows and on every place of a short text."""

from __future__ import annotations

import hashlib
import re

import pytest

pytest.importorskip("tarnwork.llm")

from pyspark.sql import functions as F

from tarnwork.llm import infilling
from tarnwork.llm.queries import oracle_sql, queries

from ..compare import same


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_equals_plain_python(spark):
    odd = ["ab c\x1f\x1e\x1e0\x1f1 d\n\U0001f600 é", None, "", "x", "a<b <S y", "a<P>b", "\x1f" * 7, "\x1e" * 5, "\n\r\n", "\x1e1", "S><S <M", "a\x00b", "long " * 40_000]
    rows = list(enumerate(odd)) + [(None, "no id"), (3, "x"), (3, "x")] + [(i, "Wörd <S x> <<P >" * (i % 5)) for i in range(100, 500)]
    frame = spark.createDataFrame([(*r, "t", 5) for r in rows], "doc_id long, text string, output string, n int")
    found = infilling.transform(frame).withColumn("back", infilling.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((((i, *brute(i, t), t or "") for i, t in rows)), key=repr)
    assert sorted(map(tuple, found), key=repr) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_every_cut_is_read_back(spark):
    text = "ab\x1f<c\x1e>Sd"
    rows = spark.createDataFrame([(i, text) for i in range(2000)], "doc_id long, text string")
    found = infilling.transform(rows, plain_from=100).withColumn("back", infilling.restore(F.col("output"), F.col("form")))
    assert found.where(F.col("back") != text).count() == 0
    assert found.select("prefix", "middle").distinct().count() == 36


def test_empty_table(spark):
    assert infilling.digest(infilling.transform(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_warc_conversion", "op13_fill_in_middle"])
def test_query_equals_sql(name, spark, data, duck):
    same(queries()[name](spark, data).toPandas(), duck.sql(oracle_sql()[name]).df())
