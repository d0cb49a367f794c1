"""Shared tables lie in the shared folder, go when the application ends, and lengths get the salts they need."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from tarnwork.llm import packing

SCRIPT = """
import sys
from pyspark.sql import SparkSession
from tarnwork.llm._shared import shared_dir, shared_table
spark = SparkSession.builder.master("local[1]").config("spark.sql.warehouse.dir", sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
assert shared_table(spark.range(5), "five").count() == 5
base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
assert shared_dir(spark).startswith(base)
print(shared_dir(spark))
"""


def test_tables_go_with_the_application(tmp_path):
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    told = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "w")], check=True, env=env, timeout=300, cwd=tmp_path, capture_output=True, text=True)
    folder = told.stdout.split()[-1]
    assert folder and not Path(folder.removeprefix("file:")).exists()


@pytest.mark.parametrize("group", [20_000, 3])
def test_salts_follow_the_counts(spark, monkeypatch, group):
    import public_tokenizers

    monkeypatch.setattr(packing, "_GROUP", group)
    docs = spark.createDataFrame([(i % 40, "a b c " * (i % 9)) for i in range(120)], "doc_id long, text string")
    rows = packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")), size=16).collect()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 16
    packing._encoders.clear()
