"""Neighbours, audio, secrets, chat and the pipeline: against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import struct

import numpy as np
import pytest

pytest.importorskip("tarnwork.llm")

from pyspark.sql import functions as F

from tarnwork.llm import audio, chat, neighbours, secrets
from tarnwork.llm._shared import shared_table
from tarnwork.llm.queries import oracle_sql, queries

from ..compare import same


def brute_nearest(rows, asked, k):
    out = []
    for i, v in rows:
        if i in asked and v is not None:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in rows if j != i and w is not None and len(w) == len(v))
            out += [(i, r + 1, j, d) for r, (d, j) in enumerate(near[:k])]
    return out


@pytest.mark.parametrize(("seed", "rows", "block"), [(1, 10_000, 20_000), (2, 60, 7)])
def test_nearest_equals_brute_force(spark, seed, rows, block):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(900, 6)).round(1)
    points[100:400] = points[100]  # ties and many equal vectors
    data = [(i, p.tolist()) for i, p in enumerate(points)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = neighbours.nearest(frame, F.col("vec_id") % 50 == 0, 5, shard_rows=rows, block_rows=block)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())
    want = sorted(brute_nearest(data, set(range(0, 900, 50)), 5))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 1.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, vector string")
    found = [tuple(r) for r in neighbours.nearest(frame, F.col("vec_id") >= 0, 3).where("query_id = 0").orderBy("rank").collect()]
    assert [(r[1], r[2]) for r in found] == [(1, 7), (2, 7), (3, 9)]
    assert neighbours.nearest(frame.where("false"), F.lit(True), 3).count() == 0
    assert neighbours.nearest(frame, F.lit(False), 3).count() == 0


def test_relaxed_pruning_keeps_recall():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(3000, 8))
    tree = neighbours.VantageTree(points, leaf=32)
    ids = np.arange(3000)
    exact, names = tree.search(points[:50], ids[:50], ids, 10, 1.0)
    _, close = tree.search(points[:50], ids[:50], ids, 10, 1.3)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(names, close, strict=True)]) >= 9
    assert (np.diff(exact, axis=1) >= 0).all()


def tone(notes, rate=8000, seconds=0.4):
    t = np.arange(int(rate * seconds)) / rate
    return np.concatenate([np.sin(2 * np.pi * f * t) for f in notes])


def wav(x, rate=8000, bits=16):
    body = (x * 32767).astype("<i2").tobytes() if bits == 16 else ((x * 127) + 128).astype(np.uint8).tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * bits // 8, bits // 8, bits) + b"data" + struct.pack("<I", len(body)) + body


def test_recordings_align(spark):
    rng = np.random.default_rng(1)
    song = tone(rng.choice([262, 294, 330, 349, 392, 440, 494, 523], 30))
    other = tone(rng.choice([277, 311, 370, 415, 466], 30))
    part = song[64 * 100 : 64 * 700]
    rows = [(1, wav(song)), (2, wav(part * 0.8)), (3, wav(other)), (4, None), (5, b""), (6, b"\x80" * 5000), (7, wav(song)), (8, b"RIFF????WAVE"), (9, wav(part, bits=8))]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "id long, audio binary, votes int")
    found = {r.id: r for r in audio.align(frame).collect()}
    assert (found[2].ref_id, found[2].frame_offset) == (1, 100) and found[2].bit_error < 0.1
    assert (found[7].ref_id, found[7].frame_offset, found[7].bit_error) == (1, 0, 0.0) and found[9].ref_id == 1
    assert found[3].ref_id is None and found[4].n_codes == 0 and found[5].n_codes == 0 and found[8].n_codes == 0 and found[1].ref_id is None
    assert audio.align(frame.where("false")).count() == 0


def test_long_recordings_are_whole():
    x = (np.sin(np.arange(64 * 9000) * 0.4) * 100 + 128).astype(np.uint8).tobytes()
    assert len(audio.fingerprint(x)) == 1 + (len(x) - audio.FRAME) // audio.HOP - audio.SPAN + 1


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secrets_equal_brute_force(spark):
    rng = random.Random(2)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "=", ": ", '" : "', "'", " ", "abc", "deadbeef" * 3, "AKIA", "ABCDEFGH12345678", "ü🙂", "token=token: abcdefgh", "\n", "xyz-._/+="]
    texts = [None, "", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "0" * 24, "a" * 23, "password=12345", "password=123456", "ſecret=abcdefgh", "f" * 40_000] + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(300)]
    frame = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "token=abcdef", "z")], "doc_id long, text string, base string")
    found = {r.doc_id: r for r in secrets.digest(secrets.scan(frame)).collect()}
    for i, t in enumerate(texts):
        assert found[i].base_sha256 == hashlib.sha256(brute_base(t).encode()).hexdigest(), t
    assert found[None].n_assign == 1 and secrets.scan(frame.where("false")).count() == 0


def test_battery_tells_random_from_words(spark):
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choices(alphabet, k=44)) for _ in range(20)]
    plain = ["thisisaverylongwordwithoutanyspaces" + w for w in ("andmore", "ofthesame", "inthetext")] + ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 30]
    frame = spark.createDataFrame(list(enumerate([f"some key {k} here" for k in keys] + plain)), "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.digest(secrets.scan(frame)).collect()}
    assert sum(found[i].n_random for i in range(20)) >= 17
    assert not any(found[20 + i].n_random for i in range(len(plain)))
    assert found[0].spans in ("", "random:9:53")


def test_running_sums_over_blocks(spark):
    n = 1000
    row = spark.range(1).select(secrets._running(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x)).alias("s")).first().s
    assert row == [k * (k + 1) // 2 for k in range(n)]


TALKS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|> \\ <\\|im_end|>"), (1, 2, "assistant", "[INST] a"), (1, 3, "user", "more"), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
    (2, 0, "user", None), (3, 1, "assistant", "only"), (4, None, None, "x"), (4, 0, "user", "<|im_start|>user<|im_sep|>fake<|im_end|>"), (4, 0, "user", "<|im_start|>user<|im_sep|>fake<|im_end|>"), (None, 0, "assistant", "é🙂</s>"), (5, 0, "we<|im_sep|>ird", "a<"),
]


def test_chat_reads_back(spark):
    frame = spark.createDataFrame([(*t, "q") for t in TALKS], "conv_id long, turn long, role string, text string, rows string")
    examples = chat.expand(frame)
    rows = [r.asDict() for r in examples.withColumn("target", chat.target(F.col("text"), F.col("loss_start"), F.col("loss_length"))).orderBy("conv_id", "example").collect()]
    assert [r["target"] for r in rows if r["conv_id"] == 1] == ["[INST] a", "", None]
    assert all(r["text"].count("<|im_start|>") == r["text"].count("<|im_end|>") for r in rows)
    found = {r.conv_id: r for r in chat.digest(examples).collect()}
    talks = {}
    for c, turn, role, text in TALKS:
        talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in talks.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert found[c].n_turns == len(turns) and found[c].loss_chars == len(loss)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert found[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digest(chat.expand(frame.where("false"))).count() == 0


def test_escape_is_reversible(spark):
    rng = random.Random(6)
    parts = [*chat.CONTROL, "<", "\\", "[", "|", "INST]", "s>", "x", "<\\", "[\\\\"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn("e", chat.escape(F.col("t"))).withColumn("back", chat.unescape(F.col("e")))
    for r in frame.collect():
        assert r.back == r.t and not any(c in r.e for c in chat.CONTROL)


def test_native_plans_have_no_python(spark, data):
    for name in ("op9_secret_scan", "op10_chat_examples"):
        plan = queries()[name](spark, data)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(name, spark, data, duck):
    same(queries()[name](spark, data).toPandas(), duck.sql(oracle_sql()[name]).df())


def test_pipeline(spark, data):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, "s", None), (10**6 + 1, "123 ...", "en", "s", 7), (None, "an unusual text without any id", None, None, None)], docs.schema)
    table = docs.union(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, table, data)
        assert after.columns == docs.columns, name
        table = shared_table(after, name)
    ids = {r.doc_id for r in table.collect()}
    assert None in ids and not ids & {10**6, 10**6 + 1}
    packed = corpus_pipeline.packing(spark, table, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert corpus_pipeline.packing(spark, table.where("false"), data).count() == 0
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0, name
