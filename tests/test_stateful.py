"""Keyed state in streams against plain Python, over several batches and restarts; the directory source."""

from __future__ import annotations

import random
from collections import OrderedDict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tarnwork.operators.state import fold_messages
from tarnwork.session import reachable
from tarnwork.sources.directories import directories
from tarnwork.streaming import jobs, state, throttle

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def run(spark, make, out, source, schema, mode):
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
    with state.rocks(spark):
        jobs.run_available(make(rows), lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}"), out + "-state", mode)


def test_threads_go_on_after_a_restart_and_close(spark, tmp_path):
    reachable(spark)
    rng = random.Random(2)
    schema = "thread string, at timestamp, seq long, role string, text string"
    said = [(f"t{i % 3}" if i % 7 else None, BASE + timedelta(minutes=i), i, rng.choice(["user", "assistant", None]), rng.choice(["Gears. More", "a long text about the bolts of many gears, which goes on. End", None, "x"])) for i in range(80)]
    source, out = str(tmp_path / "src"), str(tmp_path / "out")
    for part, rows in enumerate((said[:30], said[30:], [("late", BASE + timedelta(days=9), 0, "user", "x")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{part}")
        run(spark, lambda r: state.threads(r, ("gears", "bolts")), out, source, schema, "update")
    found = spark.read.parquet(out)
    last = {r.thread: r for r in found.where("not closed").groupBy("thread").agg(F.max_by(F.struct("messages", "summary", "summarized", "recent", "entities"), "messages").alias("t")).select("thread", "t.*").collect()}
    for key in ("t0", "t1", "t2", ""):
        mine = [(r or "", t or "") for th, _, _, r, t in said if (th or "") == key]
        summary, done, kept = fold_messages(mine)
        got = last[key]
        assert (got.messages, got.summary, got.summarized, len(got.recent)) == (len(mine), summary, done, kept)
        assert [(r.role, r.text) for r in got.recent] == mine[len(mine) - kept :]
        assert dict(got.entities) == {k: n for k in ("gears", "bolts") if (n := sum(k in t.lower() for _, t in mine))}
    assert {r.thread for r in found.where("closed").collect()} == {"t0", "t1", "t2", ""}


@pytest.mark.parametrize("alive", [None, 300.0])
def test_a_cache_equals_an_ordered_dict(spark, tmp_path, alive):
    reachable(spark)
    rng = random.Random(3)
    schema = "cache string, at timestamp, seq long, key string"
    asked = [(rng.choice("ab"), BASE + timedelta(seconds=37 * i), i, rng.choice("uvwxyz")) for i in range(160)]
    source, out = str(tmp_path / "src"), str(tmp_path / "out")
    for part in range(2):
        spark.createDataFrame(asked[80 * part : 80 * part + 80], schema).coalesce(1).write.parquet(f"{source}/{part}")
        run(spark, lambda r: state.lru(r, 3, alive), out, source, schema, "append")
    held: dict[str, OrderedDict] = {"a": OrderedDict(), "b": OrderedDict()}
    want = []
    for cache, at, seq, key in asked:
        c = held[cache]
        hit = key in c and (alive is None or (at - c[key]).total_seconds() <= alive)
        put = c.pop(key, at) if hit else at
        c.pop(key, None)
        c[key] = put
        evicted = c.popitem(last=False)[0] if len(c) > 3 else None
        want.append((cache, seq, key, hit, evicted, len(c)))
    found = spark.read.parquet(out).select("cache", "seq", "key", "hit", "evicted", "held").collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want


def test_text_is_given_out_once_and_in_order(spark, tmp_path):
    reachable(spark)
    schema = "key string, at timestamp, seq long, text string"
    rng = random.Random(4)
    pieces = [(rng.choice("pq"), BASE + timedelta(milliseconds=200 * i), i, rng.choice(["ab", "cdefgh", None, "x" * 30])) for i in range(120)]
    source, out = str(tmp_path / "src"), str(tmp_path / "out")
    for part, rows in enumerate((pieces[:50], pieces[50:], [("~", BASE + timedelta(days=3), 0, "end")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{part}")
        run(spark, lambda r: throttle.throttled(r, 0.5, 50), out, source, schema, "append")
    found = spark.read.parquet(out).where("key <> '~'").orderBy("key", "part").collect()
    for key in "pq":
        mine = [r for r in found if r.key == key]
        assert [r.part for r in mine] == list(range(len(mine)))
        assert "".join(r.text for r in mine) == "".join(t or "" for k, _, _, t in pieces if k == key)
        assert sum(r.pieces for r in mine) == sum(k == key for k, *_ in pieces) and all(len(r.text) >= 50 for r in mine[:-1])


def test_directories_are_listed(spark, tmp_path):
    reachable(spark)
    (tmp_path / "a" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "b é").mkdir()
    (tmp_path / "skipped" / "x").mkdir(parents=True)
    (tmp_path / "a" / "one.txt").write_text("12345")
    (tmp_path / "a" / "deep" / "er" / "two.txt").write_text("")
    (tmp_path / "top.txt").write_text("x")
    (tmp_path / "b é" / "link").symlink_to(tmp_path / "a")
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    rows = {r.path.removeprefix(str(tmp_path)): r for r in directories(spark, str(tmp_path), skip=("skipped",)).collect()}
    assert set(rows) == {"", "/a", "/a/deep", "/a/deep/er", "/a/deep/er/two.txt", "/a/one.txt", "/b é", "/b é/link", "/gone", "/top.txt"}
    assert rows["/a/one.txt"].size_bytes == 5 and rows["/a/one.txt"].level == 2 and not rows["/a/one.txt"].is_directory and rows["/a"].is_directory and rows["/a"].size_bytes == 0
    assert not rows["/b é/link"].is_directory and rows["/a/deep/er"].parent == str(tmp_path / "a" / "deep") and rows["/a"].mtime is not None
    assert directories(spark, f"file://{tmp_path}", depth=1).where("level > 1").count() == 0
    assert directories(spark, str(tmp_path / "missing")).count() == 0
    from tarnwork.sources.directories import described

    assert described(str(tmp_path / "missing"), 1)[3:] == (False, -1, "unknown", 0, None, 1)


def test_plans_fall_back_and_run_together(spark):
    import time

    from tarnwork.plans import fallbacks, steps

    assert fallbacks.decomposition("hot gear and whales") == "hot gear" and fallbacks.narrowing("find the large networks of gears") in ("large networks", "networks gears")
    assert "machine learning" in fallbacks.expansion("ml gears") and fallbacks.reformulation("what is the gear?") == "gear"
    run = fallbacks.with_strategies([steps.Step("s1", "registry", "gears and bolts")], {"registry": lambda q, _: spark.range(5 if q == "gears" else 0)}, ("unknown", "expansion", "decomposition", "narrowing"))
    assert [o.step for o in run.outcomes if o.success] == ["fallback:decomposition"] and run.quality == 0.95

    @F.udf("long")
    def slow(x):
        time.sleep(30)
        return x

    actions = {"registry": lambda q, _: spark.range(3), "slow": lambda q, _: spark.range(8).select(slow("id")), "broken": lambda q, _: 1 / 0}
    plan = [steps.Step("a", "registry", "q"), steps.Step("b", "slow", "q"), steps.Step("c", "broken", "q"), steps.Step("d", "registry", "q", "a"), steps.Step("e", "registry", "q", "c"), steps.Step("f", "combine", "", "a", ("a", "d"))]
    began = time.perf_counter()
    run = fallbacks.execute_together(spark, plan, actions, seconds=8)
    told = {o.step: o for o in run.outcomes}
    assert set(told) == {"a", "b", "c", "d", "f"} and told["a"].success and told["d"].success and told["f"].rows.count() == 6
    assert "more than 8 seconds" in told["b"].error and "division" in told["c"].error and time.perf_counter() - began < 28
