"""The throttled sink: what a key costs, whole microseconds, zones whose clock goes back, pieces without a time."""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import Row

from tarnwork.session import reachable
from tarnwork.streaming import jobs, state, throttle

BASE = datetime(2024, 11, 3, 4, 30, tzinfo=timezone.utc)  # half an hour before New York's clock shows an hour again


class Counted:
    """A key's state, its timers, and what was asked of them."""

    def __init__(self):
        self.value, self.timers, self.asked = None, [], []

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        self.asked.append("exists")
        return self.value is not None

    def get(self):
        self.asked.append("get")
        return self.value

    def update(self, value):
        self.asked.append("update")
        self.value = value

    def listTimers(self):  # noqa: N802
        self.asked.append("list")
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.asked.append("register")
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.asked.append("delete")
        self.timers.remove(at)


def test_a_key_costs_few_calls_to_its_state():
    kept, sink = Counted(), throttle.Throttle(60.0, 8)
    sink.init(kept)
    rows = [Row(at=BASE + timedelta(seconds=10 * i), seq=i, text="abc") for i in range(9)]
    out = list(sink.handleInputRows(("k",), iter(rows), None))
    assert kept.asked == ["get", "update", "register"] and [(r.text, r.pieces) for r in out] == [("abc" * 7, 7)]
    kept.asked.clear()
    assert [(r.part, r.text, r.until) for r in sink.handleExpiredTimer(("k",), None, None)] == [(1, "abcabc", BASE + timedelta(seconds=80))]
    kept.timers.clear()
    assert kept.asked == ["get", "update"]


def test_a_long_held_text_is_not_copied_for_each_piece():
    began = time.perf_counter()
    out, text, count, _ = throttle.gather(((i, "abcde") for i in range(150_000)), "", 0, None, 10**9, 10)
    assert not out and (len(text), count) == (750_000, 150_000) and time.perf_counter() - began < 2


def test_times_are_exact_in_any_zone(spark, tmp_path):
    reachable(spark)
    schema = "key string, at timestamp, seq long, text string"
    tenths = [("a", BASE + timedelta(milliseconds=100 * i), i, f"{i:03}") for i in range(40)]  # each exactly as far as the wait
    fold = [("b", BASE + timedelta(minutes=10 * i), 20 - i, f"{i:03}") for i in range(20)]
    timeless = [("c", None, 1, "late"), ("c", BASE, 0, "early"), ("d", None, 0, "only")]
    source, out = str(tmp_path / "src"), str(tmp_path / "out")
    for part, rows in enumerate((tenths + fold + timeless, [("~", BASE + timedelta(days=3), 0, "end")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{part}")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        pieces = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
        with state.rocks(spark):
            jobs.run_available(throttle.throttled(pieces, 0.1, 3), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), out + "-state")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    found: dict[str, list] = {}
    for r in spark.read.parquet(out).orderBy("key", "part").selectExpr("key", "part", "text", "pieces", "unix_micros(until) AS until").collect():
        found.setdefault(r.key, []).append(r)
    micros = lambda at: (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    assert [r.text for r in found["a"]] == ["000001"] + [f"{i:03}" for i in range(2, 40)]
    assert "".join(r.text for r in found["b"]) == "".join(f"{i:03}" for i in range(20))
    assert [r.until for r in found["b"]] == [micros(at) for _, at, _, _ in fold[1:]]
    assert [(r.text, r.pieces, r.until) for r in found["c"]] == [("earlylate", 2, micros(BASE))]
    assert [(r.text, r.pieces, r.until) for r in found["d"]] == [("only", 1, 0)]
