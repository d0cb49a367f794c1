"""Keyed state in streams: conversation threads and caches, one stateful operator each, on the RocksDB state store.

State is kept per key as lists, maps and values, so a batch reads and writes what it touches and not a key's whole history.  Entries
nobody touches for ``ttl`` leave the store by themselves; a thread also ends by its timer, in event time.

Order inside a batch is that of time, then of ``seq``; a batch's rows come after those of the batches before it.
Defined cases: null roles and texts are empty; rows without a key are a thread (a cache) of their own; a key whose
state ran out begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import fold_step

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


THREAD = "thread string, messages long, summary string, summarized long, recent array<struct<role:string,text:string>>, entities map<string,long>, last timestamp, closed boolean"


class Threads(StatefulProcessor):
    """A thread's last turns, the rolling summary of the turns before them, and how many of its messages mention each known entity.

    A row comes out for every thread that a batch touches, and one more when ``idle_ms`` of event time have passed without a
    message; then the thread's state goes.
    """

    def __init__(self, known: tuple[str, ...] = (), idle_ms: int = 24 * 3600 * 1000) -> None:
        self.known, self.idle_ms = tuple(k.lower() for k in known), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "role string, text string")
        self.about = handle.getValueState("about", "summary string, summarized long, messages long, last timestamp")
        self.entities = handle.getMapState("entities", "entity string", "n long")

    def _row(self, key: tuple, closed: bool) -> pd.DataFrame:
        summary, summarized, messages, last = self.about.get()
        recent = [{"role": r, "text": t} for r, t in self.turns.get()] if self.turns.exists() else []
        entities = {k[0]: v[0] for k, v in self.entities.iterator()} if self.entities.exists() else {}
        return pd.DataFrame({"thread": [key[0]], "messages": [messages], "summary": [summary], "summarized": [summarized], "recent": [recent], "entities": [entities], "last": [last], "closed": [closed]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        summary, summarized, messages, last = self.about.get() if self.about.exists() else ("", 0, 0, None)
        held = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        for at, role, text in zip(batch["at"], batch["role"].fillna(""), batch["text"].fillna(""), strict=True):
            held, summary, done = fold_step(held, (role, text), summary)
            summarized, messages = summarized + done, messages + 1
            last = at if last is None or at > last else last
            for entity in self.known:
                if entity in text.lower():
                    seen = self.entities.getValue((entity,))[0] if self.entities.containsKey((entity,)) else 0
                    self.entities.updateValue((entity,), (seen + 1,))
        self.turns.put(held)
        self.about.update((summary, summarized, messages, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(last).timestamp() * 1000) + self.idle_ms)
        yield self._row(key, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.about.exists():
            yield self._row(key, True)
            self.turns.clear()
            self.about.clear()
            self.entities.clear()


def threads(messages: DataFrame, known: tuple[str, ...] = (), idle_ms: int = 24 * 3600 * 1000, late: str = "1 hour") -> DataFrame:
    """Threads of a stream ``messages(thread, at, seq, role, text)``."""
    rows = messages.select(F.coalesce(F.col("thread").cast("string"), F.lit("")).alias("thread"), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "role", "text").withWatermark("at", late)
    return rows.groupBy("thread").transformWithStateInPandas(statefulProcessor=Threads(known, idle_ms), outputStructType=THREAD, outputMode="Update", timeMode="EventTime")


ACCESS = "cache string, seq long, key string, hit boolean, evicted string, held long"


class Lru(StatefulProcessor):
    """A cache of ``capacity`` keys: an access finds its key or puts it, and puts out the key used longest ago if there are too many.

    ``alive`` seconds after an entry was put it no longer counts; ``ttl_ms`` after its last change the store forgets it.
    """

    def __init__(self, capacity: int, alive: float | None = None, ttl_ms: int | None = None) -> None:
        self.capacity, self.alive, self.ttl_ms = capacity, alive, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "used long, put double", self.ttl_ms)
        self.clock = handle.getValueState("clock", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        held = {k[0]: tuple(v) for k, v in self.entries.iterator()} if self.entries.exists() else {}
        n = self.clock.get()[0] if self.clock.exists() else 0
        changed: set[str] = set()
        out = []
        for at, seq, asked in zip(batch["at"], batch["seq"], batch["key"].fillna(""), strict=True):
            now, n = pd.Timestamp(at).timestamp(), n + 1
            found = held.get(asked)
            hit = found is not None and (self.alive is None or now - found[1] <= self.alive)
            held[asked] = (n, found[1] if hit else now)
            evicted = None
            if len(held) > self.capacity:
                evicted = min(held, key=lambda k: held[k][0])
                del held[evicted]
                changed.add(evicted)
            changed.add(asked)
            out.append((key[0], int(seq), asked, hit, evicted, len(held)))
        for k in changed:
            if k in held:
                self.entries.updateValue((k,), held[k])
            elif self.entries.containsKey((k,)):
                self.entries.removeKey((k,))
        self.clock.update((n,))
        yield pd.DataFrame(out, columns=["cache", "seq", "key", "hit", "evicted", "held"])


def lru(accesses: DataFrame, capacity: int, alive: float | None = None, ttl_ms: int | None = None) -> DataFrame:
    """What each access of a stream ``accesses(cache, at, seq, key)`` met.

    With ``ttl_ms`` the stream needs a trigger in processing time: the store's clock has it make batches without data, so one that
    takes what is there and stops would not stop.
    """
    rows = accesses.select(F.coalesce(F.col("cache").cast("string"), F.lit("")).alias("cache"), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "key")
    return rows.groupBy("cache").transformWithStateInPandas(statefulProcessor=Lru(capacity, alive, ttl_ms), outputStructType=ACCESS, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
