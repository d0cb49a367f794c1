"""A throttled sink: text gathered per key and given out by age and size.

A reader of a stream of small pieces (a chat that is typed, a log) shall not be told of each one.  Pieces are held per key in the state
store; a batch gives out a key's text once ``characters`` are held and ``seconds`` of event time have passed since the last time, and
what a key still holds ``seconds`` after its last piece is given out by a timer.  Nothing is lost, given out twice or out of order.

Rows go to Python as rows: a frame for each key costs more than all its pieces.  What a batch gives out by timers is one list a task.

``Flushes`` is a listener that counts rows and batches of a running query.  Defined cases: null pieces are empty; rows of equal time
go by ``seq``; pieces without a time come last in their batch, at its latest time (the key's last one if none has a time); a key without
pieces for ``seconds`` holds nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

OUT = "key string, part long, text string, pieces long, until timestamp"


def gather(pieces: Iterable[tuple[int, str]], held: str, count: int, since: int | None, wait: int, characters: int) -> tuple[list[tuple[str, int, int]], str, int, int | None]:
    """What is given out after each of ``pieces`` (time, text), and what is still held, of how many pieces, since when;
    times and ``wait`` are whole numbers of one unit."""
    out, parts, size = [], [held], len(held)
    for at, text in pieces:
        since = at if since is None else since
        parts.append(text)
        size, count = size + len(text), count + 1
        if size >= characters and at - since >= wait:
            out.append(("".join(parts), count, at))
            parts, size, count, since = [], 0, 0, at
    return out, "".join(parts), count, since


_EPOCH, _MICROSECOND = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(microseconds=1)


def _row(key: str, part: int, text: str, pieces: int, at: int) -> Row:
    return Row(key=key, part=part, text=text, pieces=pieces, until=_EPOCH + at * _MICROSECOND)


class Throttle(StatefulProcessor):
    def __init__(self, seconds: float, characters: int) -> None:
        self.wait, self.characters = round(seconds * 1e6), characters

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "text string, pieces long, since long, last long, part long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        text, count, since, last, part = self.held.get() or ("", 0, None, None, 0)
        if count:  # only what is held has a timer
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        # Microseconds: datetimes of one zone compare by the clock on the wall, which goes back once a year.
        batch = sorted(((r.at is None, 0 if r.at is None else (r.at - _EPOCH) // _MICROSECOND, r.seq is None, r.seq or 0, r.text or "") for r in rows), key=lambda p: p[:4])
        latest = max((p[1] for p in batch if not p[0]), default=last or 0)
        out, text, count, since = gather(((latest if timeless else at, t) for timeless, at, _, _, t in batch), text, count, since, self.wait, self.characters)
        last = latest if last is None else max(latest, last)
        self.held.update((text, count, since, last, part + len(out)))
        if count:
            self.handle.registerTimer((last + self.wait) // 1000 + 1)
        for i, (t, n, at) in enumerate(out):
            yield _row(key[0], part + i, t, n, at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        text, count, _, last, part = self.held.get() or ("", 0, None, None, 0)
        if count:
            self.held.update(("", 0, last, last, part + 1))
            yield _row(key[0], part, text, count, last)


def throttled(pieces: DataFrame, seconds: float = 0.5, characters: int = 50, late: str = "1 hour") -> DataFrame:
    """What a stream ``pieces(key, at, seq, text)`` gives out."""
    rows = pieces.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "text").withWatermark("at", late)
    return rows.groupBy("key").transformWithState(statefulProcessor=Throttle(seconds, characters), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


class Flushes(StreamingQueryListener):
    """Counts what queries gave out, by the query's name or id."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.name or event.id), 0)

    def onQueryProgress(self, event) -> None:
        name = str(event.progress.name or event.progress.id)
        self.rows[name] = self.rows.get(name, 0) + max(0, event.progress.numInputRows)
        self.batches[name] = self.batches.get(name, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
