"""Chunkers as table functions: a lateral join gives a row's chunks beside all its other columns, without a second join.

``overlapping`` cuts at sentence ends; a chunk begins with the last characters of the one before it.  Places count one character for each
gap between sentences, as the chunks' texts have it.  Defined cases: null and empty texts have no chunk; a text shorter than
``least`` is one chunk; a last chunk shorter than ``least`` goes to the one before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_GAP = re.compile(r"(?<=[.!?])\s+")


def overlapping_pieces(text: str | None, size: int = 500, overlap: int = 100, least: int = 50) -> list[tuple[str, int, int]]:
    """``(chunk, start, end)`` of a text."""
    if not text:
        return []
    if len(text) < least:
        return [(text, 0, len(text))]
    done: list[tuple[str, int, int]] = []
    held, begin, at = "", 0, 0
    for sentence in _GAP.split(text):
        if not held:
            held, begin = sentence, at
        elif len(held) + len(sentence) <= size:
            held = f"{held} {sentence}"
        else:
            done.append((held.strip(), begin, at))
            tail = held[-overlap:] if 0 < overlap < len(held) else ""
            held, begin = (f"{tail} {sentence}", at - len(tail)) if tail else (sentence, at)
        at += len(sentence) + 1
    last = held.strip()
    if last and (len(last) >= least or not done):
        done.append((last, begin, len(text)))
    elif last:
        before, start, _ = done[-1]
        done[-1] = (f"{before} {last}", start, len(text))
    return done


@udtf(returnType="chunk_index int, chunk string, char_start int, char_end int", useArrow=True)
class Overlapping:
    def eval(self, text: str, size: int, overlap: int, least: int) -> Iterator[tuple]:
        for i, piece in enumerate(overlapping_pieces(text, size, overlap, least)):
            yield (i, *piece)


def overlapping(rows: DataFrame, text: str = "text", size: int = 500, overlap: int = 100, least: int = 50) -> DataFrame:
    """``rows`` with ``chunk_index, chunk, char_start, char_end``, a row per chunk."""
    return rows.lateralJoin(Overlapping(F.col(text).outer(), F.lit(size), F.lit(overlap), F.lit(least)))
