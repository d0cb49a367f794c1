"""Dates in texts: one pattern per family, with offsets, context, deduplication and a primary date."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Months, seasons, contexts (in order) and what a context is worth.
_MONTHS = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_SHORT = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SEASONS = {"spring": 3, "summer": 6, "fall": 9, "autumn": 9, "winter": 12}
CONTEXTS = {
    "deadline": r"\b(deadline|due|submit|submission|cutoff)\b",
    "event": r"\b(meeting|conference|workshop|seminar|talk|presentation|symposium)\b",
    "publication": r"\b(published|released|issued|appeared|print)\b",
    "project": r"\b(started|began|ends|ended|completed|finish|launch|timeline)\b",
}
PRIORITY = {"deadline": 4, "event": 3, "publication": 2, "project": 1, "unknown": 0}
_Y, _D, _M = r"(20[12]\d)", r"(0?[1-9]|[12]\d|3[01])", rf"({_MONTHS})"
#: Pattern and confidence of each family.
FAMILIES: dict[str, tuple[str, float]] = {
    "iso": (r"\b(20[12]\d)[-/](0[1-9]|1[0-2])(?:[-/](0[1-9]|[12]\d|3[01]))?\b", 0.95),
    "us": (rf"\b(0?[1-9]|1[0-2])/{_D}/(\d{{2}}|\d{{4}})\b", 0.85),
    "mdy": (rf"\b{_M}\s+{_D}(?:st|nd|rd|th)?,?\s+{_Y}\b", 0.9),
    "dmy": (rf"\b{_D}(?:st|nd|rd|th)?\s+{_M},?\s+{_Y}\b", 0.9),
    "month": (rf"\b{_M}\s+{_Y}\b", 0.8),
    "quarter": (rf"\bQ([1-4])[-\s]*{_Y}\b", 0.85),
    "fiscal": (r"\bFY[-\s]?(\d{4}|\d{2})\b", 0.75),
    "season": (rf"\b(Spring|Summer|Fall|Autumn|Winter)\s+{_Y}\b", 0.7),
    "years": (rf"\b{_Y}[-–]{_Y}\b", 0.75),
    "days": (rf"\b{_M}\s+{_D}(?:st|nd|rd|th)?[-–]+{_D}(?:st|nd|rd|th)?,?\s+{_Y}\b", 0.85),
    "year": (rf"\b(?:in|since|during|by|year|dated|from|until|through)\s+{_Y}\b", 0.5),
}
_DIGIT = re.compile(r"\d")
SCHEMA = "array<struct<raw:string,normalized:string,year:int,month:int,day:int,context:string,confidence:double,char_start:int,char_end:int,is_range:boolean,range_end:string>>"


def matches(text: Column, family: str) -> Column:
    """All matches of one family as strings; JVM regular expressions, nothing leaves generated code."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + FAMILIES[family][0]), F.lit(0))


def month_number(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, _SHORT)), F.lower(F.left(name, F.lit(3)))).cast("int")


def _parts(family: str, g: tuple[str, ...]) -> tuple[int, int | None, int | None, str | None] | None:
    month = lambda s: _SHORT.index(s[:3].lower()) + 1
    if family == "iso":
        return int(g[0]), int(g[1]), int(g[2]) if g[2] else None, None
    if family == "us":
        year = int(g[2]) + (2000 if int(g[2]) < 50 else 1900) if len(g[2]) == 2 else int(g[2])
        try:
            date(year, int(g[0]), int(g[1]))
        except ValueError:
            return None
        return year, int(g[0]), int(g[1]), None
    if family == "mdy":
        return int(g[2]), month(g[0]), int(g[1]), None
    if family == "dmy":
        return int(g[2]), month(g[1]), int(g[0]), None
    if family == "month":
        return int(g[1]), month(g[0]), None, None
    if family == "quarter":
        return int(g[1]), 3 * int(g[0]) - 2, None, None
    if family == "fiscal":
        return int(g[0]) + (2000 if len(g[0]) == 2 else 0), None, None, None
    if family == "season":
        return int(g[1]), SEASONS[g[0].lower()], None, None
    if family == "years":
        return int(g[0]), None, None, f"{int(g[1]):04d}"
    if family == "days":
        return int(g[3]), month(g[0]), int(g[1]), f"{int(g[3]):04d}-{month(g[0]):02d}-{int(g[2]):02d}"
    return int(g[0]), None, None, None


#: What a text must hold (in lower case) for a family to match at all, and the families that need the name of a month.
_NEEDS = {"iso": ("-", "/"), "us": ("/",), "quarter": ("q",), "fiscal": ("fy",), "season": tuple(SEASONS), "years": ("-", "–"), "days": ("-", "–")}
_NAMED = ("mdy", "dmy", "month", "days")
_HINTS = sorted({hint for hints in _NEEDS.values() for hint in hints})
_MONTH_NAME = re.compile("|".join(_SHORT))
_COMPILED = {family: (re.compile(pattern, re.IGNORECASE), confidence) for family, (pattern, confidence) in FAMILIES.items()}


def find(text: str) -> list[dict]:
    """Dates of one text after context and deduplication, by start."""
    if not _DIGIT.search(text):
        return []
    found, low = [], text.casefold()
    hinted = {hint for hint in _HINTS if hint in low}
    named = bool(_MONTH_NAME.search(low))
    for family, (pattern, confidence) in _COMPILED.items():
        if family in _NAMED and not named or family in _NEEDS and not hinted.intersection(_NEEDS[family]):
            continue
        for m in pattern.finditer(text):
            parts = _parts(family, m.groups())
            if parts is None:
                continue
            year, month, day, end = parts
            plain = "-".join(f"{x:0{w}d}" for x, w in ((year, 4), (month, 2), (day, 2)) if x is not None)
            window = text[max(0, m.start() - 50) : m.end() + 50].lower()
            context = next((c for c, p in CONTEXTS.items() if re.search(p, window)), None)
            preset = {"years": "project", "days": "event"}.get(family, "unknown")
            found.append({"raw": m[0], "normalized": plain, "year": year, "month": month, "day": day, "context": context or preset, "confidence": round(min(1.0, confidence + (0.1 if context else 0.0)), 6), "char_start": m.start(), "char_end": m.end(), "is_range": end is not None, "range_end": end})
    return deduplicate(found)


def deduplicate(found: list[dict]) -> list[dict]:
    """One date per cluster of overlapping spans: the most confident that starts within the first; then on past the cluster."""
    rows, out, until = sorted(found, key=lambda d: d["char_start"]), [], -1
    for at, row in enumerate(rows):
        if row["char_start"] < until:
            continue
        best, end = row, row["char_end"]
        first = at
        while first and rows[first - 1]["char_start"] == row["char_start"]:
            first -= 1
        for other in itertools.islice(rows, first, None):
            if other["char_start"] >= end:
                break
            if row["char_start"] <= other["char_start"] < row["char_end"]:
                if other["confidence"] > best["confidence"]:
                    best = other
                end = max(end, other["char_end"])
        out.append(best)
        until = end
    return out


def extract(rows: DataFrame, text: str = "text", column: str = "dates") -> DataFrame:
    """Adds the dates of each text; one Arrow pass."""
    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: find(t) if t else [])

    return rows.withColumn(column, run(F.col(text)))


def primary(dates: Column) -> Column:
    """The date of the best context, then granularity, then confidence; the first of equals.  Null without dates."""
    rank = lambda d: F.coalesce(*[F.when(d["context"] == c, F.lit(10 * p)) for c, p in PRIORITY.items()], F.lit(0)) + F.when(d["day"].isNotNull(), 20).when(d["month"].isNotNull(), 10).otherwise(0) + d["confidence"] * 10
    scored = F.transform(dates, lambda d, i: F.struct(rank(d).alias("score"), (-i).alias("back"), d.alias("date")))
    best = F.aggregate(scored, scored[0], lambda a, b: F.when((b["score"] > a["score"]), b).otherwise(a))
    return F.when(F.size(dates) > 0, best["date"])


def by_context(dates: Column, context: str) -> Column:
    return F.filter(dates, lambda d: d["context"] == context)


def vtt_seconds(stamp: Column) -> Column:
    """``HH:MM:SS.mmm`` or ``MM:SS.mmm`` in seconds."""
    parts = F.transform(F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":"), lambda p: p.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60 + p)


def clock(seconds: Column) -> Column:
    """``HH:MM:SS``, or ``MM:SS`` under an hour."""
    whole = F.floor(seconds).cast("int")
    short = F.format_string("%02d:%02d", F.floor(whole / 60).cast("int"), whole % 60)
    return F.when(whole >= 3600, F.format_string("%02d:%02d:%02d", F.floor(whole / 3600).cast("int"), F.floor(whole % 3600 / 60).cast("int"), whole % 60)).otherwise(short)


def month_of_filename(name: Column) -> Column:
    """A month by name, else by two digits after the year."""
    word = F.regexp_extract(name, rf"(?i)({_MONTHS})", 1)
    number = F.regexp_extract(name, r"20[12]\d[-_]?(0[1-9]|1[0-2])", 1)
    return F.coalesce(F.when(word != "", F.nullif(month_number(word), F.lit(0))), F.nullif(number, F.lit("")).cast("int"))


#: Indicators of temporal intent; the first three classes come before the years of a query, the last after.
INTENTS = {
    "historical": r"\b(history|historical|origin|founded|began)\b|\bhow did .* (start|begin|originate)\b|\bwhen was .* (created|founded|started)\b|\borigins? of\b",
    "future": r"\b(upcoming|scheduled|planning|will be|future|forthcoming)\b|\bnext (week|month|year|quarter|deadline|meeting|conference)\b|\bthis (week|month|year|quarter)\b|\bplanned for\b",
    "current": r"\b(current|currently|now|today|ongoing|active|present)\b|\bright now\b|\bat the moment\b",
    "past": r"\b(was|were|happened)\b|\blast (week|month|year|quarter)\b|\bprevious(ly)?\b|\bformer(ly)?\b",
}


def years_in(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))


def temporal_intent(query: Column, year: int) -> Column:
    """historical, future or current by words; else by the years named against ``year``; else past by words; else any."""
    test = lambda name: F.rlike(F.lower(query), F.lit(INTENTS[name]))
    years = F.transform(years_in(query), lambda y: y.cast("int"))
    some = F.size(years) > 0
    return (
        F.when(test("historical"), "historical").when(test("future"), "future").when(test("current"), "current")
        .when(some & F.forall(years, lambda y: y < year), "past").when(some & F.forall(years, lambda y: y > year), "future").when(F.array_contains(years, year), "current")
        .when(test("past"), "past").otherwise("any")
    )


def temporal_context(today: Column) -> Column:
    """The date, year and quarter as text."""
    quarter = F.concat(F.lit("Q"), F.quarter(today).cast("string"), F.lit(" "), F.year(today).cast("string"))
    return F.concat(F.lit("- Today's date: "), F.date_format(today, "MMMM dd, yyyy"), F.lit("\n- Current year: "), F.year(today).cast("string"), F.lit("\n- Current quarter: "), quarter)
