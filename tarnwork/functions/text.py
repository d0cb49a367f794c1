"""Text expressions: tokens, names, keys, types and citations."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the punctuation that the keyword tokenizer deletes.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Document types by words of a file name, first match first (serving rule, then ingest rule).
SERVING_TYPES = (("transcript", ("transcript",), (".vtt",)), ("proposal", ("proposal", "grant", "muri"), ()), ("cv", ("cv", "biosketch", "resume"), ()), ("newsletter", ("newsletter",), ()), ("meeting", ("meeting", "weekly"), ()), ("report", ("report",), ()))
INGEST_TYPES = (("transcript", ("transcript",), (".vtt", ".srt")), ("proposal", ("proposal", "grant", "muri", "submission"), ()), ("cv", ("cv", "biosketch", "resume"), ()), ("newsletter", ("newsletter",), ()), ("meeting", ("meeting", "weekly", "agenda"), ()), ("report", ("report",), ()), ("transcript", ("recording", "zoom", "gmt"), ()))
#: Acronyms of the query expander.
ACRONYMS = {"ai": "artificial intelligence", "ml": "machine learning", "nlp": "natural language processing", "llm": "large language model", "nsf": "national science foundation", "nih": "national institutes of health"}
#: Roles and venues of the audit.
FACULTY_ROLES, PHD_ROLES = ("Director", "Affiliate Faculty"), ("PhD Student",)
HIGH_SIGNAL_VENUES = ("science", "nature", "pnas", "proceedings of the national academy", "cell", "management science", "american sociological review", "administrative science quarterly")
TITLE_WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def each(rows: DataFrame, values: Column, name: str, *keep: str) -> DataFrame:
    """One row per value that is not null.  An inner explode would be preceded by a filter on the array's size, and so
    compute a costly array twice."""
    return rows.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def tokens(text: Column) -> Column:
    """Lower-case, without punctuation, split at white space, longer than two."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 2)


def normalize_query(text: Column, strip: str = "") -> Column:
    """Lower-case, trimmed, white space collapsed; ``strip`` characters go at both ends."""
    plain = F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")
    return F.trim(F.btrim(plain, F.lit(strip))) if strip else plain


def normalize_name(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), "-_", "  ")


def _typed(name: Column, rules: tuple) -> Column:
    out = None
    low = F.lower(name)
    for kind, words, ends in rules:
        test = any_of([low.contains(w) for w in words] + [low.endswith(e) for e in ends])
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def infer_doc_type(name: Column) -> Column:
    """Document type by the serving rule; a .pdf with ``paper`` is a paper."""
    low = F.lower(name)
    return _typed(name, SERVING_TYPES).when(low.endswith(".pdf") & low.contains("paper"), "paper").otherwise("other")


def detect_doc_type(name: Column) -> Column:
    """Document type by the wider ingest rule."""
    low = F.lower(name)
    return _typed(name, INGEST_TYPES).when(low.endswith(".pdf") & low.contains("paper"), "paper").otherwise("document")


def year_of_filename(name: Column) -> Column:
    """A year 2010-2029 in a name, else a fiscal year (two digits under 50 are 20xx); null if none."""
    plain, fiscal = F.regexp_extract(name, r"(20[12]\d)", 1), F.regexp_extract(F.upper(name), r"FY(\d{2})", 1)
    short = F.try_to_number(F.nullif(fiscal, F.lit("")), F.lit("99")).cast("int")
    return F.coalesce(F.nullif(plain, F.lit("")).cast("int"), F.when(short < 50, short + 2000).otherwise(short + 1900))


def glob_matches(name: Column, pattern: str) -> Column:
    """``*`` is any run of characters and only ``.`` is escaped; without ``*`` a plain substring."""
    low = pattern.lower()
    return F.rlike(F.lower(name), F.lit(low.replace(".", r"\.").replace("*", ".*"))) if "*" in low else F.lower(name).contains(low)


def citation(file: Column, timestamp: Column, page: Column, section: Column) -> Column:
    """``file / @time or p.N / §section``; ``Unknown`` without any."""
    where = F.when(F.coalesce(timestamp, F.lit("")) != "", F.concat(F.lit("@"), timestamp)).when(page.isNotNull(), F.concat(F.lit("p."), page.cast("string")))
    out = F.concat_ws(" / ", F.nullif(file, F.lit("")), where, F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("§"), section)))
    return F.when(out == "", "Unknown").otherwise(out)


def content_hash(value: Column) -> Column:
    return F.left(F.sha2(value, 256), F.lit(16))


def cache_key(*parts: Column) -> Column:
    """Hash of the non-empty parts joined by colons."""
    return content_hash(F.concat_ws(":", *[F.nullif(p, F.lit("")) for p in parts]))


def make_id(prefix: str, *parts: Column) -> Column:
    """A slug; above 60 characters its first 50 and a hash."""
    slug = F.concat_ws("-", F.lit(prefix), *[F.regexp_replace(F.lower(F.trim(p)), r"[^a-z0-9]+", "-") for p in parts])
    return F.when(F.length(slug) > 60, F.concat(F.left(slug, F.lit(50)), F.lit("-"), F.left(F.md5(slug), F.lit(8)))).otherwise(slug)


def stable_float(text: Column, low: float = -0.02, high: float = 0.02) -> Column:
    """A number in low..high that follows from the text."""
    unit = F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("double") / 4294967295.0
    return F.lit(low) + unit * (high - low)


def clean_key(doi: Column, title: Column) -> Column:
    """The lower-case DOI without its resolver, else the title's letters and digits."""
    plain = F.regexp_replace(F.lower(F.trim(doi)), r"^https?://(dx\.)?doi\.org/", "")
    return F.when(F.coalesce(plain, F.lit("")) != "", plain).otherwise(F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " ")))


def title_words(title: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(TITLE_WORD), F.lit(0)))


def compact_list(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda v: F.coalesce(F.trim(v), F.lit("")) != ""), "; ")


def similarity_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def expand_acronyms(query: str) -> list[str]:
    """The query, then one variant per acronym that is a word of it; the replacement is of substrings."""
    low = query.lower()
    return [query, *(low.replace(short, full) for short, full in ACRONYMS.items() if short in low.split())]


def acronym_variants(query: Column) -> Column:
    """``expand_acronyms`` of a column: an array of the query and its variants."""
    low = F.lower(query)
    words = F.split(low, r"\s+")
    more = [F.when(F.array_contains(words, short), F.replace(low, F.lit(short), F.lit(full))) for short, full in ACRONYMS.items()]
    return F.array_compact(F.array(query, *more))


def author_group(roles: Column, lab: str = "lab") -> Column:
    """Composition of a ``; ``-separated list of roles; ``lab`` is what the labels call the group."""
    all_roles = F.filter(F.transform(F.split(F.coalesce(roles, F.lit("")), ";"), lambda r: F.trim(r)), lambda r: r != "")
    count = lambda names: F.size(F.filter(all_roles, lambda r: r.isin(*names)))
    faculty, phd = count(FACULTY_ROLES), count(PHD_ROLES)
    core = faculty + phd
    return (
        F.when(core == 0, f"No {lab} core author").when((core == 1) & (phd == 1), "Solo PhD student").when((core == 1) & (faculty == 1), "Solo faculty")
        .when((faculty >= 2) & (phd == 0), "Faculty + Faculty").when((faculty >= 1) & (phd >= 1), "Mixed (faculty + PhD)").otherwise(f"Other {lab} author config")
    )


def sanitize(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of ``n`` successive words."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def chunk_filter(doc_type: str | None = None, year: int | None = None, file_pattern: str | None = None) -> Column:
    """Conjunction over the columns ``doc_type, date_year, source_file``: missing metadata is inferred from the file
    name, and a year that can't be inferred passes."""
    file, test = F.coalesce("source_file", F.lit("")), F.lit(True)
    if doc_type:
        test = test & (F.lower(F.coalesce(F.nullif(F.col("doc_type"), F.lit("")), infer_doc_type(file))) == doc_type.lower())
    if year:
        known = F.coalesce(F.nullif(F.col("date_year"), F.lit(0)), year_of_filename(file))
        test = test & (known.isNull() | (known == int(year)))
    if file_pattern:
        test = test & glob_matches(file, file_pattern)
    return test


def expand_synonyms(query: str, synonyms: dict[str, tuple[str, ...]], most: int = 2) -> list[str]:
    """The query, its acronym variants, and variants with one word replaced by each of its first synonyms; distinct."""
    out, words = expand_acronyms(query), query.lower().split()
    for i, word in enumerate(words):
        out += [" ".join([*words[:i], other, *words[i + 1 :]]) for other in synonyms.get(word, ())[:most]]
    return list(dict.fromkeys(out))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two strings; there is no JVM function for it."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def keyed_enrichment(name: Column, description: Column, table: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]]) -> Column:
    """Aliases and keywords of all patterns of ``table`` (regex -> category, aliases, keywords) that a name and its
    description match, and the first one's category."""
    low = F.lower(F.concat_ws(" ", name, description))
    array = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    hits = F.filter(F.array(*[F.when(F.rlike(low, F.lit(p)), F.struct(F.lit(c).alias("category"), array(a).alias("aliases"), array(k).alias("keywords"))) for p, (c, a, k) in table.items()]), lambda h: h.isNotNull())
    flat = lambda f: F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h[f]))))
    return F.struct(F.try_element_at(hits, F.lit(1))["category"].alias("category"), flat("aliases").alias("aliases"), flat("keywords").alias("keywords"))
