"""Secrets in texts: fixed patterns and a battery of randomness tests, in DataFrame functions only.

Three patterns give the base spans.  The battery looks at every run of 20 or more token
characters (letters, digits and ``+ / _ = -``).  The smallest alphabet that holds a run
is its encoding.  Three tests ask whether the run could be random in that alphabet: a
chi-squared test of uniform letters, a runs test about the alphabet's middle, and a test
of serial correlation.  A run that fails one of them at ``gate`` is none.  For the others
the chi-squared statistic is held against what ordinary words of the same length would
give (a non-central chi-squared whose shift follows from the length and from the chance
that two letters of a language are equal), so long runs need less to stand out than
short ones.  Digits and hexadecimal characters have no letters of a language: there, the
chance is that of ordinary numbers, and a hexadecimal run's changes between digits and
letters are held against those of words and numbers as well (Fisher's rule joins the two).
False discoveries are controlled at ``rate`` by the Benjamini-Hochberg rule
within each length band, over all candidates of the table; its counts are a histogram of
at most 4 * 401 rows, of which only the four thresholds reach the driver.

Offsets are code points, end exclusive.  They come from the lengths of the pieces between
the matches, summed in blocks, so a text of very many matches costs no square.

Defined cases: null text is empty; a document without spans has counts 0 and the digest
of an empty string; random runs inside a base span are not told again; repeated rows get
equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import shared_table

#: The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
RUN = r"[A-Za-z0-9+/_=-]{20,}"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the smallest alphabet on.
ENCODINGS = (
    (r"[0-9]+", _DIGITS), (r"[0-9a-f]+", _DIGITS + "abcdef"), (r"[0-9A-F]+", _DIGITS + "ABCDEF"), (r"[A-Z2-7]+", _UPPER + "234567"),
    (r"[a-z0-9]+", _DIGITS + _LOWER), (r"[A-Z0-9]+", _DIGITS + _UPPER), (r"[A-Za-z0-9]+", _DIGITS + _UPPER + _LOWER), (r".*", _DIGITS + _UPPER + _LOWER + "+/-_="),
)
#: The chance that two letters of an ordinary text are equal (public figure for European languages, low side).
COINCIDENCE = 0.065
#: The same by size for alphabets too small for a language: dates and round amounts filled up with zeros for the digits;
#: for hexadecimal ones half such digits and half words of the letters a to f (0.26 by English frequencies).
SMALL = {10: 0.2, 16: 0.115}
#: The chance that an ordinary hexadecimal run goes over from digits to letters or back at a place: pieces of five characters.
SWITCH = 0.2
BANDS = (32, 48, 96)
_BLOCK = 200
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _running(lengths: Column) -> Column:
    """Sums of all lengths before each one."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    grow = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    bases = F.aggregate(F.transform(blocks, total), F.array(F.lit(0)), grow)
    parts = F.transform(blocks, lambda xs, b: F.slice(F.aggregate(xs, F.array(F.element_at(bases, b + 1)), grow), F.lit(1), F.size(xs)))
    return F.flatten(parts)


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<start,end,value>>`` of all matches; value is the group."""
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    sizes = F.zip_with(pieces, whole, lambda p, m: F.length(p) + F.length(m))
    ends = F.zip_with(_running(sizes), sizes, lambda before, size: before + size)
    found = F.zip_with(ends, whole, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end")))
    found = F.zip_with(found, value, lambda at, v: F.struct(at["start"].alias("start"), at["end"].alias("end"), v.alias("value")))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _normal(z: Column) -> Column:
    """Standard normal distribution function (logistic form, error under 2e-4)."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def _switches(pairs: Column) -> Column:
    """The chance of so many changes between unequal neighbours, or more, at the rate ``SWITCH`` (signed root of the deviance)."""
    n = F.size(pairs)
    rate = F.greatest(F.aggregate(pairs, F.lit(-0.5), lambda s, ab: s + F.abs(ab["a"] - ab["b"])) / n, F.lit(1e-9))
    deviance = 2 * n * (rate * F.log(rate / SWITCH) + (1 - rate) * F.log((1 - rate) / (1 - SWITCH)))
    return 1 - _normal(F.signum(rate - SWITCH) * F.sqrt(deviance))


def battery(runs: DataFrame, gate: float) -> DataFrame:
    """Adds ``p`` to rows with a string ``value``: the chance that ordinary words of its length look as uniform
    as it does; 1 if one of the tests refuses randomness at ``gate``."""
    value = F.col("value")
    alphabet = F.coalesce(*[F.when(F.rlike(value, F.lit(rf"\A{p}\z")), F.lit(a)) for p, a in ENCODINGS])
    runs = runs.withColumn("alphabet", alphabet)
    runs = runs.withColumn("x", F.transform(F.split("value", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double")))
    runs = runs.withColumn("n", F.size("x").cast("double")).withColumn("m", F.length("alphabet").cast("double"))
    counts = F.transform(F.array_distinct(F.split("value", "")), lambda c: (F.length("value") - F.length(F.replace("value", c, F.lit("")))).cast("double"))
    runs = runs.withColumn("chi", F.col("m") / F.col("n") * F.aggregate(counts, F.lit(0.0), lambda a, k: a + k * k) - F.col("n"))
    df = F.col("m") - 1
    p_chi = 1 - _normal((F.pow(F.col("chi") / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    runs = runs.withColumn("p_chi", p_chi)
    # Runs about the middle of the alphabet.
    runs = runs.withColumn("high", F.transform("x", lambda v: (v > F.col("m") / 2).cast("double")))
    pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    turns = F.aggregate(pairs(F.col("high")), F.lit(1.0), lambda s, ab: s + F.abs(ab["a"] - ab["b"]))
    runs = runs.withColumn("up", F.aggregate("high", F.lit(0.0), lambda a, v: a + v)).withColumn("turns", turns)
    both = 2 * F.col("up") * (F.col("n") - F.col("up"))
    spread = both * (both - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    z_runs = F.when(spread > 0, (F.col("turns") - both / F.col("n") - 1) / F.sqrt(spread)).otherwise(F.lit(12.0))
    runs = runs.withColumn("p_runs", 2 * (1 - _normal(F.abs(z_runs))))
    # Correlation of neighbours.
    runs = runs.withColumn("mean", _mean(F.col("x")))
    squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    products = F.aggregate(pairs(F.col("x")), F.lit(0.0), lambda s, ab: s + (ab["a"] - F.col("mean")) * (ab["b"] - F.col("mean")))
    z_serial = F.when(squares > 0, (products / squares + 1 / F.col("n")) * F.sqrt("n")).otherwise(F.lit(12.0))
    runs = runs.withColumn("p_serial", 2 * (1 - _normal(F.abs(z_serial))))
    equal = F.coalesce(*[F.when(F.col("m") == m, F.lit(c)) for m, c in SMALL.items()], F.lit(COINCIDENCE))
    shift = (F.col("m") * equal - 1) * F.col("n")
    ratio = 2 * (df + 2 * shift) / (9 * (df + shift) * (df + shift))
    p = _normal((F.pow(F.col("chi") / (df + shift), 1 / 3) - (1 - ratio)) / F.sqrt(ratio))
    both = p * _switches(pairs(F.transform("x", lambda v: (v > 10).cast("double"))))
    p = F.when(F.col("m") == 16, both * (1 - F.log(both))).otherwise(p)
    fair = (F.col("p_chi") >= gate) & (F.col("p_runs") >= gate) & (F.col("p_serial") >= gate)
    fair &= (F.col("p_chi") <= 1 - gate) | ~F.col("m").isin(*SMALL)  # counters use few letters too evenly
    return runs.withColumn("p", F.when(fair, p).otherwise(F.lit(1.0)))


def _thresholds(candidates: DataFrame, rate: float) -> dict[int, float]:
    """Benjamini-Hochberg in each band on a histogram of -log10 p: the largest p that may pass."""
    bins = candidates.groupBy("band", F.least(F.floor(-20 * F.log10("p")), F.lit(400)).cast("int").alias("bin")).agg(F.count("*").alias("k"))
    out: dict[int, float] = {}
    counts: dict[int, dict[int, int]] = {}
    for band, b, k in bins.collect():
        counts.setdefault(band, {})[b] = k
    for band, of in counts.items():
        total, passed = sum(of.values()), 0
        for b in sorted(of, reverse=True):
            passed += of[b]
            most = 10 ** (-b / 20)  # the largest p of the bin
            if b and most <= rate * passed / total:
                out[band] = most
    return out


def scan(docs: DataFrame, rate: float = 0.01, gate: float = 1e-3) -> DataFrame:
    """Rows ``(doc_id, base, spans)``: arrays of (start, kind, end), kind being a place in ``KINDS``; ``spans`` has
    the base spans and the random runs, by start and kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    assign = F.filter(_matches(F.col("text"), ASSIGN, 2), lambda m: F.length(m["value"]) >= 6)
    access = F.filter(_matches(F.col("text"), ACCESS), lambda m: m["end"] - m["start"] >= 20)
    base = F.array_sort(F.concat(_spans(assign, 0), _spans(access, 1), _spans(_matches(F.col("text"), HEX), 2)))
    found = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), base.alias("base"), _matches(F.col("text"), RUN).alias("runs"))
    found = shared_table(found, "secrets")
    runs = found.select("row", "base", F.explode("runs").alias("run")).select("row", "base", "run.*")
    runs = runs.where(~F.exists("base", lambda s: (s["start"] <= F.col("start")) & (F.col("end") <= s["end"])))
    length = F.length("value")
    band = sum(((length >= b).cast("int") for b in BANDS), F.lit(0))
    runs = battery(runs.select("row", "start", "end", "value", band.alias("band")), gate).select("row", "start", "end", "band", "p")
    runs = shared_table(runs, "runs")
    most = _thresholds(runs, rate)
    limit = F.coalesce(*[F.when(F.col("band") == b, F.lit(p)) for b, p in sorted(most.items())], F.lit(-1.0))
    random = runs.where(F.col("p") <= limit).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("random"))
    spans = F.array_sort(F.concat("base", F.coalesce("random", F.array().cast(_SPAN))))
    return found.join(random, "row", "left").select("doc_id", "base", spans.alias("spans"))


def told(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the base spans' digest and all spans as one string."""
    count = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)], count(F.col("spans"), 3).alias("n_random"), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
