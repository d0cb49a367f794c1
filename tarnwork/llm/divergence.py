"""How the sources of a language diverge in their words: an audit of term probabilities.

1. One pass counts terms where the texts lie: a task keeps partial counts of (language, source, term) and gives them
   out whenever it holds many, so a text's words never leave their task one by one and memory is bounded.  Sums by
   (language, source, term) are the only shuffle that grows with the corpus, and it grows with distinct terms.
2. A language keeps the terms of at least ``least_docs`` of its documents.  Term t has p = 1 + floor(10^9 (count + 2) /
   (N + 2 V)) in a group and q likewise in its language; it says f = floor((p - q)^2 / (p + q)).  All arithmetic is in
   integers (decimals where a product passes 2^63).
3. Upper-bound term search: a group's terms lie in buckets of near equal counts.  A bucket's largest count gives its
   largest p, and the smallest count in the language among its terms its smallest q; f of these two bounds f of all its
   terms.  Buckets are evaluated best first, a wave (1, 2, 4, ... buckets of each group) at a time; a group ends once
   the bound of its best bucket not yet seen is strictly below its k-th value.  At most ``k`` rows a group pass
   between waves, and a group has some hundred buckets at most, so the number of waves is small and fixed.
4. Pairs come from postings.  Terms that neither source of a pair has say all the same; those that one has depend on
   its count alone, so the histogram of a group's counts sums them; only terms that both have need the two counts, and
   these meet in the term's posting list.  A task sums postings over its terms in numpy blocks and gives out one partial sum
   a pair, so that the rows that arise grow with the pairs of the result and not with the terms.

The result itself holds every ordered pair of sources of a language; that is the question's, not the method's.

Defined cases: null text, lang and source are empty strings; a text without terms counts for its group's being there;
repeated rows count each; a language without kept terms has pairs of value 0 and no terms; one source alone has no
pairs; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import shared_table

SCALE = 1_000_000_000
#: Bytes that belong to terms stay (A-Z lower-cased), all others are white space: a UTF-8 text is cut by bytes.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FLUSH = 300_000
_PIECE = 1 << 22
_PARTIAL = "lang string, source string, term binary, n long, d long"
_CELLS = 1 << 21


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time; a piece ends between terms."""
    raw = raw.translate(_BYTES)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple, dict[bytes, list[int]]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in groups.items():
            keys = list(terms)
            for i in range(0, len(keys), 20_000):
                some = keys[i : i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()), pa.array([terms[t][0] for t in some], pa.int64()), pa.array([terms[t][1] for t in some], pa.int64())],
                    ["lang", "source", "term", "n", "d"],
                )
            if not keys:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.array([None], pa.binary()), pa.array([0], pa.int64()), pa.array([0], pa.int64())], ["lang", "source", "term", "n", "d"])

    for batch in batches:
        text, lang, source = batch.columns
        for i in range(batch.num_rows):
            group = (lang[i].as_py(), source[i].as_py())
            held += group not in groups
            terms = groups.setdefault(group, {})
            counts: Counter = Counter()
            for words in _pieces(text[i].as_py()):
                counts.update(words)
            before = len(terms)
            for term, n in counts.items():
                row = terms.get(term)
                if row is None:
                    terms[term] = [n, 1]
                else:
                    row[0] += n
                    row[1] += 1
            held += len(terms) - before
            if held > _FLUSH:
                yield from out()
                groups, held = {}, 0
    yield from out()


def count_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, d)``: occurrences and documents of each term of each group, whole texts; a row of a
    null term for each group."""
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    rows = docs.select(empty("text").cast("binary").alias("text"), empty("lang"), empty("source"))
    parts = rows.mapInArrow(_partial_counts, _PARTIAL).withColumn("term", F.col("term").cast("string"))
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exactly; null where nothing is kept."""
    above = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)")
    below = (total + 2 * kept).cast("decimal(20,0)")
    return F.when(kept > 0, F.call_function("div", above, below) + 1)


def says(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def bucket(count: Column) -> Column:
    """Counts up to 16 alone, above them sixteen buckets to a doubling."""
    return F.when(count <= 16, count).otherwise(F.floor(F.log2(count.cast("double")) * 16)).cast("int")


def top_terms(kept: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """``(lang, source, item, value)``: the ``k`` terms of each group that say most among those with p > q.

    ``kept(lang, source, term, n, lang_n)`` has the counts above 0, ``groups(lang, source, total, lang_total, vocabulary)``
    the sums.
    """
    key = ["lang", "source"]
    rows = shared_table(kept.withColumn("bucket", bucket(F.col("n"))), "divergence_terms")
    ends = rows.groupBy(*key, "bucket").agg(F.max("n").alias("most"), F.min("lang_n").alias("least")).join(groups, key)
    p = probability(F.col("most"), F.col("total"), F.col("vocabulary"))
    q = probability(F.col("least"), F.col("lang_total"), F.col("vocabulary"))
    order = Window.partitionBy(*key).orderBy(F.desc("bound"), "bucket")
    ends = ends.withColumn("p", p).withColumn("q", q).where("p > q").withColumn("bound", says(F.col("p"), F.col("q")))
    ends = ends.withColumn("place", F.row_number().over(order))
    ends = shared_table(ends.select(*key, "bucket", "place", "bound", "total", "lang_total", "vocabulary"), "divergence_buckets")
    best = Window.partitionBy(*key).orderBy(F.desc("value"), "item")
    found, open_, first, width = None, ends, 1, 1
    while True:
        wave = open_.where(F.col("place").between(first, first + width - 1))
        p = probability(F.col("n"), F.col("total"), F.col("vocabulary"))
        q = probability(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
        told = rows.join(wave, [*key, "bucket"]).withColumn("p", p).withColumn("q", q).where("p > q")
        told = told.select(*key, F.col("term").alias("item"), says(F.col("p"), F.col("q")).alias("value"))
        told = told.unionByName(found) if found is not None else told
        found = told.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).drop("k")
        found = shared_table(found, "divergence_found")
        first, width = first + width, width * 2
        kth = found.groupBy(*key).agg(F.when(F.count("*") >= k, F.min("value")).alias("kth"))
        unseen = open_.where(F.col("place") >= first)
        top = unseen.groupBy(*key).agg(F.max("bound").alias("top")).join(kth, key, "left").where("kth IS NULL OR top >= kth").select(*key)
        open_ = shared_table(unseen.join(top, key, "left_semi"), "divergence_open")
        if open_.isEmpty():
            return found


def _posting_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums over the terms that both sources of a pair have; a term's rows come one after another."""
    names: dict[tuple, int] = {}
    pending: list[tuple[np.ndarray, ...]] = []
    sums: dict[int, np.ndarray] = {}
    cells = 0

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // (p + q)

    def block(ids: np.ndarray, p: np.ndarray, base: np.ndarray) -> None:
        """``ids``, ``p``, ``base``: a row per term, a column per source that has it, sources ascending."""
        i, j = np.triu_indices(ids.shape[1], 1)
        a, b = ids[:, i], ids[:, j]
        value = f(p[:, i], p[:, j]) - f(p[:, i], base[:, j]) - f(base[:, i], p[:, j])
        keys, places = np.unique((np.minimum(a, b) << 32 | np.maximum(a, b)).ravel(), return_inverse=True)
        total = np.zeros((2, len(keys)), dtype=np.int64)
        np.add.at(total[0], places.ravel(), 1)
        np.add.at(total[1], places.ravel(), value.ravel())
        for key, n, v in zip(keys.tolist(), total[0].tolist(), total[1].tolist(), strict=True):
            row = sums.get(key)
            if row is None:
                sums[key] = [n, v]
            else:
                row[0] += n
                row[1] += v

    def settle() -> None:
        by_size: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for term in pending:
            by_size.setdefault(len(term[0]), []).append(term)
        for size, terms in by_size.items():
            step = max(1, _CELLS // (size * size))
            for at in range(0, len(terms), step):
                block(*(np.stack(x) for x in zip(*terms[at : at + step], strict=True)))
        pending.clear()

    def out() -> Iterator[pa.RecordBatch]:
        label = list(names)
        items = list(sums.items())
        for at in range(0, len(items), 50_000):
            some = items[at : at + 50_000]
            left, right = [label[key >> 32] for key, _ in some], [label[key & 0xFFFFFFFF] for key, _ in some]
            turned = [x[1] > y[1] for x, y in zip(left, right, strict=True)]
            one = [y[1] if t else x[1] for x, y, t in zip(left, right, turned, strict=True)]
            two = [x[1] if t else y[1] for x, y, t in zip(left, right, turned, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in left]), pa.array(one), pa.array(two), pa.array([v[0] for _, v in some], pa.int64()), pa.array([v[1] for _, v in some], pa.int64())], ["lang", "one", "two", "n", "value"])

    last, held = None, []

    def close() -> int:
        if len(held) > 1:
            pending.append(tuple(np.array(x, dtype=np.int64) for x in zip(*held, strict=True)))
        return len(held) ** 2

    for batch in batches:
        for lang, term, source, p, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lang, term) != last:
                cells += close()
                held, last = [], (lang, term)
                if cells > _CELLS:
                    settle()
                    cells = 0
                if len(sums) > _CELLS:
                    settle()
                    yield from out()
                    sums.clear()
            held.append((names.setdefault((lang, source), len(names)), p, base))
    close()
    settle()
    yield from out()


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every ordered pair of sources of a language."""
    key = ["lang", "source"]
    with_p = kept.join(groups.select(*key, "total", "vocabulary", "base"), key).withColumn("p", probability(F.col("n"), F.col("total"), F.col("vocabulary")))
    posts = with_p.select("lang", "term", "source", "p", "base").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = posts.mapInArrow(_posting_sums, "lang string, one string, two string, n long, value long").groupBy("lang", "one", "two").agg(F.sum("n").alias("both"), F.sum("value").alias("shared"))
    steps = with_p.groupBy(*key, "p").agg(F.count("*").alias("n")).groupBy(*key).agg(F.collect_list(F.struct("p", "n")).alias("steps"), F.sum("n").alias("terms"))
    sides = groups.join(steps, key, "left").select("lang", "source", "vocabulary", "base", F.coalesce("terms", F.lit(0)).alias("terms"), "steps")
    side = lambda name: F.struct("source", "base", "terms", "steps").alias(name)
    pairs = sides.select("lang", "vocabulary", side("a")).join(sides.select("lang", side("b")), "lang").where("a.source < b.source")

    def alone(steps: Column, base: Column) -> Column:
        return F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x["n"] * says(x["p"], base)), F.lit(0))

    pairs = pairs.join(both, (pairs["lang"] == both["lang"]) & (F.col("a.source") == F.col("one")) & (F.col("b.source") == F.col("two")), "left").drop(both["lang"])
    shared, n = F.coalesce("shared", F.lit(0)), F.coalesce("both", F.lit(0))
    neither = (F.col("vocabulary") - F.col("a.terms") - F.col("b.terms") + n) * says(F.col("a.base"), F.col("b.base"))
    value = F.when(F.col("vocabulary") > 0, alone(F.col("a.steps"), F.col("b.base")) + alone(F.col("b.steps"), F.col("a.base")) + neither + shared).otherwise(F.lit(0))
    pairs = pairs.select("lang", F.col("a.source").alias("left"), F.col("b.source").alias("right"), value.cast("long").alias("value"))
    turn = F.explode(F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("item")), F.struct(F.col("right").alias("source"), F.col("left").alias("item"))))
    return pairs.select("lang", "value", turn.alias("x")).select("lang", "x.source", "x.item", "value")


def audit(docs: DataFrame, least_docs: int = 10, k: int = 10) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for each group every other source of its language (part ``pair``) and
    the ``k`` terms that set it apart from the language (part ``term``)."""
    counts = shared_table(count_terms(docs), "divergence_counts")
    words = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("d")).where(F.col("d") >= least_docs).drop("d")
    kept = shared_table(counts.where("term IS NOT NULL").drop("d").join(words, ["lang", "term"]), "divergence_kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = words.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("vocabulary"))
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "vocabulary")))
    groups = shared_table(groups.withColumn("base", probability(F.lit(0).cast("long"), F.col("total"), F.col("vocabulary"))), "divergence_groups")
    rows = pair_values(kept, groups).withColumn("part", F.lit("pair")).unionByName(top_terms(kept, groups.drop("base"), k).withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", "part", "item", "value", rank.cast("int").alias("rank"))
