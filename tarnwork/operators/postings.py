"""A stored keyword index: postings by term and segment, upper bounds beside them, searches that stop early.

A version of the index is a batch of documents cut into segments of about ``block`` documents.  A row of the postings is
one term of one segment: its documents with their frequencies and lengths, and beside them the largest frequency and the
smallest length, which bound what the term can score there.  Postings are bucketed and sorted by term, so a query
reads the buckets of its words only; bounds are columns of their own, so a segment's postings are read only if the segment
can still matter.

A search sums the bounds of its words by segment, scores the segments of highest bound for a first k-th score, and then
those of all others whose bound is not below it.  That is exact: what is left out is strictly below.

Versions count once their mark is there.  A document that comes again, or is removed, is struck out of the versions before; ``compact``
writes one version of what counts.  Defined cases: null text has no terms and length 0; of rows with one id in a batch the
one of smallest text counts; rows without an id are not indexed.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..streaming.files import mark, marked, remove
from .retrieval import EPSILON, K1, B, query_tokens

#: Bounds are sums in another order than scores; this is more than that can differ by.
_SLACK = 1 + 1e-9
#: Words of a corpus for one bucket of its postings, and segments that are made in one task.
_BUCKET, _TOGETHER = 1_000_000, 4


def part(tf: Column, dl: Column, mean: float) -> Column:
    """What a term's frequency in a document of that length counts; grows with tf, falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean)))


def inverse(n: int, df: int) -> float:
    return math.log(n - df + 0.5) - math.log(df + 0.5)


class Postings:
    def __init__(self, spark: SparkSession, folder: str, id_column: str = "doc_id", buckets: int = 32, block: int = 256) -> None:
        self.spark, self.folder, self.id, self.buckets, self.block = spark, folder.rstrip("/"), id_column, buckets, block
        self._told: dict[tuple, object] = {}  # numbers of the whole corpus, by the versions that they are of

    def _at(self, version: int, table: str) -> str:
        return f"{self.folder}/v{version}/{table}"

    def versions(self) -> list[int]:
        return marked(self.spark, self.folder)

    def _name(self, version: int) -> str:
        return "postings_" + hashlib.sha256(self._at(version, "postings").encode()).hexdigest()[:16]

    def _bucketed(self, version: int) -> DataFrame:
        """The postings of a version as a bucketed table; the catalog of a new session learns of it here."""
        name = self._name(version)
        if not self.spark.catalog.tableExists(name):
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(self._at(version, "postings")).schema)
            place = self._at(version, "postings")
            self.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (term) SORTED BY (term) INTO {self._wide(version)} BUCKETS LOCATION '{place}'")
        return self.spark.table(name).withColumn("version", F.lit(version))

    def _documents(self) -> DataFrame:
        """All documents of all versions, struck out ones too."""
        parts = [self.spark.read.parquet(self._at(v, "documents")).withColumn("version", F.lit(v)) for v in self.versions()]
        return reduce(DataFrame.unionByName, parts)

    def _struck(self) -> DataFrame | None:
        """``(id, version)`` of documents that a later version has again or removes; nothing where there is one version."""
        if len(self.versions()) < 2:
            return None
        rows = self._documents()
        last = rows.groupBy("id").agg(F.max("version").alias("last"))
        return rows.where("not removed").join(last, "id").where("version < last").select("id", "version")

    def _wide(self, version: int) -> int:
        """Buckets of a version: ``buckets``, or one for each ``_BUCKET`` words if those are more, so that none grows with the corpus."""
        key = ("wide", version)
        if key not in self._told:
            words = self.spark.read.parquet(self._at(version, "documents")).agg(F.sum("dl")).first()[0] or 0
            self._told[key] = max(self.buckets, -(-words // _BUCKET))
        return self._told[key]

    def _write(self, counts: DataFrame, version: int) -> None:
        """Postings of ``counts(term, segment, id, tf, dl)``; a row holds at most a segment's documents.  The documents of
        the version are written before."""
        docs = F.array_sort(F.collect_list(F.struct("id", "tf", "dl"))).alias("docs")
        rows = counts.groupBy("term", "segment").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("dl").alias("shortest"), docs)
        name = self._name(version)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._told.pop(("wide", version), None)
        wide = self._wide(version)
        writer = rows.repartition(wide, "term").write.mode("overwrite").bucketBy(wide, "term").sortBy("term")
        writer.option("path", self._at(version, "postings")).saveAsTable(name)

    def add(self, docs: DataFrame) -> None:
        """A version of ``docs(id, text)``; known ids are replaced."""
        flat = docs.select(F.col(self.id).alias("id"), "text").where(F.col("id").isNotNull())
        n = flat.count()
        new = max(self.versions(), default=0) + 1
        segments = max(1, -(-n // self.block))
        # A segment's documents are brought together as texts; its postings then arise where it lies, and only they are shuffled.
        parts = max(self.spark.sparkContext.defaultParallelism, -(-segments // _TOGETHER))
        once = flat.withColumn("segment", F.pmod(F.xxhash64("id"), F.lit(segments))).repartition(parts, "segment").groupBy("segment", "id").agg(F.min("text").alias("text"))
        words = once.select("id", "segment", T.tokens(F.col("text")).alias("words"))
        words.select("id", "segment", F.size("words").alias("dl"), F.lit(False).alias("removed")).write.mode("overwrite").parquet(self._at(new, "documents"))
        counts = T.each(words.withColumn("dl", F.size("words")), F.col("words"), "term", "id", "segment", "dl").groupBy("segment", "id", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
        self._write(counts, new)
        mark(self.spark, f"{self.folder}/v{new}")

    def remove(self, ids: DataFrame) -> None:
        """Strike out documents; ids that are not indexed change nothing."""
        new = max(self.versions(), default=0) + 1
        gone = ids.select(F.col(self.id).alias("id")).distinct()
        gone.select("id", F.lit(None).cast("long").alias("segment"), F.lit(0).alias("dl"), F.lit(True).alias("removed")).write.mode("overwrite").parquet(self._at(new, "documents"))
        mark(self.spark, f"{self.folder}/v{new}")

    def _with_postings(self) -> list[int]:
        return [v for v in self.versions() if not self.spark.read.parquet(self._at(v, "documents")).where("not removed").isEmpty()]

    def postings(self, words: list[str] | None = None) -> DataFrame:
        """Rows ``(term, segment, n, most, shortest, docs, version)`` of the words, from their buckets alone."""
        rows = reduce(DataFrame.unionByName, [self._bucketed(v) for v in self._with_postings()])
        return rows.where(F.col("term").isin(*words)) if words is not None else rows

    def _living(self, rows: DataFrame) -> DataFrame:
        """Postings one by one ``(term, id, tf, dl)``, without documents that are struck out."""
        single = rows.select("term", "version", F.explode("docs").alias("d")).select("term", "version", "d.*")
        struck = self._struck()
        return single if struck is None else single.join(struck, ["id", "version"], "left_anti")

    def statistics(self, words: list[str]) -> dict:
        """Documents, mean length and document frequencies, from the lengths and from the counts beside the postings."""
        docs = self._documents().where("not removed")
        struck = self._struck()
        if struck is not None:
            docs = docs.join(struck, ["id", "version"], "left_anti")
        key = ("lengths", *self.versions())
        if key not in self._told:
            self._told[key] = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
        row = self._told[key]
        counted = self.postings(words).groupBy("term").agg(F.sum("n").alias("df")) if struck is None else self._living(self.postings(words)).groupBy("term").agg(F.count("*").alias("df"))
        return {"n": row["n"], "mean": row["mean"] or 0.0, "df": {r.term: r.df for r in counted.collect()}}  # the words of one query

    def mean_inverse(self, n: int) -> float:
        """The mean over the whole vocabulary, from the counts beside the postings."""
        rows = self.postings()
        seen = rows.groupBy("term").agg(F.sum("n").alias("df")) if self._struck() is None else self._living(rows).groupBy("term").agg(F.count("*").alias("df"))
        key = ("mean", n, *self.versions())
        if key not in self._told:
            self._told[key] = seen.agg(F.avg(F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0] or 0.0
        return self._told[key]

    def weights(self, query: str) -> tuple[dict[str, float], float]:
        """What each indexed word of a query counts, and the mean length."""
        counts = Counter(query_tokens(query))
        if not self._with_postings():
            return {}, 0.0
        stats = self.statistics(list(counts))
        idf = {w: inverse(stats["n"], df) for w, df in stats["df"].items() if df}
        if any(x < 0 for x in idf.values()):
            floor = EPSILON * self.mean_inverse(stats["n"])
            idf = {w: x if x >= 0 else floor for w, x in idf.items()}
        return {w: counts[w] * x for w, x in idf.items()}, stats["mean"]

    def _weight(self, weights: dict[str, float]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("term"))

    def scores(self, query: str) -> DataFrame:
        """``(id, bm25)`` of every document that has a word of the query."""
        weights, mean = self.weights(query)
        return self._scored(self.postings(list(weights)), weights, mean) if weights else self._nothing()

    def _nothing(self) -> DataFrame:
        kind = dict(self._documents().dtypes)["id"] if self.versions() else "bigint"
        return self.spark.createDataFrame([], f"`{self.id}` {kind}, bm25 double")

    def _scored(self, rows: DataFrame, weights: dict[str, float], mean: float) -> DataFrame:
        value = self._weight(weights) * part(F.col("tf"), F.col("dl"), mean)
        return self._living(rows).groupBy(F.col("id").alias(self.id)).agg(F.sum(value).alias("bm25"))

    def bounds(self, weights: dict[str, float], mean: float) -> DataFrame:
        """``(version, segment, bound)``: no document of the segment scores more."""
        value = F.greatest(F.lit(0.0), self._weight(weights) * part(F.col("most"), F.col("shortest"), mean))
        return self.postings(list(weights)).groupBy("version", "segment").agg((F.sum(value) * _SLACK).alias("bound"))

    def search(self, query: str, k: int, digits: int = 6, first: int = 16) -> DataFrame:
        """The k best positive scores, divided by the largest: ``(id, score)``."""
        weights, mean = self.weights(query)
        if not weights:
            return self._nothing().select(self.id, F.col("bm25").alias("score"))
        rows, key = self.postings(list(weights)), ["version", "segment"]
        bounds = self.bounds(weights, mean)
        order = (F.desc("bm25"), F.col(self.id))
        wave = bounds.orderBy(F.desc("bound"), *key).limit(first).select(*key)
        found = self._scored(rows.join(F.broadcast(wave), key, "left_semi"), weights, mean).orderBy(*order).limit(k).collect()  # ``first`` segments, k rows
        kth = found[-1]["bm25"] if len(found) == k else 0.0
        open_ = bounds.where(F.col("bound") >= kth).select(*key)
        best = self._scored(rows.join(open_, key, "left_semi"), weights, mean).where("bm25 > 0").orderBy(*order).limit(k)
        most = max((r["bm25"] for r in found), default=0.0)
        if len(found) < k or open_.count() > first:
            most = best.agg(F.max("bm25")).first()[0] or 0.0
        return best.select(self.id, F.round(F.col("bm25") / F.lit(most or 1.0), digits).alias("score"))

    def compact(self) -> None:
        """One version of all that counts; those before it go."""
        old = self.versions()
        if not old:
            return
        docs, struck = self._documents().where("not removed"), self._struck()
        if struck is not None:
            docs = docs.join(struck, ["id", "version"], "left_anti")
        living = self._living(self.postings()) if self._with_postings() else None
        n, new = docs.count(), old[-1] + 1
        segment = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // self.block))))
        docs.select("id", segment.alias("segment"), "dl", "removed").write.mode("overwrite").parquet(self._at(new, "documents"))
        if living is not None:
            parts = max(self.spark.sparkContext.defaultParallelism, -(-n // (self.block * _TOGETHER)))
            self._write(living.withColumn("segment", segment).repartition(parts, "segment"), new)
        mark(self.spark, f"{self.folder}/v{new}")
        for version in old:
            remove(self.spark, f"{self.folder}/v{version}")
