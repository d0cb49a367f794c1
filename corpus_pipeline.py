"""A corpus pipeline of five operators; each stage's Parquet is the next one's ``docs``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm._shared import reachable, shared_table
from tarnwork.llm.language_id import UNKNOWN, fit, held_out, known_runs, tag
from tarnwork.llm.near_dedup import near_duplicates
from tarnwork.llm.packing import pack
from tarnwork.llm.pii import redact_column
from tarnwork.llm.queries import PII_KEY
from tarnwork.llm.substring_dedup import remove_repeats

#: Words of a passage that goes when it repeats.
PASSAGE = 50


def _plain(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with names of our own for the columns that no stage reads, whatever they are called, and the way back."""
    names = docs.columns
    rows = docs.toDF(*[n if n in ("doc_id", "text", "lang", "n_chars") else f"_{i}" for i, n in enumerate(names)])
    return rows, lambda out: out.select(*rows.columns).toDF(*names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no learned language: those without a letter, and those most of whose runs of two and three
    letters are in no labelled text of the sample.  A null ``lang`` becomes the prediction.

    Texts of few letters are too short to tell and stay.  Null and empty texts go; where nothing can be learned (no labelled
    row) all go; an empty table stays empty; columns may have any names.
    """
    reachable(spark)
    rows, back = _plain(docs)
    learnable = ~held_out(F.col("doc_id"))
    told = tag(rows, fit(rows, learnable), "_told", known_runs(rows, learnable)).where(F.col("_told") != UNKNOWN)
    return back(told.withColumn("lang", F.coalesce("lang", "_told")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near duplicates (5-word shingles, similarity 0.8).

    Texts without words are no one's duplicates and stay; so do rows without a doc_id; rows of one doc_id
    stay or go together; an empty table stays empty; columns may have any names.
    """
    reachable(spark)
    rows, back = _plain(docs)
    gone = near_duplicates(rows, words=5, percent=80).where("not kept").select("doc_id").distinct()
    return back(rows.join(gone.hint("merge"), "doc_id", "left_anti"))


def _chars(rows: DataFrame) -> DataFrame:
    """With ``n_chars`` as the text now is, where there is such a column."""
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in rows.columns else rows


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words and more that start earlier out of the texts; other texts stay as they are.

    A text of which all words go stays as an empty one; null texts stay null; rows without a doc_id come before
    all others; an empty table stays empty; columns may have any names.
    """
    reachable(spark)
    rows, back = _plain(docs)
    return back(_chars(remove_repeats(rows, words=PASSAGE, keep=True)))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in the place of personal data.

    Null and empty texts stay; equal rows stay equal; no row goes or comes; an empty table stays empty; columns may
    have any names.
    """
    reachable(spark)
    rows, back = _plain(docs)
    return back(_chars(redact_column(rows, PII_KEY)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens.

    Null and empty texts are one closing token; equal rows and rows without a doc_id are packed each for itself;
    an empty table gives an empty result.
    """
    import public_tokenizers

    reachable(spark)
    return pack(_plain(docs)[0], str(public_tokenizers.path("word_bpe_49k.json")), size=2048)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the surrogates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return docs
