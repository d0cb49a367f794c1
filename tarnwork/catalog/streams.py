"""Streaming queries: they process what is there and return their result table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrichment import chunks
from ..session import table
from ..streaming import jobs as J
from ._book import Book

BOOK = Book()


@BOOK.add("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    target = J.place(spark, "counts")
    J.keep_latest(J.window_counts(J.stream_table(spark, f"{d}/events.parquet"), "ts", "event_type"), target)
    return J.latest(spark, target)


@BOOK.add("SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def stream_filter(spark: SparkSession, d: str) -> DataFrame:
    target = J.place(spark, "filtered")
    rows = J.stream_table(spark, f"{d}/events.parquet").where("event_type = 'purchase'").select("event_id", "user_id")
    J.run_available(rows, lambda batch, _: batch.write.mode("append").parquet(target), target + "-state")
    return spark.read.parquet(target)


@BOOK.add("""WITH s AS (SELECT user_id, ts, CASE WHEN epoch_ms(ts) - epoch_ms(lag(ts) OVER w) > 86400000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s),
    t AS (SELECT user_id, k, count(*) AS messages, min(ts) AS started, max(ts) AS last FROM g GROUP BY 1, 2), m AS (SELECT *, k = max(k) OVER (PARTITION BY user_id) AS final FROM t)
    SELECT user_id, messages, CAST(date_trunc('second', started) AS TIMESTAMP) AS started, CAST(date_trunc('second', last) AS TIMESTAMP) AS last, NOT final AS closed FROM m
    UNION ALL SELECT user_id, messages, CAST(date_trunc('second', started) AS TIMESTAMP), CAST(date_trunc('second', last) AS TIMESTAMP), true FROM m, (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events) WHERE final AND last + INTERVAL 24 HOUR < w""")
def stream_threads(spark: SparkSession, d: str) -> DataFrame:
    target = J.place(spark, "threads")
    J.run_available(J.threads(J.stream_table(spark, f"{d}/events.parquet").select("user_id", "ts")), lambda batch, _: batch.write.mode("append").parquet(target), target + "-state")
    return spark.read.parquet(target).withColumn("started", F.date_trunc("second", "started")).withColumn("last", F.date_trunc("second", "last"))


@BOOK.add("SELECT CAST(doc_id AS VARCHAR) AS path, left(sha256(CASE WHEN doc_id % 10 = 0 THEN text || ' more.' ELSE text END), 16) AS hash FROM documents")
def stream_incremental_index(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    index = J.IncrementalIndex(spark, J.place(spark, "index"), lambda rows: chunks(rows, "path"))
    index.apply(docs)
    index.apply(docs.withColumn("text", F.when(F.col("path").cast("long") % 10 == 0, F.concat("text", F.lit(" more."))).otherwise(F.col("text"))))
    return index.files()
