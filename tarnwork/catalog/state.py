"""Cache, latency, log and conversation queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import retrieval as R
from ..operators import state as S
from ..session import table
from ._book import Book, sql_dot

BOOK = Book()
_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


@BOOK.add("""SELECT event_type AS component, count(*) AS n, min(value) AS min_ms, max(value) AS max_ms, round(avg(value), 6) AS mean_ms, round(stddev_samp(value), 6) AS stddev_ms, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(sum(value), 4) AS total_ms FROM events GROUP BY event_type""")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    out = S.latency_stats(table(spark, d, "events").withColumnRenamed("event_type", "component"), "component", "value")
    return out.select("component", "n", "min_ms", "max_ms", *[F.round(c, 6).alias(c) for c in ("mean_ms", "stddev_ms", "p50", "p95", "p99")], F.round("total_ms", 4).alias("total_ms"))


@BOOK.add("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 100")
def last_n(spark: SparkSession, d: str) -> DataFrame:
    return S.last_n(table(spark, d, "events"), "event_type", "event_id", 100).select("event_id", "event_type")


@BOOK.add("SELECT event_id, count(*) OVER w AS rolling_n, round(sum(value) OVER w, 2) AS rolling_total FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def rolling_last_n(spark: SparkSession, d: str) -> DataFrame:
    return S.rolling_mean(table(spark, d, "events"), "event_type", "event_id", "value", 100).select("event_id", "rolling_n", F.round(F.col("rolling_mean") * F.col("rolling_n"), 2).alias("rolling_total"))


_CACHE = "cache AS (SELECT user_id AS key, max(ts) AS ts, 86400 * (user_id % 9) AS ttl, CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN 'a' ELSE 'b' END AS source_hash FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id)"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id")
    rows = table(spark, d, "events").where("ts < timestamp'2024-01-16'").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return rows.select(k.alias("key"), "ts", (86400 * (k % 9)).alias("ttl"), F.when(k % 3 == 0, "").when(k % 3 == 1, "a").otherwise("b").alias("source_hash"))


_AT = "timestamp'2024-01-20 00:00:00'"


@BOOK.add(f"WITH {_CACHE} SELECT key FROM cache WHERE epoch({_NOW}) - floor(epoch(ts)) <= ttl")
def ttl_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.alive(_cache(spark, d), F.expr(_AT)).select("key")


@BOOK.add(f"WITH {_CACHE} SELECT k.key, c.ts IS NOT NULL AS hit FROM (SELECT range AS key FROM range(0, 60)) k LEFT JOIN (SELECT * FROM cache WHERE epoch({_NOW}) - floor(epoch(ts)) <= ttl AND (source_hash = '' OR source_hash = 'a')) c ON k.key = c.key")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    return S.lookup(_cache(spark, d), spark.range(60).toDF("key"), F.expr(_AT), "a").select("key", "hit")


@BOOK.add(f"WITH {_CACHE} SELECT key FROM cache ORDER BY ts DESC, key LIMIT 25")
def lru_keep(spark: SparkSession, d: str) -> DataFrame:
    return S.lru_keep(_cache(spark, d), 25, "ts", "key").select("key")


@BOOK.add(f"WITH {_CACHE} SELECT key FROM cache WHERE key NOT IN (SELECT key FROM cache ORDER BY ts, key LIMIT 10)")
def evict_oldest(spark: SparkSession, d: str) -> DataFrame:
    return S.drop_oldest(_cache(spark, d), 10, "ts", "key").select("key")


@BOOK.add(f"WITH {_CACHE}, u AS (SELECT key, ts, 'old' AS v FROM cache UNION ALL SELECT user_id, max(ts), 'new' FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id) SELECT key, max(ts) AS ts, arg_max(v, ts) AS v FROM u GROUP BY key")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "events").where("ts >= timestamp'2024-01-16'").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("ts")).withColumn("v", F.lit("new"))
    return S.put(_cache(spark, d).select("key", "ts", F.lit("old").alias("v")), new, "key")


@BOOK.add("SELECT event_id, left(sha256('search:' || event_type || ':' || user_id), 16) AS key, trim(regexp_replace(lower(trim('  ' || event_type || '   X ')), '\\s+', ' ', 'g')) AS normal FROM events")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    key = T.cache_key(F.lit("search"), F.lit(""), F.col("event_type"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", key.alias("key"), T.normalize_query(F.concat(F.lit("  "), "event_type", F.lit("   X "))).alias("normal"))


@BOOK.add("SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, round(coalesce(100.0::DOUBLE * count(*) FILTER (event_type = 'view') / nullif(count(*) FILTER (event_type IN ('view', 'click')), 0), 0), 6) AS rate FROM events GROUP BY user_id")
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "click").alias("misses"))
    return rows.select("user_id", "hits", F.round(S.hit_rate(F.col("hits"), F.col("misses")), 6).alias("rate"))


@BOOK.add(f"WITH v AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.key, round({sql_dot('a.v', 'b.v')} / (sqrt({sql_dot('a.v', 'a.v')}) * sqrt({sql_dot('b.v', 'b.v')})), 6) AS score FROM v a, (SELECT * FROM v WHERE key = 3) b WHERE a.key <> 3) SELECT key, score FROM s WHERE score >= 0.2 ORDER BY score DESC, key LIMIT 1")
def semantic_cache_match(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "key")
    return S.semantic_match(V.literal(R.vector_of(e, 3, "key")), e.where("key <> 3"), 0.2)


_LOG = "log AS (SELECT event_id, event_type || ' item ' || (user_id % 6) AS query, event_id % 4 AS num_results, CASE WHEN event_type = 'error' THEN 'bad' ELSE '' END AS error, CASE WHEN event_id % 10 = 0 THEN 'fix' END AS corrected_query, value AS latency_ms FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.concat("event_type", F.lit(" item "), (F.col("user_id") % 6).cast("string")).alias("query"), (i % 4).alias("num_results"), F.when(F.col("event_type") == "error", "bad").otherwise("").alias("error"), F.when(i % 10 == 0, "fix").alias("corrected_query"), F.col("value").alias("latency_ms"))


@BOOK.add(f"WITH {_LOG} SELECT count(*) AS total_queries, round(100.0::DOUBLE * count(*) FILTER (num_results <> 0) / count(*), 1) AS success_rate, count(*) FILTER (num_results = 0) AS failure_count, count(*) FILTER (error <> '') AS error_count, count(corrected_query) AS corrections_made, round(avg(latency_ms), 1) AS avg_latency_ms FROM log")
def query_log_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.log_stats(_log(spark, d))


@BOOK.add(f"WITH {_LOG}, r AS (SELECT * FROM log ORDER BY event_id DESC LIMIT 500) SELECT event_id, query FROM r WHERE num_results = 0 ORDER BY event_id DESC LIMIT 50")
def log_failures(spark: SparkSession, d: str) -> DataFrame:
    return S.failures(_log(spark, d), "event_id", 50).select("event_id", "query")


@BOOK.add(f"WITH {_LOG} SELECT * FROM (SELECT query, count(*) AS n FROM log WHERE num_results = 0 GROUP BY query ORDER BY n DESC, query LIMIT 20) WHERE n >= 2")
def common_failures(spark: SparkSession, d: str) -> DataFrame:
    return S.common_failures(_log(spark, d))


@BOOK.add(f"WITH {_LOG} SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(query), '\\s+')) AS word FROM log) WHERE length(word) >= 4 AND regexp_matches(word, '^[a-z]+$') GROUP BY word ORDER BY n DESC, word LIMIT 30")
def log_keywords(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_counts(_log(spark, d))


@BOOK.add("SELECT event_type AS original, left(event_type, 3) AS corrected, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def typo_patterns(spark: SparkSession, d: str) -> DataFrame:
    return S.pair_counts(table(spark, d, "events").select(F.col("event_type").alias("original"), F.left("event_type", F.lit(3)).alias("corrected")), "original", "corrected")


@BOOK.add(f"WITH {_LOG}, w AS (SELECT string_split(query, ' ') AS w FROM log), g AS (SELECT w[1] || ' ' || w[2] AS phrase FROM w UNION ALL SELECT w[2] || ' ' || w[3] FROM w UNION ALL SELECT w[1] || ' ' || w[2] || ' ' || w[3] FROM w) SELECT * FROM (SELECT phrase, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, phrase LIMIT 10) WHERE n >= 2")
def phrase_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return S.phrase_counts(_log(spark, d))


@BOOK.add("""WITH s AS (SELECT user_id, event_type, count(*) AS mentions, round(0.4::DOUBLE * count(*) + 0.6::DOUBLE * greatest(0, 1 - (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3.6e9 / 24), 6) AS score FROM events GROUP BY 1, 2)
    SELECT user_id, rank, event_type, mentions, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS rank FROM s) WHERE rank <= 3""")
def entity_recency_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.entity_relevance(table(spark, d, "events"), F.expr("timestamp'2024-01-31 00:00:00'"), "user_id", "event_type", "ts", 3)


@BOOK.add("""WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 6 * 3600 * 1000000::BIGINT OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM m)
    SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM r GROUP BY 1, 2""")
def thread_sessions(spark: SparkSession, d: str) -> DataFrame:
    return S.sessions(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", "6 hours")


@BOOK.add()
def rolling_summary(spark: SparkSession, d: str) -> DataFrame:
    talks = table(spark, d, "conversations")
    return S.summaries(talks.select((F.col("conv_id") % 7).alias("conv_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("turn"), "role", "text"))


@BOOK.add("SELECT event_id, user_id, rank, n_total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, count(*) OVER (PARTITION BY user_id) AS n_total FROM events) WHERE n_total >= 60 AND rank <= 5")
def active_users(spark: SparkSession, d: str) -> DataFrame:
    return S.active_users(table(spark, d, "events"), "user_id", "event_id", 60, 5).select("event_id", "user_id", "rank", "n_total")


@BOOK.add("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def sanitize_json(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", T.sanitize(value).alias("value"), F.from_json("props", "k int")["k"].alias("k"))
