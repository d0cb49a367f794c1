"""Caches, latencies, query logs and conversation state as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .quantiles import quantiles


def latency_stats(rows: DataFrame, component: str, value: str) -> DataFrame:
    """Count, extremes, mean, sample deviation (0 for one row) and exact interpolated percentiles per component."""
    sums = rows.groupBy(component).agg(
        F.count("*").alias("n"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"), F.avg(value).alias("mean_ms"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev_ms"), F.sum(value).alias("total_ms"),
    )
    points = quantiles(rows, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, component).withColumnRenamed(component, "_of")
    out = sums.join(points, F.col(component).eqNullSafe(F.col("_of"))).drop("_of")
    return out.select(component, "n", "min_ms", "max_ms", "mean_ms", "stddev_ms", "p50", "p95", "p99", "total_ms")


def last_n(rows: DataFrame, component: str, order: str, n: int = 1000) -> DataFrame:
    """The last ``n`` measurements of each component; the partial top-n runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(component).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def rolling_mean(rows: DataFrame, component: str, order: str, value: str, n: int = 1000) -> DataFrame:
    w = Window.partitionBy(component).orderBy(order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("rolling_n", F.count("*").over(w)).withColumn("rolling_mean", F.avg(value).over(w))


def alive(entries: DataFrame, now: Column, stamp: str = "ts", ttl: str = "ttl") -> DataFrame:
    """Entries whose age in seconds is at most their time to live."""
    return entries.where(F.unix_timestamp(now) - F.unix_timestamp(F.col(stamp)) <= F.col(ttl))


def lru_keep(entries: DataFrame, capacity: int, last_access: str, key: str) -> DataFrame:
    """The ``capacity`` most recently used entries."""
    return entries.orderBy(F.desc(last_access), key).limit(capacity)


def drop_oldest(entries: DataFrame, count: int, stamp: str, key: str) -> DataFrame:
    oldest = entries.orderBy(stamp, key).limit(count).select(key)
    return entries.join(oldest, key, "left_anti")


def put(cache: DataFrame, new: DataFrame, key: str, stamp: str = "ts") -> DataFrame:
    """Upsert: the newest entry of each key."""
    from .registry import last_wins

    return last_wins(cache.unionByName(new), key, stamp)


def lookup(cache: DataFrame, keys: DataFrame, now: Column, source_hash: str = "") -> DataFrame:
    """Each asked ``key`` with its live entry; a differing source hash is a miss when both are known."""
    live = alive(cache, now)
    if source_hash:
        live = live.where((F.coalesce("source_hash", F.lit("")) == "") | (F.col("source_hash") == source_hash))
    return keys.join(live, "key", "left").withColumn("hit", F.col("ts").isNotNull())


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * hits, hits + misses), F.lit(0.0))


def semantic_match(asked: Column, cache: DataFrame, least: float = 0.92) -> DataFrame:
    """The nearest cached query if its cosine is at least ``least``; ``cache(key, embedding)``."""
    from ..functions import vectors as V

    scored = cache.select("key", F.round(V.cosine(V.doubles(F.col("embedding")), asked), 6).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "key").limit(1)


def log_stats(log: DataFrame) -> DataFrame:
    """One row over ``log(num_results, error, corrected_query, latency_ms)``; success counts rows with results, errors or not."""
    n, failed = F.count("*"), F.count_if(F.coalesce("num_results", F.lit(0)) == 0)
    return log.agg(
        n.alias("total_queries"), F.coalesce(F.round(F.try_divide(100.0 * (n - failed), n), 1), F.lit(0.0)).alias("success_rate"), failed.alias("failure_count"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("error_count"),
        F.count_if(F.coalesce("corrected_query", F.lit("")) != "").alias("corrections_made"), F.round(F.coalesce(F.avg(F.coalesce("latency_ms", F.lit(0.0))), F.lit(0.0)), 1).alias("avg_latency_ms"),
    )


def recent(log: DataFrame, order: str, n: int = 100) -> DataFrame:
    return log.orderBy(F.desc(order)).limit(n)


def failures(log: DataFrame, order: str, n: int = 100) -> DataFrame:
    """Of the last 10n rows those without results, then the last n of them."""
    return recent(recent(log, order, 10 * n).where("num_results = 0"), order, n)


def common_failures(log: DataFrame, least: int = 2, top: int = 20) -> DataFrame:
    """The most frequent failing queries; the cut comes before the minimum."""
    counted = log.where("num_results = 0").groupBy(T.normalize_query(F.col("query")).alias("query")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "query").limit(top).where(F.col("n") >= least)


def keyword_counts(log: DataFrame, top: int = 30) -> DataFrame:
    words = log.select(F.explode(F.split(F.lower("query"), r"\s+")).alias("word")).where((F.length("word") >= 4) & F.col("word").rlike("^[a-z]+$"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def pair_counts(pairs: DataFrame, a: str, b: str, top: int = 20) -> DataFrame:
    return pairs.groupBy(a, b).agg(F.count("*").alias("n")).orderBy(F.desc("n"), a, b).limit(top)


def phrase_counts(log: DataFrame, top: int = 10, least: int = 2) -> DataFrame:
    """The most frequent runs of two and three words of the queries, then those seen ``least`` times."""
    words = F.split(T.normalize_query(F.col("query")), " ")
    grams = log.select(F.explode(F.concat(T.ngrams(words, 2), T.ngrams(words, 3))).alias("phrase"))
    return grams.groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(top).where(F.col("n") >= least)


def entity_relevance(mentions: DataFrame, now: Column, group: str, entity: str, stamp: str, n: int = 5) -> DataFrame:
    """The ``n`` most relevant entities per group: 0.4 per mention and 0.6 for recency, which fades over 24 hours."""
    seen = mentions.groupBy(group, entity).agg(F.count("*").alias("mentions"), F.max(stamp).alias("last"))
    hours = (F.unix_micros(now) - F.unix_micros(F.col("last").cast("timestamp"))) / 3.6e9
    recency = F.greatest(F.lit(0.0), 1 - hours / 24)
    scored = seen.withColumn("score", F.round(0.4 * F.col("mentions") + 0.6 * recency, 6))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), entity))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n).select(group, "rank", entity, "mentions", "score")


def sessions(rows: DataFrame, key: str, stamp: str, gap: str = "24 hours") -> DataFrame:
    """Threads end after a gap without activity."""
    w = Window.partitionBy(key).orderBy(stamp)
    seconds = F.unix_micros(F.col(stamp).cast("timestamp")) / 1e6
    limit = F.lit(_seconds(gap))
    new = F.coalesce((seconds - F.lag(seconds).over(w) > limit).cast("int"), F.lit(1))
    marked = rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w))
    return marked.groupBy(key, "session").agg(F.min(stamp).alias("started"), F.max(stamp).alias("ended"), F.count("*").alias("n"))


def _seconds(gap: str) -> float:
    number, unit = gap.split()
    return float(number) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[unit[0]]


#: Messages kept, the number that starts a summary, and its longest length.
KEPT, STARTS, LONGEST = 10, 15, 500


def fold_step(held: list[tuple[str, str]], message: tuple[str, str], summary: str) -> tuple[list[tuple[str, str]], str, int]:
    """Messages kept, summary, and how many messages went into it, after one more message."""
    held = [*held, message]
    if len(held) < STARTS:
        return held, summary, 0
    old, held = held[:-KEPT], held[-KEPT:]
    points = []
    for role, text in old:
        first = text.split(".")[0][:100]
        if role == "user":
            points.append(f"User asked: {first}")
        elif len(text) > 50:
            points.append(f"Discussed: {first}")
    summary = (f"{summary} | " + " | ".join(points[-3:]) if summary else " | ".join(points[-5:]))[-LONGEST:]
    return held, summary, len(old)


def fold_messages(messages: list[tuple[str, str]]) -> tuple[str, int, int]:
    """Summary, number of summarised messages and number kept after adding the messages one by one."""
    held: list[tuple[str, str]] = []
    summary, done = "", 0
    for message in messages:
        held, summary, more = fold_step(held, message, summary)
        done += more
    return summary, done, len(held)


def summaries(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The rolling summary of each conversation: one sequential fold per conversation."""
    kind = dict(turns.dtypes)[key]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        summary, done, kept = fold_messages(list(zip(rows["role"].fillna(""), rows["text"].fillna(""), strict=True)))
        return pd.DataFrame({key: [rows[key].iloc[0]], "summary": [summary], "summarized": [done], "kept": [kept]})

    return turns.select(key, order, "role", "text").groupBy(key).applyInPandas(run, f"`{key}` {kind}, summary string, summarized int, kept int")


def active_users(rows: DataFrame, user: str, order: str, least: int, most_each: int) -> DataFrame:
    """The first rows of each user with at least ``least`` rows."""
    wanted = rows.groupBy(user).agg(F.count("*").alias("n_total")).where(F.col("n_total") >= least)
    rank = F.row_number().over(Window.partitionBy(user).orderBy(order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most_each).join(wanted, user)


def delete(cache: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The cache without some keys."""
    return cache.join(keys.select(key), key, "left_anti")


def estimated_savings(hits: Column, cost: float = 0.001, seconds: float = 0.35) -> Column:
    """What ``hits`` spared: calls, money and milliseconds, at the cost and time of one call."""
    return F.struct(hits.alias("api_calls_saved"), F.round(hits * cost, 6).alias("estimated_cost_saved_usd"), F.round(hits * seconds * 1000, 6).alias("estimated_time_saved_ms"))


def source_hash(files: DataFrame, stamp: str = "mtime") -> DataFrame:
    """One row: a hash of the index files' sorted times of change; empty without files."""
    stamps = F.array_join(F.transform(F.array_sort(F.collect_list(F.col(stamp).cast("double"))), lambda s: s.cast("string")), ":")
    return files.agg(F.when(F.count(stamp) == 0, "").otherwise(F.left(F.md5(stamps), F.lit(12))).alias("source_hash"))


def active_threads(threads: DataFrame, now: Column, ttl: int = 24 * 3600) -> DataFrame:
    """Each thread with whether the bot takes part: it has before, and the last activity is under ``ttl`` seconds ago."""
    fresh = F.unix_timestamp(now) - F.unix_timestamp("last_activity") < ttl
    return threads.withColumn("is_active", F.coalesce(fresh & F.col("bot_active"), F.lit(False)))


def mentions(found: DataFrame, thread: str, entity: str, stamp: str, now: Column, most: int = 15) -> DataFrame:
    """Per thread the ``most`` relevant entities of ``found(thread, entity, stamp)``: 0.4 a mention and up to 0.6 for a
    last one less than a day ago; ``display_name`` is the id in title case."""
    rows = found.groupBy(thread, entity).agg(F.count("*").alias("mentions"), F.max(stamp).alias("last_mentioned"))
    hours = (F.unix_timestamp(now) - F.unix_timestamp("last_mentioned")) / 3600
    relevance = F.col("mentions") * 0.4 + F.greatest(F.lit(0.0), 1.0 - hours / 24) * 0.6
    rows = rows.withColumn("relevance", F.round(relevance, 6)).withColumn("display_name", F.initcap(F.replace(F.col(entity), F.lit("-"), F.lit(" "))))
    rank = F.row_number().over(Window.partitionBy(thread).orderBy(F.desc("relevance"), entity))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)
