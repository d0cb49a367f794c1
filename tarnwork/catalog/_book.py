"""Registration of queries with their SQL, and SQL fragments that several share."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.text import PUNCTUATION


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            key = name or f.__name__
            self.queries[key] = f
            if sql is not None:
                self.sql[key] = sql
            return f

        return keep


def sql_tokens(text: str) -> str:
    marks = PUNCTUATION.replace("'", "''")
    return f"list_filter(string_split_regex(translate(lower(coalesce({text}, '')), '{marks}', ''), '\\s+'), lambda w: length(w) > 2)"


def sql_quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_bm25(query: list[str], corpus: str = "documents") -> str:
    """CTEs ending in ``scored(doc_id, bm25)`` over every document."""
    from collections import Counter

    counts = Counter(query)
    values = ", ".join(f"('{w}', {n})" for w, n in counts.items())
    return f"""
        q(w, n) AS (VALUES {values}),
        toks AS (SELECT doc_id, {sql_tokens('text')} AS t FROM {corpus}),
        stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks),
        freq AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS w FROM toks) GROUP BY w),
        idfs AS (SELECT w, ln(stats.n - df + 0.5) - ln(df + 0.5) AS idf FROM freq, stats),
        mean_idf AS (SELECT avg(idf) AS m FROM idfs),
        weights AS (SELECT q.w, q.n, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM q JOIN idfs USING (w), mean_idf),
        tf AS (SELECT doc_id, len(t) AS dl, weights.n, idf, len(list_filter(t, lambda x: x = weights.w)) AS f FROM toks, weights),
        scored AS (SELECT doc_id, sum(tf.n * idf * (f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / mean)))) AS bm25 FROM tf, stats GROUP BY doc_id)
    """


def sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
