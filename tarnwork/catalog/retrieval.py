"""Search queries over ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import retrieval as R
from ..operators.postings import Postings
from ..session import documents, table
from ..streaming.files import sweep_at_end
from ..streaming.jobs import place
from ._book import Book, sql_bm25, sql_dot, sql_quoted, sql_tokens

BOOK = Book()
QUERY, OTHER = "the edtion ndble estion edtion", "heha hash anre"
PIVOT = 7
_COS = f"round({sql_dot('a.v', 'b.v')} / (sqrt({sql_dot('a.v', 'a.v')}) * sqrt({sql_dot('b.v', 'b.v')})), 6)"
_VECS = "vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_SEM = f"{_VECS}, sem AS (SELECT a.vec_id, a.label, {_COS} AS score FROM vecs a, (SELECT * FROM vecs WHERE vec_id = {PIVOT}) b)"
_Q, _O = R.query_tokens(QUERY), R.query_tokens(OTHER)


def _top(query: list[str], k: int, suffix: str = "") -> str:
    return f"{sql_bm25(query)}, top AS (SELECT doc_id, bm25 FROM scored WHERE bm25 > 0 ORDER BY bm25 DESC, doc_id LIMIT {k})"


@BOOK.add(f"WITH {_top(_Q, 20)} SELECT doc_id, round(bm25 / (SELECT max(bm25) FROM top), 6) AS score FROM top")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_search(documents(spark, d), QUERY, 20)


@BOOK.add(f"WITH {sql_bm25(_Q)} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored")
def bm25_all_scores(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_scores(documents(spark, d), QUERY).select("doc_id", F.round("bm25", 6).alias("bm25"))


_built: dict[tuple[str, str], Postings] = {}


def stored(spark: SparkSession, d: str) -> Postings:
    """The keyword index over whole ``documents``; an application builds it once for a folder, then only reads it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        index = Postings(spark, place(spark, "postings"))
        sweep_at_end(spark, index.folder)
        index.add(documents(spark, d))
        _built[key] = index
    return _built[key]


@BOOK.add(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences, max(tf)::INT AS most FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def postings_build(spark: SparkSession, d: str) -> DataFrame:
    """What the stored postings hold of each term."""
    tf = F.aggregate("docs", F.lit(0).cast("long"), lambda s, x: s + x["tf"])
    return stored(spark, d).postings().groupBy("term").agg(F.sum("n").alias("df"), F.sum(tf).alias("occurrences"), F.max("most").alias("most"))


@BOOK.add(f"WITH {_top(_Q, 20)} SELECT doc_id, round(bm25 / (SELECT max(bm25) FROM top), 6) AS score FROM top")
def bm25_from_postings(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).search(QUERY, 20)


_M = "CASE WHEN doc_id % 3 = 0 THEN text || ' edtion ndble' ELSE text END"


@BOOK.add(f"""WITH later AS (SELECT doc_id, {_M} AS text FROM documents WHERE doc_id % 7 <> 1), {_top(_Q, 20).replace('FROM documents', 'FROM later')}
    SELECT doc_id, round(bm25 / (SELECT max(bm25) FROM top), 6) AS score FROM top""")
def bm25_after_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Documents that come, change and go in three batches of the index."""
    docs = documents(spark, d).select("doc_id", "text")
    index = Postings(spark, place(spark, "postings"))
    sweep_at_end(spark, index.folder)
    index.add(docs)
    changed = F.concat("text", F.lit(" edtion ndble"))
    index.add(docs.where("doc_id % 3 = 0").withColumn("text", changed))
    index.remove(docs.where("doc_id % 7 = 1"))
    return index.search(QUERY, 20)


@BOOK.add(f"WITH {_SEM} SELECT vec_id, label, score FROM sem ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.vector_search(e, R.vector_of(e, PIVOT), 20).select("vec_id", "label", "score")


@BOOK.add(f"WITH {_SEM} SELECT vec_id, label, score FROM sem WHERE label IN (1, 3) ORDER BY score DESC, vec_id LIMIT 15")
def vector_prefilter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.vector_search(e, R.vector_of(e, PIVOT), 15, keep=F.col("label").isin(1, 3)).select("vec_id", "label", "score")


@BOOK.add(f"WITH {_SEM} SELECT * FROM (SELECT vec_id, label, score FROM sem ORDER BY score DESC, vec_id LIMIT 50) WHERE label IN (1, 3) ORDER BY score DESC, vec_id LIMIT 5")
def vector_postfilter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.vector_search(e, R.vector_of(e, PIVOT), 5, keep=F.col("label").isin(1, 3), post_filter=True).select("vec_id", "label", "score")


@BOOK.add(f"WITH {_SEM} SELECT vec_id, score FROM sem WHERE vec_id <> {PIVOT} AND label = (SELECT label FROM embeddings WHERE vec_id = {PIVOT}) ORDER BY score DESC, vec_id LIMIT 10")
def find_similar_same_label(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    own = e.where(F.col("vec_id") == PIVOT).first()
    return R.vector_search(e, list(own["embedding"]), 10, keep=(F.col("vec_id") != PIVOT) & (F.col("label") == own["label"])).select("vec_id", "score")


@BOOK.add(f"WITH {_SEM}, t AS (SELECT vec_id, label, score FROM sem ORDER BY score DESC, vec_id LIMIT 30) SELECT vec_id, round(score + CASE WHEN label IN (2, 5) THEN 0.2 ELSE 0 END, 6) AS score FROM t ORDER BY score DESC, vec_id LIMIT 10")
def vector_entity_boost(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    near = R.vector_search(e, R.vector_of(e, PIVOT), 30)
    return R.entity_boost(near, F.array("label"), [2, 5], k=10).select("vec_id", "score")


@BOOK.add(f"""WITH {_SEM}, {_top(_Q, 30)}, s AS (SELECT vec_id AS id, score FROM sem ORDER BY score DESC, vec_id LIMIT 30),
    k AS (SELECT doc_id AS id, round(bm25 / (SELECT max(bm25) FROM top), 6) AS score FROM top)
    SELECT coalesce(s.id, k.id) AS id, coalesce(s.score, 0) AS semantic, coalesce(k.score, 0) AS keyword, round(0.7 * coalesce(s.score, 0) + 0.3 * coalesce(k.score, 0), 6) AS score
    FROM s FULL JOIN k ON s.id = k.id WHERE round(0.7 * coalesce(s.score, 0) + 0.3 * coalesce(k.score, 0), 6) >= 0.05 ORDER BY score DESC, id LIMIT 10""")
def hybrid_fusion_full(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    near = R.vector_search(e, R.vector_of(e, PIVOT), 30).select(F.col("vec_id").alias("id"), "score")
    words = R.bm25_search(documents(spark, d), QUERY, 30).withColumnRenamed("doc_id", "id")
    return R.fuse_full(words, near, (0.7, 0.3), 10, least=0.05)


@BOOK.add(f"""WITH {_SEM}, {sql_bm25(_Q)}, s AS (SELECT vec_id AS id, score FROM sem ORDER BY score DESC, vec_id LIMIT 80),
    j AS (SELECT s.id, s.score AS semantic, round(coalesce(bm25, 0) / (SELECT max(bm25) FROM scored), 6) AS keyword FROM s LEFT JOIN scored ON s.id = doc_id)
    SELECT id, semantic, keyword, round(0.7 * semantic + 0.3 * keyword, 6) AS score FROM j ORDER BY score DESC, id LIMIT 10""")
def hybrid_fusion_candidate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    near = R.vector_search(e, R.vector_of(e, PIVOT), 80).select(F.col("vec_id").alias("id"), "score")
    words = R.bm25_scores(documents(spark, d), QUERY).withColumnRenamed("doc_id", "id")
    return R.fuse_candidates(near, words, (0.7, 0.3), 10)


@BOOK.add(f"""WITH a AS (WITH {_top(_Q, 40)} SELECT doc_id, round(bm25 / (SELECT max(bm25) FROM top), 12) AS score FROM top),
    b AS (WITH {_top(_O, 40)} SELECT doc_id, round(bm25 / (SELECT max(bm25) FROM top), 12) AS score FROM top),
    u AS (SELECT doc_id, score, score * 1.0 AS part FROM a UNION ALL SELECT doc_id, score, score * 0.5 FROM b)
    SELECT doc_id, round(sum(part), 6) AS score, round(max(score), 6) AS best, count(*) AS n_queries FROM u GROUP BY doc_id ORDER BY 2 DESC, doc_id LIMIT 20""")
def multi_query_expansion(spark: SparkSession, d: str) -> DataFrame:
    return R.multi_query(documents(spark, d), [(QUERY, 1.0), (OTHER, 0.5)], 20, 40)


@BOOK.add(f"""WITH {_top(_Q, 60)}, c AS (SELECT doc_id AS id, round(bm25 / (SELECT max(bm25) FROM top), 6) AS score FROM top ORDER BY 2 DESC, 1 LIMIT 30),
    r AS (SELECT id, score, len(list_intersect(list_distinct({sql_tokens('text')}), [{sql_quoted(sorted(set(_Q)))}])) - 2.0 AS raw FROM c JOIN documents ON id = doc_id)
    SELECT id, round(0.4 * score + 0.6 / (1 + exp(-raw)), 6) AS score FROM r ORDER BY 2 DESC, 1 LIMIT 10""")
def rerank_sigmoid_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    found = R.bm25_search(docs, QUERY, 60).withColumnRenamed("doc_id", "id")
    full = found.join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    raw = F.size(F.array_intersect(T.tokens(F.col("text")), F.array(*map(F.lit, sorted(set(_Q)))))) - 2.0
    return R.rerank(full, raw, 10).select("id", "score")


_COSINE = f"{sql_dot('a.v', 'b.v')} / (sqrt({sql_dot('a.v', 'a.v')}) * sqrt({sql_dot('b.v', 'b.v')}))"


@BOOK.add(f"""WITH RECURSIVE {_SEM}, c AS (SELECT sem.vec_id AS id, score, v FROM sem JOIN vecs USING (vec_id) ORDER BY score DESC, sem.vec_id LIMIT 20), near AS (SELECT a.id AS id, b.id AS other, {_COSINE} AS cos FROM c a, c b),
    chosen(step, ids) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT step + 1, list_append(ids, (SELECT arg_min(c.id, struct_pack(a := -round(0.7::DOUBLE * c.score - 0.3::DOUBLE * coalesce((SELECT max(cos) FROM near WHERE near.id = c.id AND list_contains(ids, other)), 0), 9), b := -c.score, d := c.id)) FROM c WHERE NOT list_contains(ids, c.id))) FROM chosen WHERE step < 10)
    SELECT c.id, rank, round(score, 6) AS score FROM (SELECT unnest(ids) AS id, generate_subscripts(ids, 1) AS rank FROM chosen WHERE step = 10) p JOIN c ON c.id = p.id""")
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.mmr(R.vector_search(e, R.vector_of(e, PIVOT), 20).select(F.col("vec_id").alias("id"), "score", "embedding"), 10)


_RAW = f"len(list_intersect(list_distinct({sql_tokens('text')}), [{sql_quoted(sorted(set(_Q)))}])) - 2.0::DOUBLE"
_PIPELINE = f"""WITH RECURSIVE {_SEM}, {sql_bm25(_Q)}, near AS (SELECT doc_id AS id, text, coalesce(score, 0) AS score FROM documents LEFT JOIN sem ON vec_id = doc_id ORDER BY score DESC, id LIMIT 80),
    fused AS (SELECT id, text, round(0.7::DOUBLE * near.score + 0.3::DOUBLE * round(coalesce(bm25, 0) / (SELECT max(bm25) FROM scored), 6), 6) AS score FROM near LEFT JOIN scored ON id = doc_id),
    ranked AS (SELECT id, round(0.4::DOUBLE * score + 0.6::DOUBLE / (1 + exp(-({_RAW}))), 6) AS score FROM (SELECT * FROM fused ORDER BY score DESC, id LIMIT 90) ORDER BY 2 DESC, id LIMIT 30),
    c AS (SELECT id, score, v FROM ranked JOIN vecs ON vec_id = id ORDER BY score DESC, id LIMIT 20), apart AS (SELECT a.id AS id, b.id AS other, {_COSINE} AS cos FROM c a, c b),
    chosen(step, ids) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT step + 1, list_append(ids, (SELECT arg_min(c.id, struct_pack(a := -round(0.7::DOUBLE * c.score - 0.3::DOUBLE * coalesce((SELECT max(cos) FROM apart WHERE apart.id = c.id AND list_contains(ids, other)), 0), 9), b := -c.score, d := c.id)) FROM c WHERE NOT list_contains(ids, c.id))) FROM chosen WHERE step < 10)
    SELECT c.id, rank, round(score, 4) AS score FROM (SELECT unnest(ids) AS id, generate_subscripts(ids, 1) AS rank FROM chosen WHERE step = 10) p JOIN c ON c.id = p.id"""


@BOOK.add(_PIPELINE)
def hybrid_search_pipeline(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    raw = F.size(F.array_intersect(T.tokens(F.col("text")), F.array(*map(F.lit, sorted(set(_Q)))))) - 2.0
    return R.search(docs, e, QUERY, R.vector_of(e, PIVOT, "id"), k=10, raw=raw).withColumn("score", F.round("score", 4))


@BOOK.add(_PIPELINE)
def hybrid_search_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same pipeline with the keyword scores of the stored postings."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    raw = F.size(F.array_intersect(T.tokens(F.col("text")), F.array(*map(F.lit, sorted(set(_Q)))))) - 2.0
    keyword = lambda query: stored(spark, d).scores(query).withColumnRenamed("doc_id", "id")
    return R.search(docs, e, QUERY, R.vector_of(e, PIVOT, "id"), k=10, raw=raw, keyword=keyword).withColumn("score", F.round("score", 4))


@BOOK.add(f"""WITH {_SEM}, s AS (SELECT 'doc' AS type, vec_id AS id, score FROM sem ORDER BY score DESC, vec_id LIMIT 40), t AS (SELECT 'doc' AS type, doc_id AS id FROM labels WHERE quality = 1)
    SELECT coalesce(s.type, t.type) AS type, coalesce(s.id, t.id) AS id, round(CASE WHEN score IS NULL THEN 0.5 WHEN t.id IS NOT NULL THEN least(score + 0.3, 1.0) ELSE score END, 6) AS score,
    CASE WHEN score IS NULL THEN 'structured' WHEN t.id IS NOT NULL THEN 'both' ELSE 'semantic' END AS origin FROM s FULL JOIN t ON s.type = t.type AND s.id = t.id""")
def merge_structured_semantic(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    near = R.vector_search(e, R.vector_of(e, PIVOT), 40).select(F.lit("doc").alias("type"), F.col("vec_id").alias("id"), "score")
    known = table(spark, d, "labels").where("quality = 1").select(F.lit("doc").alias("type"), F.col("doc_id").alias("id"))
    return R.merge_structured(near, known)


@BOOK.add(f"""SELECT vec_id, round(least(greatest(1 - sqrt(list_sum(list_transform(list_zip(v[1:18], p), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) / sqrt(18) + CASE WHEN label = l THEN 0.05 ELSE 0 END, 0), 1), 6) AS similarity
    FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), (SELECT CAST(embedding AS DOUBLE[])[1:18] AS p, label AS l FROM embeddings WHERE vec_id = {PIVOT})""")
def disposition_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    own = e.where(F.col("vec_id") == PIVOT).first()
    part = F.slice(V.doubles(F.col("embedding")), F.lit(1), F.lit(18))
    return e.select("vec_id", F.round(V.disposition_similarity(part, V.literal(own["embedding"][:18]), F.col("label"), F.lit(own["label"])), 6).alias("similarity"))


@BOOK.add(f"""WITH vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:18] AS v FROM embeddings), t AS (SELECT vec_id AS type_id, v AS tv FROM vecs WHERE vec_id < 5),
    s AS (SELECT vec_id, type_id, round(least(greatest(1 - sqrt(list_sum(list_transform(list_zip(v, tv), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) / sqrt(18), 0), 1), 6) AS similarity FROM vecs, t)
    SELECT vec_id, type_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, type_id) AS r FROM s) WHERE r = 1""")
def compound_type_match(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.slice(V.doubles(F.col("embedding")), F.lit(1), F.lit(18)).alias("v"))
    types = [(r.vec_id, r.v) for r in e.where("vec_id < 5").collect()]
    near = F.array(*[F.struct(F.round(V.disposition_similarity(F.col("v"), V.literal(v)), 6).alias("similarity"), (-F.lit(i)).alias("negative")) for i, v in types])
    best = F.array_max(near)
    return e.select("vec_id", (-best["negative"]).alias("type_id"), best["similarity"].alias("similarity"))


@BOOK.add(f"SELECT vec_id, round(sqrt({sql_dot('v', 'v')}), 6) AS norm, round(v[1] / sqrt({sql_dot('v', 'v')}), 6) AS first FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = V.doubles(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(V.unit(v)[0], 6).alias("first"))
