"""Audit queries: parts are documents, titled by their name, brand and type, cited by their sold quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..session import table
from ._book import Book

BOOK = Book()
_ROLES = "CASE p_size % 5 WHEN 0 THEN 'Director; PhD Student' WHEN 1 THEN 'PhD Student' WHEN 2 THEN 'Affiliate Faculty; Director' WHEN 3 THEN 'Postdoc' ELSE 'Director' END"
_ROWS = f"""cited AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), docs AS (SELECT p_partkey AS doc_id, p_name || CASE p_size % 3 WHEN 0 THEN ': a study, of ' WHEN 1 THEN ' and, then, ' ELSE ' ' END || p_brand || repeat(' more', p_size % 23) AS title,
    CASE p_type WHEN 'PROMO' THEN 'Nature' WHEN 'SMALL' THEN 'Cell Reports' ELSE p_type END AS venue, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE q END AS citation_count, p_size % 14 AS topic_count, p_size % 4 AS profile_link_count, {_ROLES} AS lab_author_roles FROM part LEFT JOIN cited ON p_partkey = l_partkey),
    worded AS (SELECT *, len(regexp_extract_all(title, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?')) AS title_word_count FROM docs)"""
_SCORED = f"""{_ROWS}, b AS (SELECT greatest(1, quantile_cont(title_word_count, 0.05)) AS lo, quantile_cont(title_word_count, 0.95) AS h0 FROM worded), bounds AS (SELECT lo, greatest(lo + 1, h0) AS hi FROM b),
    f AS (SELECT *, least(greatest((title_word_count - lo) / (hi - lo), 0), 1) AS verbosity,
    least(greatest(contains(title, ':')::INT * 0.40::DOUBLE + contains(title, '?')::INT * 0.20::DOUBLE + least(length(title) - length(replace(title, ',', '')), 3) / 3.0::DOUBLE * 0.25::DOUBLE + contains(lower(title), ' and ')::INT * 0.15::DOUBLE, 0), 1) AS marks,
    least(topic_count / 12.0::DOUBLE, 1) AS breadth, least(len(list_distinct(list_filter(list_transform(string_split(lab_author_roles, ';'), lambda r: trim(r)), lambda r: r <> ''))) / 4.0::DOUBLE, 1) AS diversity,
    regexp_matches(lower(venue), 'science|nature|pnas|proceedings of the national academy|cell|american sociological review')::INT AS signal, least(profile_link_count / 3.0::DOUBLE, 1) AS linked FROM worded, bounds),
    g AS (SELECT *, least(greatest(0.84::DOUBLE * verbosity + 0.16::DOUBLE * marks, 0), 1) AS ts, least(0.45::DOUBLE * breadth + 0.25::DOUBLE * diversity + 0.20::DOUBLE * signal + 0.10::DOUBLE * linked, 1) AS rc FROM f),
    scored AS (SELECT *, least(0.60::DOUBLE * rc + 0.25::DOUBLE * diversity + 0.15::DOUBLE * linked, 1) AS ra FROM g)"""
_GROUP = """CASE WHEN lab_author_roles = 'Postdoc' THEN 'No lab core author' WHEN lab_author_roles = 'PhD Student' THEN 'Solo PhD student' WHEN lab_author_roles = 'Director' THEN 'Solo faculty'
    WHEN lab_author_roles = 'Affiliate Faculty; Director' THEN 'Faculty + Faculty' ELSE 'Mixed (faculty + PhD)' END"""
_QUAD = f"""{_SCORED}, cut AS (SELECT median(round(ts, 9)) AS tc, median(round(rc, 9)) AS cc FROM scored), quad AS (SELECT *, CASE WHEN round(ts, 9) <= tc AND round(rc, 9) > cc THEN 'Hidden Gem' WHEN round(ts, 9) > tc AND round(rc, 9) > cc THEN 'Aligned Surprise' WHEN round(ts, 9) <= tc THEN 'Routine' ELSE 'False Positive' END AS quadrant, {_GROUP} AS composition FROM scored, cut)"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    part = table(spark, d, "part").join(cited, F.col("p_partkey") == F.col("l_partkey"), "left")
    k, s = F.col("p_size") % 3, F.col("p_size") % 5
    link = F.when(k == 0, ": a study, of ").when(k == 1, " and, then, ").otherwise(" ")
    roles = F.when(s == 0, "Director; PhD Student").when(s == 1, "PhD Student").when(s == 2, "Affiliate Faculty; Director").when(s == 3, "Postdoc").otherwise("Director")
    rows = part.select(
        F.col("p_partkey").alias("doc_id"), F.concat("p_name", link, "p_brand", F.repeat(F.lit(" more"), F.col("p_size") % 23)).alias("title"), F.when(F.col("p_type") == "PROMO", "Nature").when(F.col("p_type") == "SMALL", "Cell Reports").otherwise(F.col("p_type")).alias("venue"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).otherwise(F.col("q")).alias("citation_count"), (F.col("p_size") % 14).alias("topic_count"), (F.col("p_size") % 4).alias("profile_link_count"), roles.alias("lab_author_roles"),
    )
    return rows.withColumn("title_word_count", T.title_words(F.col("title")))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = A.proxy_scores(_rows(spark, d))
    for c in ("text_surprise_score", "representation_contrast_proxy", "role_aware_reward"):
        rows = rows.withColumn(c, F.round(c, 9))
    return rows


@BOOK.add(f"WITH {_ROWS} SELECT doc_id, title_word_count, CASE WHEN title_word_count <= 6 THEN '<= 6 words' WHEN title_word_count <= 10 THEN '7-10 words' WHEN title_word_count <= 14 THEN '11-14 words' WHEN title_word_count <= 19 THEN '15-19 words' ELSE '>= 20 words' END AS title_bin FROM worded")
def audit_bins(spark: SparkSession, d: str) -> DataFrame:
    return A.title_bins(_rows(spark, d)).select("doc_id", "title_word_count", "title_bin")


@BOOK.add(f"WITH {_SCORED} SELECT doc_id, round(ts, 6) AS text_surprise_score, round(rc, 6) AS representation_contrast_proxy, round(ra, 6) AS role_aware_reward FROM scored")
def audit_scores(spark: SparkSession, d: str) -> DataFrame:
    return A.proxy_scores(_rows(spark, d)).select("doc_id", *[F.round(c, 6).alias(c) for c in ("text_surprise_score", "representation_contrast_proxy", "role_aware_reward")])


@BOOK.add(f"WITH {_QUAD} SELECT doc_id, quadrant AS reward_quadrant, composition AS author_composition FROM quad")
def audit_quadrants(spark: SparkSession, d: str) -> DataFrame:
    return A.quadrants(_scored(spark, d)).select("doc_id", "reward_quadrant", "author_composition")


@BOOK.add(f"WITH {_QUAD} SELECT quadrant AS reward_quadrant, count(*) AS n, count(citation_count) AS n_with_citations, round(avg(citation_count), 6) AS mean_citations, median(citation_count) AS median_citations, round(avg(round(ts, 9)), 6) AS mean_text_surprise_score FROM quad GROUP BY quadrant")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    out = A.summarize(A.quadrants(_scored(spark, d)), "reward_quadrant", ("text_surprise_score",))
    return out.withColumn("mean_citations", F.round("mean_citations", 6)).withColumn("mean_text_surprise_score", F.round("mean_text_surprise_score", 6))


@BOOK.add(f"WITH {_QUAD} SELECT composition AS author_composition, count(*) AS n, count(citation_count) AS n_with_citations, round(avg(citation_count), 6) AS mean_citations, median(citation_count) AS median_citations FROM quad GROUP BY composition")
def audit_author_groups(spark: SparkSession, d: str) -> DataFrame:
    return A.summarize(A.quadrants(_scored(spark, d)), "author_composition").withColumn("mean_citations", F.round("mean_citations", 6))


@BOOK.add(f"WITH {_QUAD}, s AS (SELECT quadrant, avg(citation_count) AS m FROM quad GROUP BY 1) SELECT round((SELECT m FROM s WHERE quadrant = 'Hidden Gem') / (SELECT m FROM s WHERE quadrant = 'False Positive'), 6) AS ratio")
def audit_hidden_ratio(spark: SparkSession, d: str) -> DataFrame:
    return A.hidden_ratio(A.summarize(A.quadrants(_scored(spark, d)), "reward_quadrant")).select(F.round("ratio", 6).alias("ratio"))


@BOOK.add("""WITH docs AS (SELECT o_orderkey AS doc_id, 'order ' || o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN '10.1/' || o_orderkey ELSE '' END AS doi, year(o_orderdate) AS year FROM orders), e AS (SELECT l_orderkey AS doc_id, list_sort(list(DISTINCT 's' || l_suppkey)) AS a FROM lineitem GROUP BY 1),
    k AS (SELECT *, CASE WHEN doi <> '' THEN doi ELSE trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) END AS paper_key FROM docs), o AS (SELECT '10.1/' || s_suppkey * 2 AS paper_key, ['s' || s_suppkey] AS p FROM supplier),
    j AS (SELECT k.*, coalesce(a, []) AS a, coalesce(p, []) AS p FROM k LEFT JOIN e USING (doc_id) LEFT JOIN o USING (paper_key)), l AS (SELECT *, list_sort(list_distinct(list_concat(a, p))) AS links FROM j)
    SELECT doc_id, paper_key, year, array_to_string(a, '; ') AS edge_author_ids, array_to_string(p, '; ') AS profile_owner_ids, len(links) AS lab_link_count, array_to_string(list_transform(links, lambda x: 'Supplier#' || lpad(x[2:], 9, '0')), '; ') AS lab_author_names FROM l""")
def document_panel(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("order "), "o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("10.1/"), F.col("o_orderkey").cast("string"))).otherwise("").alias("doi"), F.year("o_orderdate").alias("year"), F.lit(None).cast("string").alias("venue"), F.col("o_totalprice").alias("citation_count"), F.array("o_orderstatus").alias("topics"))
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("person_id"))
    suppliers = table(spark, d, "supplier")
    owners = suppliers.select(F.concat(F.lit("10.1/"), (F.col("s_suppkey") * 2).cast("string")).alias("doi"), F.lit("").alias("title"), name.alias("person_id"))
    people = suppliers.select(name.alias("person_id"), F.col("s_name").alias("name"), F.lit("Director").alias("role"))
    return A.document_panel(docs, edges, owners, people).select("doc_id", "paper_key", "year", "edge_author_ids", "profile_owner_ids", "lab_link_count", "lab_author_names")


@BOOK.add("SELECT doc_id, round(-0.02 + CAST('0x' || left(md5('d' || doc_id), 8) AS BIGINT) / 4294967295.0::DOUBLE * 0.04, 9) AS jitter FROM documents")
def stable_jitter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(T.stable_float(F.concat(F.lit("d"), F.col("doc_id").cast("string"))), 9).alias("jitter"))
