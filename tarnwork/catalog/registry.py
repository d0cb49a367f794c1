"""Lookup queries; customers, parts, orders and suppliers stand for people, resources and publications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aliases import TOPIC_ALIASES, closure
from ..operators import registry as R
from ..session import table
from ._book import Book, sql_quoted

BOOK = Book()
_TERMS = closure("network")


@BOOK.add("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '000017') OR list_contains(string_split_regex(lower(c_name), '\\s+'), '000017') ORDER BY c_custkey LIMIT 1")
def first_match_lookup(spark: SparkSession, d: str) -> DataFrame:
    return R.first_match(table(spark, d, "customer"), R.name_matches(F.col("c_name"), "000017"), "c_custkey").select("c_custkey", "c_name")


@BOOK.add("SELECT c_custkey, c_mktsegment FROM customer WHERE contains(lower(c_mktsegment), 'build')")
def find_by_role(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(R.contains(F.col("c_mktsegment"), "Build")).select("c_custkey", "c_mktsegment")


@BOOK.add("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(n_name), 'nation_1')")
def find_by_institution(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.where(R.contains(F.col("n_name"), "NATION_1")).select("c_custkey", "n_name")


@BOOK.add("""SELECT p_partkey, p_name, tier FROM (SELECT *, CASE WHEN CAST(p_partkey AS VARCHAR) = 'hot gear' THEN 1 WHEN contains(lower(p_name), 'hot gear') OR contains('hot gear', lower(p_name)) THEN 2
    WHEN contains(lower(p_type), 'hot gear') THEN 3 END AS tier FROM part) WHERE tier IS NOT NULL ORDER BY tier, p_partkey LIMIT 1""")
def tiered_lookup(spark: SparkSession, d: str) -> DataFrame:
    q = "hot gear"
    tiers = [F.col("p_partkey").cast("string") == q, R.contains(F.col("p_name"), q) | F.lit(q).contains(F.lower("p_name")), R.any_contains(F.array("p_type"), q)]
    return R.tiered_match(table(spark, d, "part"), tiers, "p_partkey").select("p_partkey", "p_name", "tier")


@BOOK.add("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt') OR contains(lower(p_type), 'bolt')")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return R.search(table(spark, d, "part"), "BOLT", ["p_name", "p_brand", "p_type"]).select("p_partkey")


@BOOK.add("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'promo') OR contains(lower(p_brand), 'promo') OR contains('promo', lower(p_brand)) OR contains('promo', lower(p_type))")
def tag_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(R.any_contains(F.array("p_type", "p_brand"), "Promo", both_ways=True)).select("p_partkey")


@BOOK.add("""WITH t AS (SELECT p_partkey, unnest([p_name, p_type, p_brand || ' ' || p_name]) AS t FROM part), w AS (SELECT *, lower(t) AS l FROM t),
    m AS (SELECT DISTINCT p_partkey, t FROM w WHERE contains(l, 'small blue gear') OR (contains(l, 'small')::INT + contains(l, 'blue')::INT + contains(l, 'gear')::INT) >= 1.8)
    SELECT p_partkey, list_sort(list(t)) AS matched FROM m GROUP BY p_partkey""")
def topic_match_60pct(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.array("p_name", "p_type", F.concat_ws(" ", "p_brand", "p_name")).alias("topics"))
    return R.match_topics(parts, "topics", "small blue gear", "p_partkey").select("p_partkey", F.array_sort("matched_topics").alias("matched"))


_PUBS = """pubs AS (SELECT o_orderkey AS ord, c_name AS owner, o_orderpriority AS title, c_mktsegment AS venue, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS doi,
    year(o_orderdate) AS year, CAST(floor(o_totalprice) AS BIGINT) AS citation_count FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _pubs(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("ord"), F.col("c_name").alias("owner"), F.col("o_orderpriority").alias("title"), F.col("c_mktsegment").alias("venue"), F.array("o_orderstatus").alias("topics"), F.array("c_name").alias("authors"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("doi"), F.year("o_orderdate").alias("year"), F.floor("o_totalprice").cast("long").alias("citation_count"),
    )


@BOOK.add(f"""WITH {_PUBS}, m AS (SELECT *, CASE WHEN contains(lower(owner), 'build') THEN 'Author: ' || owner WHEN contains(lower(title), 'build') THEN 'Title match' WHEN contains(lower(venue), 'build') THEN 'Venue: ' || venue END AS reason FROM pubs),
    r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN doi <> '' THEN doi ELSE 'row:' || ord END ORDER BY year DESC, citation_count DESC, ord) AS k FROM m WHERE reason IS NOT NULL)
    SELECT ord, owner, year, citation_count, reason AS match_reason FROM r WHERE k = 1""")
def publication_cascade_dedup(spark: SparkSession, d: str) -> DataFrame:
    return R.publication_search(_pubs(spark, d), "Build").select("ord", "owner", "year", "citation_count", "match_reason")


@BOOK.add(f"WITH {_PUBS}, r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN doi <> '' THEN doi ELSE 'row:' || ord END ORDER BY year DESC, citation_count DESC, ord) AS k FROM pubs) SELECT ord, owner, doi, year FROM r WHERE k = 1")
def all_publications(spark: SparkSession, d: str) -> DataFrame:
    return R.dedup_publications(_pubs(spark, d)).select("ord", "owner", "doi", "year")


@BOOK.add("""SELECT c_custkey, list_filter([lower(c_mktsegment), lower(n_name)], lambda t: contains(t, 'machine') OR contains('machine', t)) AS matched FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE contains(lower(n_name), 'nation_1') AND (contains(lower(c_mktsegment), 'machin') ) AND len(list_filter([lower(c_mktsegment), lower(n_name)], lambda t: contains(t, 'machine') OR contains('machine', t))) > 0""")
def compound_search(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    people = people.select("c_custkey", F.col("n_name").alias("institution"), F.col("c_mktsegment").alias("role"), F.array(F.lower("c_mktsegment"), F.lower("n_name")).alias("topics"))
    return R.compound_search(people, "c_custkey", institution="nation_1", role="machin", topic="machine").select("c_custkey", F.col("matched_topics").alias("matched"))


_ALIAS_VALUES = ", ".join(f"('{k}', '{a}')" for k, names in TOPIC_ALIASES.items() for a in names)


@BOOK.add(f"""WITH a(topic, alias) AS (VALUES {_ALIAS_VALUES}), f AS (SELECT DISTINCT topic FROM a WHERE contains(topic, 'network') OR contains(alias, 'network'))
    SELECT 'network' AS term UNION SELECT topic FROM f UNION SELECT alias FROM a JOIN f USING (topic)""")
def alias_closure(spark: SparkSession, d: str) -> DataFrame:
    a = R.alias_table(spark)
    families = a.where(F.col("topic").contains("network") | F.col("alias").contains("network")).select("topic").distinct()
    terms = families.select(F.col("topic").alias("term")).union(a.join(families, "topic").select("alias"))
    return terms.union(spark.range(1).select(F.lit("network"))).distinct()


@BOOK.add("SELECT 'people' AS entity, count(*) AS n FROM customer UNION ALL SELECT 'resources', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def registry_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.counts({"people": table(spark, d, "customer"), "resources": table(spark, d, "part"), "events": table(spark, d, "events"), "documents": table(spark, d, "documents")})


@BOOK.add("SELECT topic, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS topic FROM part) GROUP BY topic")
def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.topic_counts(table(spark, d, "part").select(F.split("p_name", " ").alias("topics")), "topics")


@BOOK.add("SELECT topic, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS topic FROM part) WHERE contains(topic, 'g') GROUP BY topic ORDER BY n DESC, topic LIMIT 5")
def topic_list_search(spark: SparkSession, d: str) -> DataFrame:
    found = R.topic_counts(table(spark, d, "part").select(F.split("p_name", " ").alias("topics")), "topics")
    return found.where(F.col("topic").contains("g")).orderBy(F.desc("n"), "topic").limit(5)


@BOOK.add("""WITH r AS (SELECT s_suppkey AS resource_id, 'user' || (s_suppkey % 40) AS u, 'user' || (s_suppkey % 7) AS o, 'deals in ' || CASE s_suppkey % 3 WHEN 0 THEN 'building goods' WHEN 1 THEN 'machinery parts' ELSE 'other things' END AS d FROM supplier),
    p AS (SELECT c_custkey AS person_id, 'user' || c_custkey AS u, lower(c_mktsegment) AS t FROM customer)
    SELECT person_id, resource_id, round((p.u = r.u)::INT * 1.0 + (p.u = r.o)::INT * 0.9 + contains(r.d, t)::INT * 0.3, 6) AS score FROM p, r WHERE p.u = r.u OR p.u = r.o OR contains(r.d, t)""")
def cross_link_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    about = F.concat(F.lit("deals in "), F.when(k % 3 == 0, "building goods").when(k % 3 == 1, "machinery parts").otherwise("other things"))
    name = lambda x: F.concat(F.lit("user"), x.cast("string"))
    resources = table(spark, d, "supplier").select(k.alias("resource_id"), name(k % 40).alias("path_user"), name(k % 7).alias("owner"), F.lit(None).cast("string").alias("created_by"), about.alias("description"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), name(F.col("c_custkey")).alias("username"), F.array("c_mktsegment").alias("topics"))
    return R.cross_links(people, resources).select("person_id", "resource_id", "score")


_KEYS = {"metal": ("bolt", "gear", "plate", "red"), "size": ("small", "large"), "color": ("red", "blue", "green")}


def _share(words: tuple[str, ...]) -> str:
    return "round((" + " + ".join(f"contains(t, '{w}')::INT" for w in words) + f") / {len(words)}, 6)"


@BOOK.add("WITH x AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part), s AS (" + " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS topic, {_share(ws)} AS score FROM x" for k, ws in _KEYS.items()) + """)
    SELECT topic, p_partkey, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, p_partkey) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def topic_resources_top10(spark: SparkSession, d: str) -> DataFrame:
    return R.topic_resources(table(spark, d, "part"), F.concat_ws(" ", "p_name", "p_type"), "p_partkey", _KEYS).select("topic", "p_partkey", "score", "rank")


_MISSPELT = ["widgit", "gearr", "blot", "smal", "larg", "platee", "gzmo", "rin"]
_SIM = "1 - levenshtein(word, term) / greatest(length(word), length(term))::DOUBLE"
_VOCAB = "v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part), w AS (SELECT unnest([" + sql_quoted(_MISSPELT) + "]) AS word)"


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()


@BOOK.add(f"WITH {_VOCAB}, s AS (SELECT word, term, round({_SIM}, 6) AS similarity FROM w, v WHERE levenshtein(word, term) <= 2) SELECT word, term, similarity FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, term) AS r FROM s WHERE similarity >= 0.6) WHERE r = 1")
def levenshtein_closest(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in _MISSPELT], "word string")
    return R.closest_words(words, _vocabulary(spark, d), least=0.6)


@BOOK.add(f"WITH {_VOCAB}, s AS (SELECT word, term, round({_SIM}, 6) AS similarity FROM w, v) SELECT word, term, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, term) AS rank FROM s WHERE similarity >= 0.5) WHERE rank <= 3")
def suggest_corrections(spark: SparkSession, d: str) -> DataFrame:
    return R.suggestions(_MISSPELT, _vocabulary(spark, d))


@BOOK.add(f"""WITH {_VOCAB}, s AS (SELECT word, term, round({_SIM}, 6) AS similarity FROM w, v WHERE levenshtein(word, term) <= 2),
    c AS (SELECT word, term FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, term) AS r FROM s WHERE similarity >= 0.6) WHERE r = 1),
    q(query_id, query) AS (VALUES (1, 'Smal gearr with the rin'), (2, 'larg platee and Widgit')), t AS (SELECT query_id, unnest(string_split(query, ' ')) AS raw, generate_subscripts(string_split(query, ' '), 1) AS pos FROM q),
    x AS (SELECT query_id, pos, CASE WHEN length(raw) >= 4 AND lower(raw) NOT IN ('with', 'the', 'and') AND term IS NOT NULL THEN CASE WHEN raw[1] <> lower(raw)[1] THEN upper(term[1]) || term[2:] ELSE term END ELSE raw END AS w FROM t LEFT JOIN c ON lower(raw) = word)
    SELECT query_id, string_agg(w, ' ' ORDER BY pos) AS corrected FROM x GROUP BY query_id""")
def correct_queries(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in _MISSPELT], "word string")
    found = R.closest_words(words, _vocabulary(spark, d), least=0.6)
    asked = spark.createDataFrame([(1, "Smal gearr with the rin"), (2, "larg platee and Widgit")], "query_id int, query string")
    return R.correct_queries(asked, found, ("with", "the", "and"))


@BOOK.add("""SELECT id, branch, ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY branch, ord) AS r FROM
    (SELECT 1 AS branch, p_partkey AS ord, p_brand AS id FROM part WHERE contains(p_name, 'gear') UNION ALL SELECT 2, p_partkey, p_brand FROM part WHERE p_type = 'PROMO')) WHERE r = 1""")
def structured_search_dedup(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    a = part.where(F.col("p_name").contains("gear")).select(F.lit(1).alias("branch"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("id"))
    b = part.where("p_type = 'PROMO'").select(F.lit(2), "p_partkey", "p_brand")
    return R.dedup_results(a.union(b)).select("id", "branch", "ord")


@BOOK.add("SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND (SELECT bool_or(contains(lower(p_name), 'gear')) FROM part WHERE p_type = 'PROMO')")
def relevance_gate(spark: SparkSession, d: str) -> DataFrame:
    promo = table(spark, d, "part").where("p_type = 'PROMO'").select("p_partkey", "p_name")
    return R.relevance_gate(promo, "which gear dataset", ("gear", "tweets")).select("p_partkey")


@BOOK.add("SELECT 0 AS p_partkey WHERE false")
def relevance_gate_closed(spark: SparkSession, d: str) -> DataFrame:
    promo = table(spark, d, "part").where("p_type = 'PROMO'").select("p_partkey", "p_name")
    return R.relevance_gate(promo, "which tweets dataset", ("gear", "tweets")).select("p_partkey")


@BOOK.add("""SELECT key, type, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord DESC) AS r FROM (SELECT DISTINCT unnest([lower(p_name), list_extract(string_split_regex(lower(p_name), '\\s+'), -1)]) AS key, 'part' AS type, p_partkey AS id, p_partkey AS ord FROM part)) WHERE r = 1""")
def name_index_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.lit("part").alias("type"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return R.name_index(rows).select("key", "type", "id")


@BOOK.add("SELECT _category, count(*) AS n, count(brand) AS branded FROM (SELECT 'parts' AS _category, p_brand AS brand FROM part UNION ALL SELECT 'suppliers', NULL FROM supplier UNION ALL SELECT 'people', NULL FROM customer) GROUP BY _category")
def resource_union(spark: SparkSession, d: str) -> DataFrame:
    parts = {"parts": table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")), "suppliers": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "people": table(spark, d, "customer").select(F.col("c_custkey").alias("id"))}
    return R.entity_union(parts).groupBy("_category").agg(F.count("*").alias("n"), F.count("brand").alias("branded"))


@BOOK.add("""WITH people AS (SELECT p_partkey AS person_id, p_name AS name FROM part), authors AS (SELECT s_suppkey AS author_id, CASE s_suppkey % 4 WHEN 0 THEN 'small ring' WHEN 1 THEN 'tiny gear' WHEN 2 THEN 'plate holder' ELSE 'unknown thing' END AS name FROM supplier),
    e AS (SELECT lower(name) AS key, max(person_id) AS id FROM people GROUP BY 1), t AS (SELECT key, max(id) AS id FROM (SELECT unnest(string_split(lower(name), ' ')) AS key, person_id AS id FROM people) GROUP BY key),
    w AS (SELECT author_id, unnest(string_split(lower(name), ' ')) AS key, generate_subscripts(string_split(name, ' '), 1) AS pos FROM authors), b AS (SELECT author_id, arg_min(id, pos) AS id FROM w JOIN t USING (key) GROUP BY author_id)
    SELECT author_id, name, coalesce(e.id, b.id) AS person_id FROM authors LEFT JOIN e ON lower(name) = e.key LEFT JOIN b USING (author_id)""")
def author_resolution(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    k = F.col("s_suppkey") % 4
    authors = table(spark, d, "supplier").select(F.col("s_suppkey").alias("author_id"), F.when(k == 0, "small ring").when(k == 1, "tiny gear").when(k == 2, "plate holder").otherwise("unknown thing").alias("name"))
    return R.resolve_authors(authors, people)


@BOOK.add("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def list_doc_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))


@BOOK.add("SELECT source, count(*) AS chunks, arg_min(lang, doc_id) AS doc_type FROM documents GROUP BY source")
def list_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.min_by("lang", "doc_id").alias("doc_type")).orderBy(F.desc("chunks"), "source")
