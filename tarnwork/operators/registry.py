"""Structured lookups over entity tables.

Ordered first-match lookups of the kind "the first row that ..." take the column that
carries the source order; ties in a ranking end with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aliases import TOPIC_ALIASES, closure
from ..functions.text import any_of, normalize_name, sequence_ratio, similarity_ratio

#: What a role stands for in a compound search.
ROLE_TERMS = {"student": ("student", "phd"), "faculty": ("faculty", "professor", "director"), "researcher": ("research", "scientist", "scholar", "fellow"), "postdoc": ("postdoc", "postdoctoral")}
#: The keywords by which resources belong to a topic.
TOPIC_KEYWORDS = {
    "bibliometrics": ("openalex", "semantic scholar", "mag", "wos", "citation", "publication", "author"),
    "natural language processing": ("embedding", "word2vec", "specter", "nlp", "text", "language"),
    "machine learning": ("embedding", "model", "neural", "deep learning", "ai"),
    "network science": ("network", "graph", "citation", "collaboration"),
    "social media": ("reddit", "twitter", "4chan", "weibo", "telegram", "social"),
    "patents": ("patent", "patstat", "uspto", "invention", "innovation"),
    "biomedical": ("pubmed", "mesh", "medical", "health", "clinical"),
    "computational social science": ("social", "behavior", "survey", "experiment"),
}


def contains(column: Column, query: str) -> Column:
    """Case-insensitive containment; null never matches."""
    return F.coalesce(F.lower(column.cast("string")).contains(query.lower()), F.lit(False))


def any_contains(items: Column, query: str, both_ways: bool = False) -> Column:
    low = query.lower()
    test = lambda x: F.lower(x).contains(low) | (F.lit(low).contains(F.lower(x)) if both_ways else F.lit(False))
    return F.coalesce(F.exists(items, test), F.lit(False))


def name_matches(name: Column, query: str) -> Column:
    """Equal, containing the query, or with a token equal to it."""
    low = query.lower().strip()
    return contains(name, low) | F.coalesce(F.array_contains(F.split(F.lower(name), r"\s+"), low), F.lit(False))


def first_match(rows: DataFrame, test: Column, order: str) -> DataFrame:
    return rows.where(test).orderBy(order).limit(1)


def tiered_match(rows: DataFrame, tiers: list[Column], order: str) -> DataFrame:
    """The first row of the best tier; ``tier`` counts from 1."""
    tier = F.coalesce(*[F.when(t, F.lit(i + 1)) for i, t in enumerate(tiers)])
    return rows.withColumn("tier", tier).where("tier is not null").orderBy("tier", order).limit(1)


def search(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """All rows where one of the columns contains the query."""
    return rows.where(any_of([contains(F.col(c), query) for c in columns]))


def platforms(value: Column, is_array: bool) -> Column:
    """A platform given as a string or a list, as a list."""
    return value if is_array else F.array(value)


def term_matches(topic: Column, term: str) -> Column:
    """Substring; or all words in it; or at least 60 % of two or more words."""
    words = sorted(set(term.split()))
    hits = sum((topic.contains(w).cast("int") for w in words), F.lit(0))
    test = topic.contains(term)
    if words:
        test = test | (hits == len(words))
    if len(words) >= 2:
        test = test | (hits >= 0.6 * len(words))
    return test


def match_topics(rows: DataFrame, topics: str, query: str, order: str) -> DataFrame:
    """Rows with ``matched_topics`` for a topic and its aliases, most matches first."""
    terms = closure(query)
    hit = lambda t: any_of([term_matches(F.lower(t), term) for term in terms])
    found = rows.withColumn("matched_topics", F.filter(F.array_distinct(F.coalesce(F.col(topics), F.array().cast("array<string>"))), hit))
    return found.where(F.size("matched_topics") > 0).orderBy(F.desc(F.size("matched_topics")), order)


def compound_search(rows: DataFrame, order: str, institution: str | None = None, role: str | None = None, topic: str | None = None) -> DataFrame:
    """Conjunction of an institution, a role with its synonyms, and a topic matched both ways with its aliases."""
    if institution:
        rows = rows.where(contains(F.col("institution"), institution))
    if role:
        rows = rows.where(any_of([contains(F.col("role"), t) for t in ROLE_TERMS.get(role.lower(), (role.lower(),))]))
    if topic:
        terms = closure(topic)
        hit = lambda t: any_of([F.lower(t).contains(x) | F.lit(x).contains(F.lower(t)) for x in terms])
        rows = rows.withColumn("matched_topics", F.slice(F.array_sort(F.array_distinct(F.filter("topics", hit))), 1, 5)).where(F.size("matched_topics") > 0)
    return rows.orderBy(order)


def publication_search(pubs: DataFrame, query: str) -> DataFrame:
    """Publications by author, title, venue, topic or co-author, with the reason; newest and most cited first,
    and one row per DOI (rows without a DOI all stay).

    ``pubs(owner, title, venue, topics, authors, doi, year, citation_count, ord)``.  A rule over all words of the
    query longer than two holds for a query without such words.
    """
    low = query.lower().strip()
    words = sorted(set(low.split()))
    long = [w for w in words if len(w) > 2]
    every = lambda column, ws: reduce(lambda a, b: a & b, [column.contains(w) for w in ws], F.lit(True))
    owner, title = F.lower("owner"), F.lower(F.coalesce("title", F.lit("")))
    by_owner = owner.contains(low) | F.array_contains(F.split(owner, r"\s+"), low) | every(owner, long)
    topic = F.filter("topics", lambda t: F.lower(t).contains(low) | every(F.lower(t), words))
    parts = lambda a: F.split(F.replace(F.lower(a), F.lit("."), F.lit("")), r"\s+")
    known = lambda a: reduce(lambda x, y: x & y, [F.array_contains(parts(a), w) for w in words if len(w) > 1], F.lit(bool(words)))
    author = F.filter("authors", lambda a: F.lower(a).contains(low) | known(a))
    reason = (
        F.when(by_owner, F.concat(F.lit("Author: "), F.col("owner"))).when(title.contains(low), "Title match").when(every(title, long), "Title (partial)")
        .when(F.lower(F.coalesce("venue", F.lit(""))).contains(low), F.concat(F.lit("Venue: "), F.col("venue")))
        .when(F.size(topic) > 0, F.concat(F.lit("Topic: "), topic[0])).when(F.size(author) > 0, F.concat(F.lit("Co-author: "), author[0]))
    )
    return dedup_publications(pubs.withColumn("match_reason", reason).where("match_reason is not null"))


def dedup_publications(pubs: DataFrame) -> DataFrame:
    """One row per DOI: the newest, then most cited, then first; rows without a DOI are never duplicates."""
    order = [F.desc(F.coalesce("year", F.lit(0))), F.desc(F.coalesce("citation_count", F.lit(0))), F.col("ord")]
    key = F.when(F.coalesce("doi", F.lit("")) != "", F.col("doi")).otherwise(F.concat(F.lit("row:"), F.col("ord").cast("string")))
    ranked = pubs.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank").orderBy(*order)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: an upsert log read as a table."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_row")).select(key, "_row.*")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_row")).select(key, "_row.*")


def name_index(entities: DataFrame) -> DataFrame:
    """Keys of ``entities(type, id, name, ord)``: the lower-case name and its last word; later rows win."""
    low = F.lower("name")
    keys = entities.select(F.explode(F.array_distinct(F.array(low, F.element_at(F.split(low, r"\s+"), -1)))).alias("key"), "type", "id", "ord")
    return last_wins(keys, "key", "ord")


def entity_union(parts: dict[str, DataFrame]) -> DataFrame:
    """All categories in one table with ``_category``; missing columns are null."""
    tagged = [rows.withColumn("_category", F.lit(name)) for name, rows in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def dedup_results(results: DataFrame) -> DataFrame:
    """First-seen result of each id over ``results(branch, ord, id, ...)``; rows without an id go."""
    order = Window.partitionBy("id").orderBy("branch", "ord")
    return results.where("id is not null").withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank").orderBy("branch", "ord")


def relevance_gate(results: DataFrame, query: str, terms: tuple[str, ...]) -> DataFrame:
    """If the query names data terms and no result's text holds one of them, nothing is left."""
    wanted = [t for t in terms if t in query.lower()]
    if not wanted:
        return results
    whole = F.lower(F.to_json(F.struct(*results.columns)))
    gate = results.agg(F.coalesce(F.bool_or(any_of([whole.contains(t) for t in wanted])), F.lit(False)).alias("_open"))
    return results.join(F.broadcast(gate)).where("_open").drop("_open")  # the gate is one row


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows ``(entity, n)``."""
    return reduce(DataFrame.union, [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n") for name, rows in tables.items()])


def topic_counts(rows: DataFrame, topics: str) -> DataFrame:
    """Rows per topic; a topic listed twice in a row counts twice."""
    return rows.select(F.explode(topics).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def _pieces(text: Column, n: int) -> Column:
    """All runs of ``n`` characters of a text."""
    last = F.length(text) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def holding(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """All ``(topic, about)`` of distinct ``needles(topic)`` and ``texts(about)`` where the text contains the topic: they
    meet on the first five characters of the topic, then the test is exact."""
    starts = needles.withColumn("key", F.left("topic", F.lit(5)))
    held = texts.withColumn("key", F.explode_outer(F.array_distinct(F.flatten(F.array(F.array(F.lit("")), *[_pieces(F.col("about"), n) for n in range(1, 6)])))))
    return starts.join(held, "key").where(F.contains("about", "topic")).select("topic", "about")


def groups(persons: Column, held: Column, known: Column, size: int = 16) -> Column:
    """Structs ``(persons, held)`` whose products are all pairs of a block of people and one of resources without the
    ``known`` ones: ``size`` people at a time, as Spark holds all rows that arise from one row before it passes them
    on; people with known pairs, structs ``(person_id, own)``, are alone."""
    plain = F.when(known.isNull(), persons).otherwise(F.array_except(persons, F.transform(known, lambda k: k["person_id"])))
    starts = F.when(F.size(plain) > 0, F.sequence(F.lit(1), F.size(plain), F.lit(size))).otherwise(F.array().cast("array<int>"))
    alone = F.transform(known, lambda k: F.struct(F.array(k["person_id"]).alias("persons"), F.array_except(held, k["own"]).alias("held")))
    many = F.transform(starts, lambda i: F.struct(F.slice(plain, i, size).alias("persons"), held.alias("held")))
    return F.when(known.isNull(), many).otherwise(F.concat(many, alone))


def cross_links(people: DataFrame, resources: DataFrame, small_side_rows: int = 1_000_000, block: int = 1000) -> DataFrame:
    """Additive evidence that ``people(person_id, username, topics)`` use ``resources(resource_id, path_user, owner,
    created_by, description)``: 1.0 for the directory, 0.9 for being listed, 0.7 for a name more than 0.8 similar to
    the owner (if people have a ``name``), 0.3 for a topic in the description.

    The evidences are equi-joins. A topic meets the distinct descriptions that hold its first five characters, a name
    the distinct owners with which it shares two successive characters, or all: unequal strings of a ratio over 0.8
    always do, as their equal characters are more than the pieces they come in. Then the test is exact.

    Pairs that only a topic links can be as many as people times resources. They are never shuffled: people of the same
    topics and resources of the same descriptions are dealt in blocks of about ``block``, only pairs of blocks are
    exchanged, and their rows arise where they are written, a few people at a time.
    """
    user = people.where("username is not null and username <> ''").select("person_id", F.lower("username").alias("username"))
    own = user.join(resources.select("resource_id", F.lower("path_user").alias("username")), "username").select("person_id", "resource_id", F.lit(1.0).alias("score"), F.lit("owns_directory").alias("reason"))
    listed = resources.select("resource_id", F.explode(F.array_distinct(F.array(F.lower("owner"), F.lower("created_by")))).alias("username"))
    listed = user.join(listed, "username").select("person_id", "resource_id", F.lit(0.9).alias("score"), F.lit("listed_owner").alias("reason")).distinct()
    links = own.union(listed)
    if "name" in people.columns:
        names = people.select("person_id", normalize_name(F.coalesce("name", F.lit(""))).alias("name"))
        owners = resources.where("owner <> ''").select("resource_id", normalize_name(F.col("owner")).alias("owned"))
        keyed = lambda rows, c: rows.select(c).distinct().withColumn("key", F.explode_outer(F.array_distinct(F.concat(F.array(F.col(c)), _pieces(F.col(c), 2)))))
        near = 5 * F.least(F.length("name"), F.length("owned")) * 2 >= 4 * (F.length("name") + F.length("owned"))
        pairs = keyed(names, "name").join(keyed(owners, "owned"), "key").where(near).select("name", "owned").distinct()
        pairs = pairs.where(sequence_ratio(F.col("name"), F.col("owned")) > 0.8)
        links = links.union(names.join(pairs, "name").join(owners, "owned").select("person_id", "resource_id", F.lit(0.7).alias("score"), F.lit("name_match").alias("reason")).distinct())
    told = links.groupBy("person_id", "resource_id").agg(F.sum("score").alias("score"), F.collect_list("reason").alias("reasons"))

    wanted = people.select("person_id", F.transform("topics", lambda t: F.lower(t)).alias("topics")).groupBy("person_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("interest"))
    about = resources.select("resource_id", F.lower(F.coalesce("description", F.lit(""))).alias("about")).groupBy("resource_id").agg(F.array_sort(F.collect_set("about")).alias("profile"))
    topics = wanted.select("interest").distinct().select("interest", F.explode("interest").alias("topic")).where("topic is not null")
    texts = about.select("profile").distinct().select("profile", F.explode("profile").alias("about"))
    holds = holding(topics.select("topic").distinct(), texts.select("about").distinct())
    meet = topics.join(holds, "topic").join(texts, "about").select("interest", "profile").distinct()

    block_of = lambda rows, by, n: F.pmod(F.xxhash64(by), F.greatest(F.lit(1), F.ceil(F.col(n) / block))).cast("long")
    asking = wanted.join(wanted.groupBy("interest").agg(F.count("*").alias("n")), "interest")
    asking = asking.select("person_id", "interest", block_of(asking, "person_id", "n").alias("p"))
    offered = about.join(about.groupBy("profile").agg(F.count("*").alias("n")), "profile")
    offered = offered.select("resource_id", "profile", block_of(offered, "resource_id", "n").alias("r"))

    # Pairs told by other evidence get the topic's here and are left out below.
    same = told.alias("t").join(asking.alias("w"), F.expr("t.person_id <=> w.person_id")).join(offered.alias("a"), F.expr("t.resource_id <=> a.resource_id"))
    same = same.select("t.*", "interest", "p", "profile", "r")
    both = same.join(meet.withColumn("met", F.lit(True)), ["interest", "profile"], "left")
    score = F.round(F.col("score") + F.when(F.col("met"), 0.3).otherwise(0.0), 6)
    both = both.select("person_id", "resource_id", score.alias("score"), F.array_sort(F.when(F.col("met"), F.array_append("reasons", F.lit("topic_match"))).otherwise(F.col("reasons"))).alias("reasons"))

    every = lambda c: F.transform(F.collect_list(F.struct(c)), lambda x: x[c])  # noqa: E731 (nulls too)
    known = same.groupBy("interest", "p", "profile", "r", "person_id").agg(every("resource_id").alias("own"))
    known = known.groupBy("interest", "p", "profile", "r").agg(F.collect_list(F.struct("person_id", "own")).alias("known"))
    blocks = meet.join(asking.groupBy("interest", "p").agg(every("person_id").alias("persons")), "interest").join(offered.groupBy("profile", "r").agg(every("resource_id").alias("held")), "profile")
    blocks = blocks.join(known, ["interest", "p", "profile", "r"], "left")
    blocks = blocks.repartition(int(people.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("interest", "p"), F.xxhash64("profile", "r"))
    met = blocks.select(F.explode_outer(groups(F.col("persons"), F.col("held"), F.col("known"))).alias("g"))
    met = met.select("g.*", F.lit(0.3).alias("score"), F.array(F.lit("topic_match")).alias("reasons"))
    both = both.select(F.array("person_id").alias("persons"), F.array("resource_id").alias("held"), "score", "reasons")
    rows = met.union(both).select(F.explode("persons").alias("person_id"), "held", "score", "reasons")
    return rows.select("person_id", F.explode("held").alias("resource_id"), "score", "reasons")


def topic_resources(resources: DataFrame, text: Column, id_column: str, keywords: dict[str, tuple[str, ...]], top: int = 10) -> DataFrame:
    """The share of a topic's keywords that a resource's text holds; the ``top`` resources of each topic."""
    low = F.lower(text)
    scored = F.array(*[F.struct(F.lit(t).alias("topic"), (sum((low.contains(k).cast("int") for k in ks), F.lit(0)) / len(ks)).alias("score")) for t, ks in keywords.items()])
    rows = resources.select(id_column, F.explode_outer(scored).alias("s")).select(id_column, "s.*").where("score > 0").withColumn("score", F.round("score", 6))
    order = Window.partitionBy("topic").orderBy(F.desc("score"), id_column)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def alias_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, a) for k, names in TOPIC_ALIASES.items() for a in names], "topic string, alias string")


def resolve_authors(authors: DataFrame, people: DataFrame) -> DataFrame:
    """Ids for ``authors(author_id, name)``: the person of equal name, else the last person that has the first
    matching word of the name; ``people(person_id, name, ord)``."""
    exact = people.select(F.lower("name").alias("key"), "person_id", "ord")
    exact = last_wins(exact, "key", "ord").select("key", F.col("person_id").alias("exact_id"))
    token = last_wins(people.select(F.explode(F.split(F.lower("name"), r"\s+")).alias("key"), "person_id", "ord"), "key", "ord")
    words = authors.select("author_id", F.posexplode(F.split(F.lower("name"), r"\s+")).alias("pos", "key")).join(token.select("key", "person_id"), "key")
    by_token = words.groupBy("author_id").agg(F.min_by("person_id", "pos").alias("token_id"))
    out = authors.withColumn("key", F.lower("name")).join(exact, "key", "left").join(by_token, "author_id", "left")
    return out.select("author_id", "name", F.coalesce("exact_id", "token_id").alias("person_id"))


def closest_words(words: DataFrame, vocabulary: DataFrame, most_distance: int = 2, least: float = 0.85) -> DataFrame:
    """Each ``word``'s nearest ``term`` within an edit distance, of similarity ``least`` or more; ties to the first term.

    Within distance d, two words share one of d + 1 pieces at a shifted place; deletion signatures make that an
    equi-join: words within two edits share a variant with at most two letters deleted.  Words of other lengths than
    the given ones allow are in no pair and get no variants.
    """
    lengths = [r["n"] for r in words.select(F.length("word").alias("n")).where("n > 0").distinct().collect()]  # at most as many as the longest word has letters
    close = sorted({n + d for n in lengths for d in range(-most_distance, most_distance + 1)})
    vocabulary = vocabulary.where(F.length("term").isin(*close)) if close else vocabulary.where(F.lit(False))

    def variants(rows: DataFrame, column: str) -> DataFrame:
        drop = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.left(x, i - 1), F.substr(x, i + 1)))
        one = F.array_union(F.array(F.col(column)), drop(F.col(column)))
        two = F.array_distinct(F.flatten(F.transform(one, lambda x: F.when(F.length(x) > 0, F.array_union(F.array(x), drop(x))).otherwise(F.array(x)))))
        return rows.where(F.length(column) > 0).withColumn("_key", F.explode_outer(two if most_distance > 1 else one))

    pairs = variants(words, "word").join(variants(vocabulary, "term"), "_key").select("word", "term").distinct()
    distance = F.levenshtein("word", "term", most_distance)
    scored = pairs.where((distance >= 0) & (distance <= most_distance)).withColumn("similarity", F.round(similarity_ratio(F.col("word"), F.col("term")), 6)).where(F.col("similarity") >= least)
    order = Window.partitionBy("word").orderBy(F.desc("similarity"), "term")
    return scored.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def suggestions(words: list[str], vocabulary: DataFrame, top: int = 3, least: float = 0.5) -> DataFrame:
    """The ``top`` terms of similarity ``least`` or more for each of a few given words."""
    scored = vocabulary.select("term", F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.round(similarity_ratio(F.lit(w), F.col("term")), 6).alias("similarity")) for w in words])).alias("s"))
    scored = scored.select("s.word", "term", "s.similarity").where(F.col("similarity") >= least)
    order = Window.partitionBy("word").orderBy(F.desc("similarity"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def correct_queries(queries: DataFrame, corrections: DataFrame, stopwords: tuple[str, ...]) -> DataFrame:
    """``corrected`` for ``queries(query_id, query)``: words replaced by ``corrections(word, term)``, keeping a
    leading capital; stop words and words shorter than 4 stay."""
    words = queries.select("query_id", F.posexplode(F.split("query", " ")).alias("pos", "raw")).withColumn("word", F.lower("raw"))
    able = (F.length("word") >= 4) & ~F.col("word").isin(*stopwords)
    joined = words.join(corrections.select("word", "term"), "word", "left")
    new = F.when(able & F.col("term").isNotNull(), F.when(F.substr("raw", F.lit(1), F.lit(1)) != F.substr("word", F.lit(1), F.lit(1)), F.initcap("term")).otherwise(F.col("term"))).otherwise(F.col("raw"))
    return joined.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", new.alias("w")))), lambda x: x["w"]), " ").alias("corrected"))


def people_by_name(names: Column, query: str) -> Column:
    """Both ways: the query in the name or the name in the query, after normalising."""
    plain, low = normalize_name(names), query.lower().strip().replace("-", " ").replace("_", " ")
    return plain.contains(low) | F.lit(low).contains(plain)
