"""Which plan a query gets, as column expressions over a table of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of queries that a registry answers, and of those that need retrieval, in order.
SIMPLE = (
    (r"^who\s+is\s+[\w\s\-\.]+\??$", "person_lookup"), (r"^tell\s+me\s+about\s+[\w\s\-\.]+\??$", "person_lookup"), (r"^(?:info|information)\s+(?:on|about)\s+[\w\s\-\.]+\??$", "person_lookup"),
    (r"^[\w\s\-\.]+(?:'s)?\s+(?:email|contact)(?:\s+info(?:rmation)?)?\??$", "contact_lookup"), (r"^(?:what(?:'s| is)|get)\s+[\w\s\-\.]+(?:'s)?\s+email\??$", "contact_lookup"), (r"^how\s+(?:do\s+i|can\s+i|to)\s+contact\s+[\w\s\-\.]+\??$", "contact_lookup"),
    (r"^list\s+(?:all\s+)?(?:the\s+)?(?:phd\s+students?|postdocs?|faculty|staff|members?)\??$", "role_list"), (r"^(?:show|get)\s+(?:all\s+)?(?:the\s+)?(?:phd\s+students?|postdocs?|faculty|staff|members?)\??$", "role_list"),
    (r"^who\s+are\s+(?:the\s+)?(?:phd\s+students?|postdocs?|faculty|staff|members?)\??$", "role_list"), (r"^how\s+many\s+(?:phd\s+students?|postdocs?|faculty|staff|members?)\??$", "count_query"),
    (r"^what\s+(?:datasets?|data)\s+do\s+we\s+have\??$", "list_datasets"), (r"^list\s+(?:all\s+)?(?:our\s+)?(?:datasets?|data)\??$", "list_datasets"), (r"^what\s+projects?\s+do\s+we\s+have\??$", "list_projects"), (r"^list\s+(?:all\s+)?(?:our\s+)?projects?\??$", "list_projects"),
    (r"^what\s+(?:funding|grants?)\s+do\s+we\s+have\??$", "list_funding"), (r"^what\s+(?:compute|resources?)\s+(?:do\s+we\s+have|are\s+available)\??$", "list_compute"), (r"^what\s+events?\s+(?:do\s+we\s+have|are\s+there)\??$", "list_events"),
    (r"^how\s+many\s+(?:people|members?|researchers?)\s+(?:do\s+we\s+have|are\s+there)\??$", "count_people"), (r"^who\s+is\s+at\s+[\w\s]+\??$", "institution_lookup"), (r"^(?:people|members?)\s+(?:at|from)\s+[\w\s]+\??$", "institution_lookup"),
)
COMPLEX = (
    (r"papers?\s+(?:about|on|regarding)\s+.+", "semantic_search"), (r"publications?\s+(?:about|on|regarding)\s+.+", "semantic_search"), (r"research\s+(?:about|on|regarding)\s+.+", "semantic_search"),
    (r"how\s+does\s+(?:the\s+lab|our\s+lab|{assistant})\s+.+", "conceptual"), (r"what\s+(?:approach|methodology|methods?)\s+.+", "conceptual"), (r"explain\s+.+", "conceptual"), (r"describe\s+(?:the\s+)?(?:research\s+)?(?:approach|methodology|process)\s+.+", "conceptual"),
    (r"(?:compare|contrast|difference)\s+.+\s+(?:and|with|vs)\s+.+", "comparison"), (r"who\s+(?:works?\s+on|studies|researches?)\s+.{15,}", "topic_search"), (r"researchers?\s+(?:working\s+on|studying|in)\s+.{15,}", "topic_search"),
    (r"what\s+do\s+.+\s+and\s+.+\s+have\s+in\s+common", "multi_hop"), (r"how\s+(?:are|do)\s+.+\s+and\s+.+\s+(?:related|connected|collaborate)", "multi_hop"),
)
KEYWORDS = {
    "high": ("methodology", "approach", "explain", "describe", "compare", "contrast", "difference", "relationship", "impact", "influence", "conceptual", "theoretical", "framework", "paradigm"),
    "medium": ("topic", "area", "field", "research", "work", "papers", "publications", "collaborat", "network", "connection"),
    "low": ("who", "list", "show", "email", "contact", "name", "role", "position", "institution", "university"),
}
REGISTRY_TYPES = ("people", "projects", "funding", "datasets", "events", "compute", "contact")
SEMANTIC_TYPES = ("topics", "publications", "comparison")


#: Words that point to what was said before.
REFERENCES = (
    "he", "him", "his", "she", "her", "hers", "they", "them", "their", "theirs", "it", "its", "that", "this", "these", "those",
    "the person", "the researcher", "the professor", "the author", "same", "above", "mentioned", "discussed",
)
#: Strings that point to what was said before, as a specialist looks for them.
FOLLOWING = (
    " his ", " her ", " their ", " its ", " he ", " she ", " they ", " it ", " him ", " them ", "his ", "her ", "their ", " that ", " this ", " those ", " these ",
    " same ", " similar ", "'s ", "more about", "tell me more", "what else", "follow up", "following up",
)
#: Queries of a simple, then of a complex kind.
PLAIN = (
    r"^what is (the |a )?deadline", r"^when (is|was|did)", r"^who (is|was|did)", r"^where (is|was)", r"^how many", r"^what (was|is) (the )?(date|time|name|title)", r"^which", r"^link to",
    r"^find (the )?(chat|conversation|message|document)", r"^show me (the )?", r"^list (the |all )?",
)
NUANCED = (
    r"synthesize", r"compare.*to", r"relationship between", r"how does.*relate", r"explain (the )?(connection|difference|relationship)", r"implications of", r"what are (all |the )?(ways|methods|approaches)",
    r"analyze", r"critique", r"evaluate", r"multi.?perspective", r"deep dive",
)
#: What only sources outside can answer.
EXTERNAL = (
    "latest version", "current version", "newest version", "how to install", "how do i install", "documentation for", "docs for", "tutorial", "guide for", "pytorch", "tensorflow", "numpy", "pandas", "scikit",
    "conda install", "pip install", "error message", "stack trace", "api reference", "official docs", "beyond the lab", "beyond it", "outside the lab", "in general", "more broadly", "in the field",
    "recent trends", "latest trends", "current trends", "state of the art", "state-of-the-art", "recent developments", "latest developments", "recent research", "latest research", "recent papers",
    "what's new in", "whats new in", "industry trends", "academic trends", "compared to other", "how does this compare", "elsewhere", "other labs", "other researchers",
)
#: Intents and other words for them.
INTENTS = ("lookup", "technical", "explore", "connect", "ambiguous")
INTENT_WORDS = {
    "look_up": "lookup", "look-up": "lookup", "find": "lookup", "search": "lookup", "tech": "technical", "debug": "technical", "setup": "technical", "exploration": "explore", "analysis": "explore", "analyze": "explore",
    "connection": "connect", "collaborate": "connect", "collaboration": "connect", "unknown": "ambiguous", "unclear": "ambiguous",
}
#: Words of a query that are no search terms.
NO_TERMS = (
    "who", "what", "where", "when", "how", "why", "which", "is", "are", "was", "were", "be", "been", "being", "the", "a", "an", "and", "or", "but", "if",
    "then", "do", "does", "did", "done", "doing", "we", "i", "you", "they", "he", "she", "it", "have", "has", "had", "having", "all", "any", "some", "no",
    "not", "list", "tell", "me", "about", "describe", "show", "find", "get", "give", "can", "could", "would", "should", "may", "might", "on", "in", "at",
    "to", "for", "of", "with", "by", "from", "up", "down", "into", "onto", "upon", "this", "that", "these", "those", "there", "here", "please", "thanks",
    "thank",
)


def _first(query: Column, patterns: tuple, assistant: str = "this\\s+assistant") -> Column:
    return F.coalesce(*[F.when(F.rlike(query, F.lit("(?i)" + p.replace("{assistant}", assistant))), F.lit(kind)) for p, kind in patterns])


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _count(query: Column, words: tuple[str, ...]) -> Column:
    return sum((query.contains(w).cast("int") for w in words), F.lit(0))


def complexity(query: Column) -> Column:
    """High keywords and half the medium ones over all keywords found, at most 1."""
    low = F.lower(query)
    high, medium, plain = (_count(low, KEYWORDS[k]) for k in ("high", "medium", "low"))
    return F.least((high + 0.5 * medium) / F.greatest(high + medium + plain, F.lit(1)), F.lit(1.0))


def route(queries: DataFrame, query: str = "query", entity_types: str | None = None, kind: str | None = None, confidence: str | None = None, assistant: str = r"this\s+assistant") -> DataFrame:
    """Adds ``decision``, ``confidence`` and ``pattern``: simple patterns, then complex ones, then the classification
    (columns ``kind`` structured/semantic/hybrid, ``confidence`` and ``entity_types``), where there is one.  ``assistant`` is a pattern of the assistant's name."""
    low = F.lower(F.trim(query))
    words = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    simple, hard = _first(low, SIMPLE), _first(low, COMPLEX, assistant)
    sure = F.round(F.when(words <= 5, 0.98).when(words > 10, 0.85).otherwise(0.95), 6)
    deep = F.least(F.lit(0.85) + F.when(words > 10, 0.08).otherwise(0.0), F.lit(0.95))
    deep = F.round(F.when(complexity(F.col(query)) > 0.5, F.least(deep + 0.05, F.lit(0.95))).otherwise(deep), 6)
    known, belief, types = (F.col(x) if x else F.lit(None) for x in (kind, confidence, entity_types))
    types = types.cast("array<string>")
    has = lambda names: F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, names))), F.lit(False))
    by_type = F.when(F.coalesce(F.size(types), F.lit(0)) <= 0, "rag_only").when(has(REGISTRY_TYPES) & ~has(SEMANTIC_TYPES), "registry_only").when(has(SEMANTIC_TYPES) & ~has(REGISTRY_TYPES), "rag_only").when(has(REGISTRY_TYPES) & has(SEMANTIC_TYPES), "hybrid")
    classified = F.when((known == "structured") & (belief >= 0.9), "registry_only").when(known == "semantic", "rag_only").when((known == "structured") & (belief < 0.7), "hybrid").when(known.isNull(), "hybrid").otherwise(F.coalesce(by_type, F.lit("hybrid")))
    decision = F.when(simple.isNotNull(), "registry_only").when(hard.isNotNull(), "rag_only").otherwise(classified)
    level = F.when(simple.isNotNull(), sure).when(hard.isNotNull(), deep).otherwise(F.coalesce(belief.cast("double"), F.lit(0.5)))
    return queries.withColumn("pattern", F.coalesce(simple, hard)).withColumn("decision", decision).withColumn("route_confidence", level)


def vote_intent(queries: DataFrame, patterns: dict[str, tuple[str, ...]], query: str = "query") -> DataFrame:
    """The intent with most matching patterns, first of equals, and its share; null without any."""
    votes = F.array(*[F.struct(sum((F.rlike(F.lower(query), F.lit(p)).cast("int") for p in ps), F.lit(0)).alias("n"), F.lit(-i).alias("back"), F.lit(name).alias("intent")) for i, (name, ps) in enumerate(patterns.items())])
    best = F.array_max(votes)
    total = F.aggregate(votes, F.lit(0), lambda s, v: s + v["n"])
    return queries.withColumn("intent", F.when(best["n"] > 0, best["intent"])).withColumn("share", F.round(F.try_divide(best["n"], total), 6))


def needs_reformulation(query: Column) -> Column:
    """A pronoun or another word for what was said before."""
    return F.rlike(query, F.lit(r"(?i)\b(" + "|".join(REFERENCES) + r")\b"))


def follows(query: Column) -> Column:
    """Holds one of the strings that follow up, or begins with one."""
    low = F.lower(query)
    return _any(low, FOLLOWING) | reduce(lambda a, b: a | b, [low.startswith(w.strip()) for w in FOLLOWING])


def words_of(query: Column) -> Column:
    return F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))


def query_complexity(query: Column) -> Column:
    """``simple`` by the plain patterns, ``complex`` by the nuanced ones, else by length: under 10 words simple, over 25
    complex, ``medium`` between."""
    low = F.lower(query)
    matches = lambda patterns: F.rlike(low, F.lit("|".join(f"(?:{p})" for p in patterns)))
    n = words_of(query)
    return F.when(matches(PLAIN), "simple").when(matches(NUANCED), "complex").when(n < 10, "simple").when(n > 25, "complex").otherwise("medium")


def looks_external(query: Column) -> Column:
    return _any(F.lower(query), EXTERNAL)


def results_weak(structured: Column, semantic: Column, top_text: Column, external: Column, error: Column) -> Column:
    """Whether numbers of structured and semantic results (and the first text) are too little to answer with."""
    alone = (structured == 0) & (semantic > 0) & (F.length(F.coalesce(top_text, F.lit(""))) < 50)
    return F.coalesce(error, F.lit(False)) | ((structured == 0) & (semantic == 0)) | (external & (structured == 0)) | alone


def valid_intent(intent: Column) -> Column:
    """The intent of that name, or of one of its other names; else ``ambiguous``."""
    low = F.trim(F.lower(intent))
    return F.coalesce(F.when(low.isin(*INTENTS), low), F.element_at(F.create_map(*[F.lit(x) for pair in INTENT_WORDS.items() for x in pair]), low), F.lit("ambiguous"))


def search_terms(query: Column, captured: Column | None = None) -> Column:
    """``captured`` groups of a pattern without edge punctuation, then words longer than two that are no stop words."""
    none = F.array().cast("array<string>")
    groups = F.coalesce(captured, none) if captured is not None else none
    groups = F.filter(F.transform(F.filter(groups, lambda g: F.coalesce(g, F.lit("")) != ""), lambda g: F.trim(F.btrim(F.trim(g), F.lit("?.,!")))), lambda g: F.length(g) > 2)
    stop = F.array(*map(F.lit, NO_TERMS))
    held = F.transform(groups, F.lower)
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"(?U)\w+"), F.lit(0))), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w) & ~F.array_contains(held, w))
    return F.concat(groups, words)


def analyze(queries: DataFrame, query: str = "query", assistant: str = r"this\s+assistant") -> DataFrame:
    """Everything a route rests on, as columns."""
    q = F.col(query)
    low = F.lower(F.trim(q))
    out = route(queries, query, assistant=assistant).withColumn("simple_match", _first(low, SIMPLE)).withColumn("complex_match", _first(low, COMPLEX, assistant))
    out = out.withColumn("keyword_score", F.round(complexity(q), 6)).withColumn("query_length", F.length(q)).withColumn("word_count", words_of(q))
    return out.withColumn("has_question_mark", F.trim(q).endswith("?")).withColumn("search_terms", search_terms(q))


def subqueries(query: Column) -> Column:
    """The query and its parts around and/or, distinct."""
    parts = F.filter(F.transform(F.split(query, r"(?i)\s+(?:and|or)\s+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.concat(F.array(query), parts))


def person_names(query: Column) -> Column:
    """Runs of two or three capitalised words."""
    return F.array_distinct(F.regexp_extract_all(query, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][a-z]+){1,2}\b"), F.lit(0)))
