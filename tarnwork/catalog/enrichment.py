"""Enrichment queries over documents, conversations, and texts derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import enrichment as E
from ..session import documents, table
from ._book import Book, sql_quoted

BOOK = Book()
TAXONOMY = {
    "Hand": {"keywords": {"hand": 1.5, "hend": 2.0, "hash": 1.3}, "phrases": {"of the": 2.0, "and the": 1.5}},
    "Motion": {"keywords": {"edtion": 2.0, "tion": 1.0, "estion": 1.8}, "phrases": {"in the": 2.5}},
    "Things": {"keywords": {"thing": 1.0, "ndble": 1.5, "thand": 1.2}, "phrases": {"to the": 1.0, "the thing": 2.5}},
}
#: Derived texts with dates and grants, built alike in both engines.
_TEXT = """txt AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Submission deadline ' || strftime(o_orderdate, '%B %-d, %Y') || ' for NSF-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') WHEN 1 THEN 'The workshop is on ' || strftime(o_orderdate, '%m/%d/%Y') || ' under MURI and FY' || strftime(o_orderdate, '%y')
    WHEN 2 THEN 'Published in Q' || quarter(o_orderdate) || ' ' || CAST(year(o_orderdate) + 16 AS VARCHAR) || ' by NIH' WHEN 3 THEN 'Version ' || CAST(year(o_orderdate) + 16 AS VARCHAR) || strftime(o_orderdate, '-%m-%d') || ' and R01-GM' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') WHEN 4 THEN 'since ' || CAST(year(o_orderdate) + 16 AS VARCHAR) || ' the plan' ELSE 'no date at all' END AS text FROM orders)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    k, when = F.col("o_orderkey") % 6, F.col("o_orderdate")
    later = (F.year(when) + 16).cast("string")
    key = lambda n: F.lpad(F.col("o_orderkey").cast("string"), n, "0")
    body = (
        F.when(k == 0, F.concat(F.lit("Submission deadline "), F.date_format(when, "MMMM d, yyyy"), F.lit(" for NSF-"), key(7))).when(k == 1, F.concat(F.lit("The workshop is on "), F.date_format(when, "MM/dd/yyyy"), F.lit(" under MURI and FY"), F.date_format(when, "yy")))
        .when(k == 2, F.concat(F.lit("Published in Q"), F.quarter(when).cast("string"), F.lit(" "), later, F.lit(" by NIH"))).when(k == 3, F.concat(F.lit("Version "), later, F.date_format(when, "-MM-dd"), F.lit(" and R01-GM"), key(6)))
        .when(k == 4, F.concat(F.lit("since "), later, F.lit(" the plan"))).otherwise("no date at all")
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), body.alias("text"))


@BOOK.add(f"WITH {_TEXT} SELECT id, regexp_extract_all(text, '\\b(20[12]\\d)[-/](0[1-9]|1[0-2])(?:[-/](0[1-9]|[12]\\d|3[01]))?\\b') AS found FROM txt")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("id", D.matches(F.col("text"), "iso").alias("found"))


@BOOK.add(f"WITH {_TEXT} SELECT id, regexp_extract_all(text, '\\b(0?[1-9]|1[0-2])/(0?[1-9]|[12]\\d|3[01])/(\\d{{4}}|\\d{{2}})\\b') AS found FROM txt")
def us_dates(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("id", D.matches(F.col("text"), "us").alias("found"))


@BOOK.add(f"WITH {_TEXT} SELECT id, regexp_extract_all(text, '(?i)\\bQ([1-4])[-\\s]*(20[12]\\d)\\b') AS quarters, regexp_extract_all(text, '(?i)\\bFY[-\\s]?(\\d{{4}}|\\d{{2}})\\b') AS fiscal FROM txt")
def quarters_fiscal_years(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("id", D.matches(F.col("text"), "quarter").alias("quarters"), D.matches(F.col("text"), "fiscal").alias("fiscal"))


@BOOK.add(f"""WITH {_TEXT} SELECT id, CASE WHEN id % 6 = 1 THEN CAST(split_part(split_part(text, '/', 3), ' ', 1) AS INT) WHEN id % 6 = 2 THEN CAST(split_part(text, ' ', 4) AS INT) WHEN id % 6 = 3 THEN CAST(text[9:12] AS INT) WHEN id % 6 = 4 THEN CAST(text[7:10] AS INT)
    WHEN id % 6 = 0 AND regexp_matches(text, ', 20[12]') THEN CAST(regexp_extract(text, ', (20[12]\\d)', 1) AS INT) END AS year, CASE id % 6 WHEN 1 THEN 'event' WHEN 2 THEN 'publication' WHEN 3 THEN 'unknown' WHEN 4 THEN 'unknown' WHEN 0 THEN CASE WHEN regexp_matches(text, ', 20[12]') THEN 'deadline' END END AS context FROM txt""")
def date_primary(spark: SparkSession, d: str) -> DataFrame:
    found = D.primary(F.col("dates"))
    return D.extract(_texts(spark, d)).select("id", found["year"].alias("year"), found["context"].alias("context"))


@BOOK.add()
def date_extract(spark: SparkSession, d: str) -> DataFrame:
    return D.extract(_texts(spark, d)).select("id", F.explode("dates").alias("date")).select("id", "date.*")


@BOOK.add(f"""WITH {_TEXT} SELECT id, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, '\\bNSF[-\\s#]?(\\d{{7}})\\b', 1), lambda x: 'NSF-' || x), list_transform(regexp_extract_all(text, '\\bR01-GM\\d{{6}}\\b'), lambda x: 'NIH-R01-GM-' || x[7:])))) AS grants,
    regexp_extract_all(text, '\\b(MURI|APTO|CAREER|EAGER|RAPID|STTR|SBIR)\\b', 1) AS projects, list_sort(list_filter([{sql_quoted(list(E.FUNDERS))}], lambda f: contains(text, f))) AS funders FROM txt""")
def grant_ids(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _texts(spark, d).select("id", E.grant_ids(t).alias("grants"), E.projects(t).alias("projects"), E.funders(t).alias("funders"))


_KEY = "regexp_extract_all(text, '\\b[a-z]+(?:-[a-z]+)*\\b|\\b[A-Z]{2,}\\b')"
_DOCS = "docs AS (SELECT doc_id, regexp_replace(text, '[^ -~]', 'Z', 'g') AS text FROM documents)"
_VALID = f"length(term) >= 2 AND term NOT IN ({sql_quoted(list(E.STOPWORDS))})"
_IDF = f"{_DOCS}, toks AS (SELECT doc_id, list_transform({_KEY}, lambda w: lower(w)) AS w FROM docs), idf AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM docs) / count(*)::DOUBLE) AS idf FROM (SELECT unnest(list_distinct(w)) AS term FROM toks) WHERE {_VALID} GROUP BY term)"


def _ascii(spark: SparkSession, d: str) -> DataFrame:
    """Word boundaries differ between the engines outside ASCII, so other letters become a capital."""
    return documents(spark, d).select("doc_id", F.regexp_replace("text", "[^ -~]", "Z").alias("text"))


@BOOK.add(f"WITH {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def keyterm_idf(spark: SparkSession, d: str) -> DataFrame:
    return E.fit_idf(_ascii(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


@BOOK.add(f"""WITH {_IDF}, c AS (SELECT doc_id, term, count(*) AS frequency, any_value(total) AS total FROM (SELECT doc_id, len(w) AS total, unnest(w) AS term FROM toks) WHERE {_VALID} GROUP BY doc_id, term),
    s AS (SELECT doc_id, term, frequency, round(frequency / total::DOUBLE * coalesce(idf, 2.0) * CASE WHEN regexp_matches(term, '-|(tion|ology|metric|graph|ism|ist|ity)$') THEN 1.3 ELSE 1.0 END, 6) AS score FROM c LEFT JOIN idf USING (term))
    SELECT doc_id, rank, term, frequency, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s WHERE score >= 0.05) WHERE rank <= 10""")
def keyterms_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = _ascii(spark, d)
    return E.key_terms(docs, "doc_id", E.fit_idf(docs), 10, 0.05)


_RUN = "list_filter(string_split_regex(regexp_replace(low, '[^\\w\\s-]', ' ', 'g'), '\\s+'), lambda x: x <> '')"


@BOOK.add(f"""WITH {_DOCS}, b AS (SELECT doc_id, lower(text) AS low, len({_KEY}) AS total FROM docs), w AS (SELECT *, {_RUN} AS w FROM b), i AS (SELECT doc_id, low, total, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2),
    r AS (SELECT DISTINCT doc_id, low, total, w[i] || ' ' || w[i + 1] AS phrase FROM i WHERE length(w[i]) >= 2 AND length(w[i + 1]) >= 2 AND w[i] NOT IN ({sql_quoted(list(E.STOPWORDS))}) AND w[i + 1] NOT IN ({sql_quoted(list(E.STOPWORDS))}) AND NOT regexp_matches(w[i], '^\\d+$') AND NOT regexp_matches(w[i + 1], '^\\d+$')),
    c AS (SELECT *, CAST((length(low) - length(replace(low, phrase, ''))) / length(phrase)::DOUBLE AS BIGINT) AS count FROM r) SELECT doc_id, phrase, count, round(count / total::DOUBLE * 2.0::DOUBLE * 1.2::DOUBLE * 1.5::DOUBLE, 6) AS score FROM c WHERE count > 0 AND total > 0""")
def key_phrases(spark: SparkSession, d: str) -> DataFrame:
    return E.key_phrases(_ascii(spark, d), "doc_id", 2).where("score is not null")


def _sql_topic(name: str) -> str:
    content = TAXONOMY[name]
    words = [f"{w} * len(list_filter(w, lambda x: x = '{k}'))" for k, w in content["keywords"].items()]
    phrases = [f"2.0 * {w} * len(regexp_extract_all(low, '\\b{p}\\b'))" for p, w in content["phrases"].items()]
    return f"SELECT doc_id, '{name}' AS topic, CASE WHEN len(w) > 0 THEN CAST({' + '.join(words + phrases)} AS DOUBLE) / len(w) ELSE 0 END AS score FROM b"


@BOOK.add(f"""WITH {_DOCS}, b AS (SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), '\\b\\w+\\b') AS w FROM docs), s AS ({' UNION ALL '.join(map(_sql_topic, TAXONOMY))}),
    c AS (SELECT doc_id, topic, round(1 / (1 + exp(-3 * (2 * score / max(score) OVER (PARTITION BY doc_id) - 1))), 3) AS confidence FROM s WHERE score > 0)
    SELECT doc_id, topic, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, topic) AS rank FROM c WHERE confidence >= 0.1) WHERE rank <= 3""")
def topic_classify(spark: SparkSession, d: str) -> DataFrame:
    return E.classify_topics(_ascii(spark, d), "doc_id", TAXONOMY)


_SURFACES = [("hand", "project", "p1"), ("of the", "phrase", "f1"), ("edtion ndble", "project", "p2"), ("estion", "dataset", "d1"), ("the thing", "phrase", "f2")]


@BOOK.add("WITH s(surface, type, id) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _SURFACES) + f"""), {_DOCS}, t AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' AS flat FROM docs)
    SELECT doc_id, type, list_sort(list(DISTINCT id)) AS entities FROM t, s WHERE contains(flat, ' ' || surface || ' ') GROUP BY doc_id, type""")
def gazetteer_extract(spark: SparkSession, d: str) -> DataFrame:
    surfaces = spark.createDataFrame(_SURFACES, "surface string, type string, id string")
    return E.gazetteer(_ascii(spark, d), "doc_id", surfaces)


@BOOK.add(f"""WITH {_TEXT}, v AS (SELECT id, list_concat(list_transform(regexp_extract_all(text, '\\bNSF[-\\s#]?(\\d{{7}})\\b', 1), lambda x: 'NSF-' || x), list_transform(regexp_extract_all(text, '\\bR01-GM\\d{{6}}\\b'), lambda x: 'NIH-R01-GM-' || x[7:])) AS grants, regexp_extract_all(text, '\\b(MURI|CAREER)\\b', 1) AS projects FROM txt)
    SELECT 'grants' AS field, count(*) AS n, count(*) FILTER (len(grants) > 0) AS with_values, round(100.0::DOUBLE * count(*) FILTER (len(grants) > 0) / count(*), 1) AS percent, (SELECT count(DISTINCT x) FROM (SELECT unnest(grants) AS x FROM v)) AS distinct_values FROM v
    UNION ALL SELECT 'projects', count(*), count(*) FILTER (len(projects) > 0), round(100.0::DOUBLE * count(*) FILTER (len(projects) > 0) / count(*), 1), (SELECT count(DISTINCT x) FROM (SELECT unnest(projects) AS x FROM v)) FROM v""")
def enrichment_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    rows = _texts(spark, d).select(E.grant_ids(t).alias("grants"), E.projects(t).alias("projects"))
    return E.coverage(rows, ["grants", "projects"])


@BOOK.add()
def enrich_chunks(spark: SparkSession, d: str) -> DataFrame:
    return E.enrich(_texts(spark, d), TAXONOMY)


@BOOK.add()
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return E.chunks(documents(spark, d), "doc_id")


@BOOK.add()
def transcript_chunks(spark: SparkSession, d: str) -> DataFrame:
    talks = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 45.0).alias("start_s"), (F.col("turn") * 45.0 + 40).alias("end_s"), F.col("role").alias("speaker"), "text")
    return E.transcript_chunks(talks, "conv_id")


@BOOK.add("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'user' ELSE role END AS role, text FROM conversations), m AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS n FROM c),
    r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM m) SELECT conv_id, run, any_value(role) || ': ' || string_agg(text, ' ' ORDER BY turn) AS line FROM r GROUP BY conv_id, run""")
def speaker_runs(spark: SparkSession, d: str) -> DataFrame:
    talks = table(spark, d, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 0, "user").otherwise(F.col("role")))
    return E.speaker_runs(talks, "conv_id", "turn", "role", "text")


@BOOK.add("SELECT conv_id, turn FROM conversations WHERE contains(text, '?') OR regexp_matches(lower(trim(text)), '^(what|how|why|when|where|who|which|can|could|would|should|do|does|is|are)\\b')")
def questions(spark: SparkSession, d: str) -> DataFrame:
    return E.questions(table(spark, d, "conversations")).select("conv_id", "turn")


@BOOK.add("""WITH f AS (SELECT page_id, list_extract(string_split(url, '/'), 3) || '_' || CASE page_id % 9 WHEN 0 THEN 'Transcript' WHEN 1 THEN 'grant_2019' WHEN 2 THEN 'biosketch' WHEN 3 THEN 'Newsletter_FY24' WHEN 4 THEN 'weekly' WHEN 5 THEN 'REPORT' WHEN 6 THEN 'paper.pdf' WHEN 7 THEN 'agenda' ELSE 'x' END AS name FROM pages), l AS (SELECT *, lower(name) AS n FROM f)
    SELECT page_id, CASE WHEN contains(n, 'transcript') OR ends_with(n, '.vtt') THEN 'transcript' WHEN contains(n, 'proposal') OR contains(n, 'grant') OR contains(n, 'muri') THEN 'proposal' WHEN contains(n, 'cv') OR contains(n, 'biosketch') OR contains(n, 'resume') THEN 'cv' WHEN contains(n, 'newsletter') THEN 'newsletter' WHEN contains(n, 'meeting') OR contains(n, 'weekly') THEN 'meeting' WHEN contains(n, 'report') THEN 'report' WHEN ends_with(n, '.pdf') AND contains(n, 'paper') THEN 'paper' ELSE 'other' END AS doc_type,
    coalesce(CAST(nullif(regexp_extract(name, '(20[12]\\d)', 1), '') AS INT), 2000 + CAST(nullif(regexp_extract(upper(name), 'FY(\\d{2})', 1), '') AS INT)) AS year FROM l""")
def doc_type_infer(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 9
    kinds = ("Transcript", "grant_2019", "biosketch", "Newsletter_FY24", "weekly", "REPORT", "paper.pdf", "agenda")
    end = F.coalesce(*[F.when(k == i, F.lit(x)) for i, x in enumerate(kinds)], F.lit("x"))
    name = F.concat(F.split("url", "/")[2], F.lit("_"), end)
    return table(spark, d, "pages").select("page_id", T.infer_doc_type(name).alias("doc_type"), T.year_of_filename(name).alias("year"))


@BOOK.add("SELECT doc_id FROM documents WHERE lang = 'en' AND (CASE doc_id % 4 WHEN 0 THEN NULL ELSE 2010 + doc_id % 10 END IS NULL OR 2010 + doc_id % 10 = 2015) AND regexp_matches(lower(source), 'src1.*')")
def chunk_filters(spark: SparkSession, d: str) -> DataFrame:
    year = F.when(F.col("doc_id") % 4 != 0, 2010 + F.col("doc_id") % 10)
    keep = (F.col("lang") == "en") & (year.isNull() | (year == 2015)) & T.glob_matches(F.col("source"), "SRC1*")
    return documents(spark, d).where(keep).select("doc_id")


@BOOK.add("SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN ' / @01:02' WHEN doc_id % 3 = 1 THEN ' / p.' || doc_id ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' / §' || lang ELSE '' END AS citation FROM documents")
def citations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return documents(spark, d).select("doc_id", T.citation(F.col("source"), F.when(k % 3 == 0, "01:02"), F.when(k % 3 == 1, k), F.when(k % 2 == 0, F.col("lang"))).alias("citation"))
