"""Views that the registered queries derive from the given tables, each with its SQL twin.

The given prose is invented, so the domain vocabulary of ``lectern.vocab`` finds nothing in it. The
queries run the same operators with the vocabulary below, whose entries do occur in the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.tables import spread, table

LETTERS = "ABCDEF"

# Vocabulary that occurs in the given tables.
HEADING_PATTERN = r"^(The|Of|And|To|In|It|De|La|Le|Der|Die|El|Que|On)(?:[ ,.]|$)"
BOILERPLATE = {"exact_upper": ["AND.", "THE."], "prefixes": ["Licensed under", "The "], "pattern": r"^\d+$"}
SKIP_RULES = {
    "markers_upper": ["APACHE", "EAUOUON."],
    "index_prefixes": ["Licensed ", "Copyright "],
    "index_token_prefix": "A",
    "min_index_lines": 1,
    "max_sentence_lines": 2,
    "sentence_chars": 60,
}
SYNONYMS = {"thatin": "orantion of", "hehely": "the rewh", "thndelle": "ononst"}
PHRASE_RULES = [
    (["of the", "de la"], "of the"),
    (["in the"], "in the"),
    (["and the", "und der"], "and the"),
    (["that the"], "that the"),
    (["to the", "on the"], "to the"),
]
EXPANSIONS = {
    "the": ["the", "thatin"],
    "and": ["and", "rewh", "orre"],
    "for": ["for", "from", "inoran"],
    "with": ["with", "thon"],
    "that": ["that", "than"],
    "this": ["this", "ther", "thha"],
}
SECTION_WORDS = {
    "Section A": ["eringth", "thatin"],
    "Section B": ["erthnd", "sheatin"],
    "Section C": ["ndthre", "orehe"],
}
ENTITIES = {
    "stem": [("rewh", "Rewh"), ("orre", "Orre"), ("orrewh", "Orre"), ("thatin", "Thatin")],
    "tail": [("heit", "Heit"), ("lich", "Lich"), ("keit", "Heit")],
    "host": [("example.com", "Example"), ("mail1", "Mail"), ("mail2", "Mail")],
}
CATEGORIES = [
    ("northern", "Northern", ["heit", "lich", "schie", "ungen"]),
    ("western", "Western", ["eaueux", "aielle", "ouviré", "tionre"]),
    ("southern", "Southern", ["ción", "ando", "idad", "mente"]),
    ("central", "Central", ["rewh", "thond", "ingth", "edes"]),
]
DIRECT_TERMS = ["apache", "license", "thatin", "copyright"]
POSSIBLE_TERMS = ["hehely", "ononst", "inoran", "eaueau", "keiten"]
POSSIBLE_CATEGORIES = ["western", "central"]
DIRECT_CATEGORY = ("central", "Central")
DEFAULT_CATEGORY = ("plain", "Plain")
TOPICS = [
    ("licence", "Licences", ["apache", "license"], ["that the apache", "license the of"]),
    ("stems", "Stems", ["rewh", "orre", "thatin"], ["of the rewh", "orre and the"]),
    ("tails", "Tails", ["heit", "keit", "ungen"], ["die ungheit", "that the apache"]),
    ("waters", "Waters", ["eaueux", "ouviré"], ["de la eaueux", "ouviré le"]),
]
GENERIC_QUESTIONS = ["which rules fit %s", "what is behind %s"]
INTENTS = {
    "explicit": ["thatin", "oranti", "eauouoi"],
    "strategy": ["rewh", "ßheit", "çtre"],
    "rule": ["orre", "inung", "éèpa"],
    "race": ["ther ", "lich ", "eau "],
    "news": [" is ", " est ", " ist "],
    "follow_up": ["it ", "the ", "que ", "der "],
}
RACE_ACTIONS = [
    (["thon", "keit"], "get_constructor_standings"),
    (["ther", "lich"], "get_driver_standings"),
    (["than", "eau "], "get_previous_race"),
    (["in ", "en "], "get_next_race"),
]
PREFERENCE_MARKERS = ["thatin", " is ", " est ", " der ", "ción"]
INTEREST_MARKERS = ["that ", "que ", "und "]


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "documents"), "doc_id")


def pages_of_documents(spark: SparkSession, root: str) -> DataFrame:
    """Document rows as pages of the document their source names."""
    number = F.expr("CAST(regexp_extract(source, '[0-9]+', 0) AS INT)")
    letter = F.substring(F.lit(LETTERS), F.pmod(number, F.lit(6)) + 1, F.lit(1))
    return documents(spark, root).select(
        F.concat("source", F.lit(" Section "), letter).alias("document_title"),
        (F.col("doc_id") + 1).alias("page_number"),
        "text",
    )


PAGES_SQL = """pages_of_documents AS (
  SELECT source || ' Section ' || substr('ABCDEF', CAST(regexp_extract(source, '[0-9]+') AS INT) % 6 + 1, 1)
           AS document_title,
         doc_id + 1 AS page_number, text
  FROM documents
)"""


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """Documents in the shape of retrieved chunks; ``ord`` is the corpus order."""
    doc = F.col("doc_id")
    letter = F.expr("substring('ABCDEF', CAST(doc_id % 6 AS INT) + 1, 1)")
    numbered = F.concat(letter, (doc % 37).cast("string"))
    article = (
        F.when(doc % 4 == 1, numbered)
        .when(doc % 4 == 2, F.upper(F.regexp_extract("text", "^[A-Za-z]+", 0)))
        .when(doc % 4 == 3, F.concat(numbered, F.lit("."), (doc % 5).cast("string")))
    )
    return documents(spark, root).select(
        doc.alias("chunk_id"),
        doc.alias("ord"),
        F.concat("source", F.lit(" Section "), letter).alias("document_title"),
        F.when(doc % 3 != 0, F.concat(F.lit("Section "), letter)).alias("section"),
        F.nullif(article, F.lit("")).alias("article"),
        (doc % 90 + 1).alias("page"),
        F.col("text").alias("content"),
    )


CORPUS_SQL = """corpus AS (
  SELECT doc_id AS chunk_id, doc_id AS ord,
         source || ' Section ' || letter AS document_title,
         CASE WHEN doc_id % 3 <> 0 THEN 'Section ' || letter END AS section,
         'Section ' || letter AS section_or_title,
         nullif(CASE doc_id % 4
                  WHEN 1 THEN letter || CAST(doc_id % 37 AS VARCHAR)
                  WHEN 2 THEN upper(regexp_extract(text, '^[A-Za-z]+'))
                  WHEN 3 THEN letter || CAST(doc_id % 37 AS VARCHAR) || '.' || CAST(doc_id % 5 AS VARCHAR)
                END, '') AS article,
         doc_id % 90 + 1 AS page, text AS content
  FROM (SELECT *, substr('ABCDEF', CAST(doc_id % 6 AS INT) + 1, 1) AS letter FROM documents)
)"""


def questions(spark: SparkSession, root: str) -> DataFrame:
    """Benchmark texts as questions; a third of them also name a section."""
    item = F.col("item_id")
    letter = F.expr("substring('abcdef', CAST(item_id % 6 AS INT) + 1, 1)")
    return spread(table(spark, root, "benchmark"), "item_id").select(
        item.alias("query_id"),
        F.when(item % 3 == 0, F.concat("text", F.lit(" section "), letter)).otherwise(F.col("text")).alias("question"),
    )


QUESTIONS_SQL = """questions AS (
  SELECT item_id AS query_id,
         CASE WHEN item_id % 3 = 0 THEN text || ' section ' || substr('abcdef', CAST(item_id % 6 AS INT) + 1, 1)
              ELSE text END AS question
  FROM benchmark
)"""


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_values(rows) -> str:
    """``VALUES`` rows of strings, numbers and lists of strings."""

    def literal(v):
        if isinstance(v, (list, tuple)):
            return sql_list(v)
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + v.replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


def sql_any(column: str, keys) -> str:
    """SQL for: any key is a substring of the column."""
    return "(" + " OR ".join(f"contains({column}, '" + k.replace("'", "''") + "')" for k in keys) + ")"


def page_articles(spark: SparkSession, root: str) -> DataFrame:
    """Web pages as stored articles."""
    return as_articles(spread(table(spark, root, "pages"), "page_id"))


def as_articles(pages: DataFrame) -> DataFrame:
    page = F.col("page_id")
    tail = F.regexp_extract("url", "([^/]+)/*$", 1)
    return pages.select(
        (page + 1).alias("id"),
        F.concat(F.lit("site"), (page % 4).cast("string")).alias("source_name"),
        F.concat_ws("-", tail, page.cast("string")).alias("source_article_id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.nullif(F.regexp_extract("html", "<div class=\"ad\">([^<]*)</div>", 1), F.lit("")).alias("summary"),
        F.regexp_extract("html", "<footer>([^<]*)</footer>", 1).alias("content"),
        F.col("url").alias("article_url"),
        F.when(page % 2 == 0, F.concat(F.lit("author"), (page % 13).cast("string"))).alias("author"),
        F.when(
            page % 11 != 0,
            F.timestamp_seconds(F.lit(1704067200) + (page * 7919 % 1000) * 3600),
        ).alias("published_at"),
        F.split(F.regexp_extract("html", "<html lang=\"([^\"]*)\"", 1), ",").alias("tags"),
        F.lit("{}").alias("raw_payload"),
        F.timestamp_seconds(F.lit(1704067200)).alias("fetched_at"),
        (page % 7 == 0).alias("is_deleted"),
    )


def address(url="article_url") -> Column:
    """URL of a page's article, told apart from those of other pages that have the same one."""
    return F.concat_ws("#", url, F.col("id").cast("string"))


PAGE_ARTICLES_SQL = """page_articles AS (
  SELECT page_id + 1 AS id, 'site' || (page_id % 4) AS source_name,
         regexp_extract(url, '([^/]+)/*$', 1) || '-' || page_id AS source_article_id,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         nullif(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '') AS summary,
         regexp_extract(html, '<footer>([^<]*)</footer>', 1) AS content,
         url AS article_url, CASE WHEN page_id % 2 = 0 THEN 'author' || (page_id % 13) END AS author,
         CASE WHEN page_id % 11 <> 0 THEN make_timestamp((1704067200 + (page_id * 7919 % 1000) * 3600) * 1000000) END
           AS published_at,
         regexp_extract(html, '<html lang="([^"]*)"', 1) AS tag, page_id % 7 = 0 AS is_deleted, page_id, html, url
  FROM pages
)"""


def text_articles(spark: SparkSession, root: str) -> DataFrame:
    """Documents as articles: the first line is the title, the second one the summary."""
    doc = F.col("doc_id")
    return documents(spark, root).select(
        doc.alias("article_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.get(F.split("text", "\n"), 1).alias("summary"),
        F.col("text").alias("content"),
        F.array("lang", "source").alias("tags"),
    )


TEXT_ARTICLES_SQL = """text_articles AS (
  SELECT doc_id AS article_id, string_split(text, chr(10))[1] AS title,
         string_split(text, chr(10))[2] AS summary,
         text AS content, lang || ' ' || source AS tag_text
  FROM documents
),
article_corpus AS (
  SELECT *, lower(title || ' ' || coalesce(summary, '') || ' ' || coalesce(content, '') || ' ' || tag_text) AS corpus_text
  FROM text_articles
)"""
