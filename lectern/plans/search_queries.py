"""Registered queries: question parsing, keyword search, vector search, fusion and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as tx
from lectern.operators import questions, retrieval, search, vectors
from lectern.plans import fixtures as fx
from lectern.plans.text_queries import WS
from lectern.session import cut_lineage
from lectern.sources.tables import table

TERMS = ["the", "thatin", "eauouon"]
REWRITE = {
    "suffix": "of the orre",
    "families": [
        (["thth", "erth"], "thatin and rewh for the"),
        (["orre", "ndthre"], "with that hehely"),
    ],
    "defaults": ["ononst in the", "inoran by this"],
}
REWRITE_GATE = "thin"


def parsed_questions(spark, root):
    return parse(fx.questions(spark, root))


def parse(asked):
    gate = F.contains(F.col("question"), F.lit(REWRITE_GATE))
    return questions.parse_questions(
        asked,
        fx.SYNONYMS,
        fx.PHRASE_RULES,
        fx.EXPANSIONS,
        fx.SECTION_WORDS,
        questions.rewrite_question("question", gate=gate, **REWRITE),
    )


def _terms_sql(q: str) -> str:
    punct = r"[.,?!:;()\[\]]"
    return rf"""list_filter(list_transform(list_filter(regexp_split_to_array(lower({q}), '{WS}+'), lambda w: w <> ''),
      lambda w: regexp_replace(w, '^{punct}+|{punct}+$', '', 'g')), lambda w: length(w) >= 3)"""


def _distinct_sql(array: str) -> str:
    return f"list_filter({array}, lambda x, i: list_position({array}, x) = i)"


def _normalized_sql() -> str:
    ctes, column = [], "question"
    for letter in "ABCDEF":
        column = (
            f"regexp_replace({column}, '(?i)(^|[^a-z])section\\s*{letter}($|[^a-z])', '\\1Section {letter}\\2', 'g')"
        )
    ctes.append(f"n0 AS (SELECT query_id, question, {column} AS q FROM questions)")
    for i, (source, target) in enumerate(fx.SYNONYMS.items()):
        ctes.append(
            f"n{i + 1} AS (SELECT query_id, question, CASE WHEN contains(q, '{source}') "
            f"AND NOT contains(lower(q), '{target}') THEN q || ' {target}' ELSE q END AS q FROM n{i})"
        )
    return ",\n".join(ctes) + f",\nnormalized AS (SELECT * FROM n{len(fx.SYNONYMS)})"


def _parsed_sql() -> str:
    families = ", ".join(
        f"CASE WHEN {fx.sql_any('question', keys)} THEN '{query}' END" for keys, query in REWRITE["families"]
    )
    phrases = ", ".join(
        f"CASE WHEN {fx.sql_any('lower(scoring_text)', keys)} THEN '{phrase}' END" for keys, phrase in fx.PHRASE_RULES
    )
    implied = ", ".join(
        f"CASE WHEN {fx.sql_any('lower(scoring_text)', keys)} THEN '{section}' END"
        for section, keys in fx.SECTION_WORDS.items()
    )
    expansion = " ".join(f"WHEN '{k}' THEN {fx.sql_list(v)}" for k, v in fx.EXPANSIONS.items())
    return rf"""
{fx.QUESTIONS_SQL},
{_normalized_sql()},
rw0 AS (
  SELECT *, list_filter([{families}], lambda x: x IS NOT NULL) AS fam FROM normalized
),
rw AS (
  SELECT query_id, question, q AS normalized_question,
         CASE WHEN contains(question, '{REWRITE_GATE}')
              THEN list_concat([trim(question || ' {REWRITE["suffix"]}')],
                               CASE WHEN len(fam) = 0 THEN {fx.sql_list(REWRITE["defaults"])} ELSE fam END)[1:4]
              ELSE CAST([] AS VARCHAR[]) END AS rewritten
  FROM rw0
),
rq AS (SELECT *, list_concat([trim(normalized_question)], rewritten) AS all_queries FROM rw),
rd AS (SELECT *, list_filter(all_queries, lambda x, i:
         list_position(list_transform(all_queries, lambda y: lower(y)), lower(x)) = i) AS retrieval_queries FROM rq),
sc AS (SELECT *, array_to_string(retrieval_queries, ' ') AS scoring_text FROM rd),
tk AS (SELECT *, list_filter([{phrases}], lambda x: x IS NOT NULL) AS phrases, {_terms_sql('scoring_text')} AS terms,
         list_concat(list_transform(regexp_extract_all(lower(scoring_text), '(?:^|[^a-z])section\s*([a-f])(?:$|[^a-z])', 1),
                                    lambda x: 'Section ' || upper(x)),
                     list_filter([{implied}], lambda x: x IS NOT NULL)) AS all_sections FROM sc),
ek AS (SELECT *, flatten(list_transform(terms, lambda t: CASE t {expansion} ELSE [t] END)) AS all_keywords FROM tk),
parsed AS (
  SELECT query_id, question, normalized_question, rewritten, retrieval_queries, scoring_text, phrases,
         {_distinct_sql('all_keywords')} AS keywords, {_distinct_sql('all_sections')} AS sections
  FROM ek
)"""


PARSED_SQL = _parsed_sql()


def query_expand(spark, root):
    joined = {name: F.array_join(name, " | ").alias(name) for name in
              ("rewritten_queries", "retrieval_queries", "phrases", "keywords", "sections")}
    return parsed_questions(spark, root).select("query_id", "normalized_question", *joined.values())


QUERY_EXPAND_SQL = f"""
WITH {PARSED_SQL}
SELECT query_id, normalized_question, array_to_string(rewritten, ' | ') AS rewritten_queries,
       array_to_string(retrieval_queries, ' | ') AS retrieval_queries, array_to_string(phrases, ' | ') AS phrases,
       array_to_string(keywords, ' | ') AS keywords, array_to_string(sections, ' | ') AS sections
FROM parsed"""


def inverted_index(spark, root):
    return search.token_postings(fx.corpus(spark, root))


INVERTED_INDEX_SQL = f"""
WITH {fx.CORPUS_SQL}
SELECT chunk_id, token, count(*) AS tf
FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS token FROM corpus) GROUP BY 1, 2"""


def idf_table(spark, root):
    corpus = fx.corpus(spark, root)
    parsed = cut_lineage(parsed_questions(spark, root), "questions")
    keywords = search.question_keywords(parsed).select("keyword").distinct()
    idf = search.keyword_idf(corpus, keywords)
    return idf.select("keyword", "matches", F.round("idf", 6).alias("idf"))


CONTAINED_SQL = """
lowered AS MATERIALIZED (SELECT chunk_id, lower(content) AS lc, lower(article) AS la FROM corpus),
asked AS MATERIALIZED (SELECT query_id, unnest(keywords) AS keyword FROM parsed),
kws AS MATERIALIZED (SELECT DISTINCT keyword FROM asked),
contained AS MATERIALIZED (SELECT chunk_id, keyword FROM lowered JOIN kws ON contains(lc, keyword)),
idf AS MATERIALIZED (
  SELECT keyword, count(chunk_id) AS matches,
         CASE WHEN count(chunk_id) > 0
              THEN ln(1 + ((SELECT count(*) FROM corpus) - count(chunk_id) + 0.5) / (count(chunk_id) + 0.5)) ELSE 0.0 END AS idf
  FROM kws LEFT JOIN contained USING (keyword) GROUP BY keyword
)"""
IDF_SQL = f"""
WITH {fx.CORPUS_SQL}, {PARSED_SQL}, {CONTAINED_SQL}
SELECT keyword, matches, round(CAST(idf AS DOUBLE), 6) AS idf FROM idf"""


def bm25_topk(spark, root):
    return search.bm25_for_terms(fx.corpus(spark, root), TERMS, 20)


BM25_TOPK_SQL = f"""
WITH {fx.CORPUS_SQL},
t AS (SELECT unnest({fx.sql_list(TERMS)}) AS term),
d AS (SELECT chunk_id, lower(content) AS lc, regexp_extract_all(lower(content), '[a-z0-9]+') AS toks FROM corpus),
f AS (SELECT term, count(*) AS df FROM t JOIN d ON contains(lc, term) GROUP BY 1),
s AS (
  SELECT chunk_id, ln(1 + ((SELECT count(*) FROM d) - df + 0.5) / (df + 0.5)) AS idf,
         len(list_filter(toks, lambda x: x = term)) AS tf, len(toks) AS dl
  FROM d, f
)
SELECT chunk_id, bm25 FROM (
  SELECT chunk_id, round(sum(CASE WHEN tf > 0 THEN idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 180.0)) ELSE 0 END), 4) AS bm25
  FROM s GROUP BY chunk_id
) WHERE bm25 > 0 ORDER BY bm25 DESC, chunk_id LIMIT 20"""


LITERAL_PHRASES = ["of the", "in the", "de la"]
LITERAL_KEYWORDS = ["thatin", "rewh", "eaux", "heit", "the", "hableea"]
LITERAL_SECTIONS = ["Section B", "Section D"]


def heuristic_score(spark, root):
    """One question's heuristic score over the whole corpus."""
    score = retrieval.score_chunk(
        "content", "document_title", "article", tx.string_array(LITERAL_PHRASES), tx.string_array(LITERAL_KEYWORDS),
        tx.string_array(LITERAL_SECTIONS),
    )
    phrases = search.phrase_matches("content", tx.string_array(LITERAL_PHRASES))
    return fx.corpus(spark, root).select("chunk_id", score.alias("score"), phrases.alias("phrase_matches"))


HEURISTIC_SCORE_SQL = f"""
WITH {fx.CORPUS_SQL},
p AS (
  SELECT chunk_id, document_title,
         len(list_filter({fx.sql_list(LITERAL_PHRASES)}, lambda x: contains(lower(content), x))) AS ph,
         len(list_filter({fx.sql_list(LITERAL_KEYWORDS)}, lambda x: contains(lower(content), x))) AS kw,
         coalesce(len(list_filter({fx.sql_list(LITERAL_KEYWORDS)}, lambda x: contains(lower(article), x))) > 0, false) AS art,
         len(list_filter({fx.sql_list(LITERAL_SECTIONS)}, lambda x: contains(lower(document_title), lower(x)))) AS sec
  FROM corpus
)
SELECT chunk_id, CAST(CASE WHEN ph * 10 + kw + CASE WHEN art THEN 3 ELSE 0 END = 0 THEN 0
         ELSE ph * 10 + kw + CASE WHEN art THEN 3 ELSE 0 END + sec * 8 END AS BIGINT) AS score,
       CAST(ph AS BIGINT) AS phrase_matches
FROM p"""


def keyword_topk(spark, root):
    parsed = cut_lineage(parsed_questions(spark, root), "questions")
    scores = search.keyword_scores(fx.corpus(spark, root), parsed, fx.PHRASE_RULES, vocab.KEYWORD_CANDIDATES)
    return search.keyword_candidates(scores).select(
        "query_id", F.col("keyword_rank").cast("long").alias("keyword_rank"), "chunk_id",
        "bm25", "heuristic", "preferred",
    )


KEYWORD_SQL = f"""
{fx.CORPUS_SQL}, {PARSED_SQL}, {CONTAINED_SQL},
tok AS (
  SELECT chunk_id, keyword, count(*) AS tf
  FROM (SELECT chunk_id, unnest(regexp_extract_all(lc, '[a-z0-9]+')) AS keyword FROM lowered) GROUP BY ALL
),
dl AS (SELECT chunk_id, sum(tf) AS dl FROM tok GROUP BY 1),
w AS (
  SELECT chunk_id, keyword, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 180.0)) AS weight
  FROM tok JOIN dl USING (chunk_id) JOIN idf USING (keyword)
),
ev AS (
  SELECT query_id, chunk_id, sum(coalesce(weight, 0)) AS weight, count(*) AS kw
  FROM asked JOIN contained USING (keyword) LEFT JOIN w USING (chunk_id, keyword) GROUP BY 1, 2
),
ph AS (
  SELECT query_id, chunk_id, count(*) AS ph
  FROM (SELECT query_id, unnest(phrases) AS phrase FROM parsed) JOIN lowered ON contains(lc, phrase) GROUP BY 1, 2
),
art AS (
  SELECT DISTINCT query_id, chunk_id
  FROM asked JOIN (SELECT chunk_id, keyword FROM lowered JOIN kws ON contains(la, keyword)) USING (keyword)
),
pairs AS (SELECT query_id, chunk_id FROM ev UNION SELECT query_id, chunk_id FROM ph UNION SELECT query_id, chunk_id FROM art),
content AS (
  SELECT query_id, chunk_id, round(CAST(coalesce(weight, 0) AS DOUBLE), 4) AS bm25,
         coalesce(kw, 0) + 10 * coalesce(ph, 0) + CASE WHEN art.chunk_id IS NULL THEN 0 ELSE 3 END AS points,
         coalesce(ph, 0) AS phrase_matches
  FROM pairs LEFT JOIN ev USING (query_id, chunk_id) LEFT JOIN ph USING (query_id, chunk_id)
       LEFT JOIN art USING (query_id, chunk_id)
),
scored AS (
  SELECT c.query_id, c.chunk_id, ord, bm25, document_title, section_or_title, phrase_matches,
         CASE WHEN points = 0 THEN 0 ELSE points + 8 * len(list_filter(sections, lambda s:
           contains(lower(document_title), lower(s)))) END AS heuristic,
         len(list_filter(sections, lambda s: contains(lower(document_title), lower(s))
                                             OR lower(s) = lower(section_or_title))) > 0 AS preferred
  FROM content c JOIN corpus USING (chunk_id) JOIN parsed USING (query_id)
),
keyword AS (
  SELECT * FROM (
    SELECT *, bm25 + heuristic AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY preferred DESC, bm25 + heuristic DESC, ord) AS keyword_rank
    FROM scored WHERE bm25 + heuristic > 0
  ) WHERE keyword_rank <= 40
)"""
KEYWORD_TOPK_SQL = f"""
WITH {KEYWORD_SQL}
SELECT query_id, keyword_rank, chunk_id, bm25, CAST(heuristic AS BIGINT) AS heuristic, preferred
FROM keyword"""


def chunk_vectors(spark, root):
    """Vectors of the corpus. The tables declare no key between them: vector ids stand for chunk ids."""
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def query_vectors(spark, root, parsed, number=None):
    """A stored vector for each query of each question, again by position only: ``number`` of the question, by
    default eight times its id, and the query's number in it, modulo the vectors."""
    number = F.col("query_id") * 8 if number is None else number
    vecs = table(spark, root, "embeddings")
    parsed = parsed.select(
        "query_id", number.alias("_n"), F.posexplode_outer("retrieval_queries").alias("query_no", "query")
    )
    stored = vecs.select(F.col("vec_id").alias("_v"), F.col("embedding").alias("probe"))
    total = vecs.select(F.count(F.lit(1))).scalar()
    placed = parsed.withColumn("_v", F.pmod(F.col("_n") + F.col("query_no"), total))
    return placed.join(stored, "_v").select("query_id", "query_no", "probe")


def vector_knn(spark, root):
    vecs = table(spark, root, "embeddings")
    probe = vecs.select(F.min_by("embedding", "vec_id")).scalar()
    found = vectors.nearest(vecs, probe, vocab.VECTOR_CANDIDATES)
    return found.select("vec_id", F.round("similarity", 5).alias("similarity"))


VECTOR_KNN_SQL = """
SELECT vec_id, round(sim, 5) AS similarity FROM (
  SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
           (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS sim
  FROM embeddings
) ORDER BY sim DESC, vec_id LIMIT 40"""


def vector_multi_query(spark, root):
    parsed = cut_lineage(parsed_questions(spark, root), "questions")
    leg = retrieval.vector_leg(parsed, chunk_vectors(spark, root), query_vectors(spark, root, parsed))
    return leg.select("query_id", F.col("vector_rank").cast("long").alias("vector_rank"), "chunk_id")


VECTOR_SQL = """
qv AS (
  SELECT query_id, query_no, CAST(embedding AS DOUBLE[]) AS probe
  FROM (SELECT query_id, generate_subscripts(retrieval_queries, 1) - 1 AS query_no FROM parsed)
  JOIN embeddings ON vec_id = (query_id * 8 + query_no) % (SELECT count(*) FROM embeddings)
),
sims AS (
  SELECT query_id, query_no, vec_id AS chunk_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), probe), 6) AS sim
  FROM qv, embeddings
),
lists AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, query_no ORDER BY sim DESC, chunk_id) AS r FROM sims)
  WHERE r <= 40
),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY query_no, r) AS o FROM lists) WHERE o = 1
),
vector AS (
  SELECT query_id, chunk_id, vector_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY query_no, r) AS vector_rank FROM firsts) WHERE vector_rank <= 40
)"""
VECTOR_MULTI_SQL = f"""
WITH {PARSED_SQL}, {VECTOR_SQL}
SELECT query_id, vector_rank, chunk_id FROM vector"""


def stages(spark, root):
    parsed = cut_lineage(parsed_questions(spark, root), "questions")
    return retrieval.retrieve(
        parsed, fx.corpus(spark, root), chunk_vectors(spark, root), query_vectors(spark, root, parsed),
        phrase_rules=fx.PHRASE_RULES,
    )


def rrf_fusion(spark, root):
    return stages(spark, root)["fused"].select(
        "query_id", F.col("hybrid_rank").cast("long").alias("hybrid_rank"), "chunk_id",
        F.col("vector_rank").cast("long").alias("vector_rank"), F.col("keyword_rank").cast("long").alias("keyword_rank"),
        F.round("hybrid", 4).alias("hybrid"),
    )


FUSED_SQL = f"""
{KEYWORD_SQL}, {VECTOR_SQL},
fused AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST)
             AS hybrid_rank
    FROM (
      SELECT query_id, chunk_id, vector_rank, keyword_rank,
             round((coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0)) * 100
                   + least(coalesce(score, 0), 20), 4) AS hybrid
      FROM vector FULL JOIN keyword USING (query_id, chunk_id)
    )
  ) WHERE hybrid_rank <= 50
)"""
RRF_FUSION_SQL = f"""
WITH {FUSED_SQL}
SELECT query_id, hybrid_rank, chunk_id, vector_rank, keyword_rank, round(hybrid, 4) AS hybrid FROM fused"""


def filter_or_all(spark, root):
    """Chunks of the question's sections per question group, or all when a group has none."""
    return stages(spark, root)["hybrid"].select(
        "query_id", F.col("hybrid_rank").cast("long").alias("hybrid_rank"), "chunk_id", "document_title"
    )


HYBRID_SQL = f"""
{FUSED_SQL},
located AS (
  SELECT f.*, c.document_title, c.article, c.content, c.page, c.section_or_title, p.phrases, p.keywords, p.sections,
         len(list_filter(p.sections, lambda s: contains(lower(c.document_title), lower(s))
                                               OR lower(s) = lower(c.section_or_title))) > 0 AS hit
  FROM fused f JOIN corpus c USING (chunk_id) JOIN parsed p USING (query_id)
),
hybrid AS (
  SELECT * FROM (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS any_hit FROM located) WHERE hit OR NOT any_hit
)"""
FILTER_OR_ALL_SQL = f"""
WITH {HYBRID_SQL}
SELECT query_id, hybrid_rank, chunk_id, document_title FROM hybrid"""


def rerank_topk(spark, root):
    return stages(spark, root)["retrieved"].select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "document_title", "article",
        "heuristic", "phrase_matches", F.round("hybrid", 4).alias("hybrid"), F.round("final", 4).alias("final"), "strong",
    )


RERANKED_SQL = f"""
{HYBRID_SQL},
rr AS (
  SELECT query_id, chunk_id, document_title, article, section_or_title, page, content, hybrid_rank, least(hybrid, 25) AS hybrid, ph,
         CASE WHEN base = 0 THEN 0 ELSE base + 8 * sec END AS heuristic
  FROM (
    SELECT *, len(list_filter(phrases, lambda x: contains(lower(content), x))) AS ph,
           len(list_filter(sections, lambda x: contains(lower(document_title), lower(x)))) AS sec,
           10 * len(list_filter(phrases, lambda x: contains(lower(content), x)))
           + len(list_filter(keywords, lambda x: contains(lower(content), x)))
           + CASE WHEN len(list_filter(keywords, lambda x: contains(lower(article), x))) > 0 THEN 3 ELSE 0 END AS base
    FROM hybrid
  )
),
fin AS (
  SELECT *, heuristic + hybrid AS final,
         heuristic + hybrid >= 8 AND (ph > 0 OR heuristic >= 6) AS strong
  FROM rr WHERE heuristic + hybrid > 0
),
reranked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, hybrid_rank) AS rank
    FROM (SELECT *, bool_or(strong) OVER (PARTITION BY query_id) AS any_strong FROM fin)
    WHERE CASE WHEN any_strong THEN strong ELSE final >= 1 END
  ) WHERE rank <= 3
)"""
RERANK_TOPK_SQL = f"""
WITH {RERANKED_SQL}
SELECT query_id, rank, chunk_id, document_title, article, CAST(heuristic AS BIGINT) AS heuristic,
       CAST(ph AS BIGINT) AS phrase_matches, round(hybrid, 4) AS hybrid, round(final, 4) AS final, strong
FROM reranked"""


def _overview(spark, root, limit):
    chosen = retrieval.representative_chunks(fx.corpus(spark, root), limit)
    return chosen.select("section_code", F.col("rank").cast("long").alias("rank"), "chunk_id", "article", "score")


def section_overview(spark, root):
    return _overview(spark, root, 6)


def document_overview(spark, root):
    return _overview(spark, root, 1)


def _overview_sql(limit):
    return f"""
WITH {fx.CORPUS_SQL},
f AS (
  SELECT *, section_or_title AS section_code,
         CASE WHEN regexp_full_match(article, '(?i)[A-F]\\d+(\\.\\d+)?')
              THEN row_number() OVER (PARTITION BY section_or_title, article ORDER BY ord) END AS n
  FROM corpus
),
r AS (SELECT *, row_number() OVER (PARTITION BY section_code ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, ord) AS rank FROM f)
SELECT section_code, rank, chunk_id, article, 1.0::DOUBLE AS score FROM r WHERE rank <= {limit}"""


def overview_topics(spark, root):
    """First five distinct headings of each section's representative chunks, in order."""
    chosen = retrieval.representative_chunks(fx.corpus(spark, root), 6)
    heading = F.coalesce("article", "section_code")
    ordered = F.array_sort(F.collect_list(F.struct("rank", heading.alias("heading"))))
    topics = F.slice(F.array_distinct(F.transform(ordered, lambda x: x["heading"])), 1, 5)
    return chosen.groupBy("section_code").agg(F.array_join(topics, "; ").alias("topics"))


OVERVIEW_TOPICS_SQL = f"""
WITH o AS ({_overview_sql(6)}),
h AS (
  SELECT section_code, coalesce(article, section_code) AS heading, min(rank) AS first_rank FROM o GROUP BY 1, 2
),
n AS (SELECT *, row_number() OVER (PARTITION BY section_code ORDER BY first_rank) AS k FROM h)
SELECT section_code, string_agg(heading, '; ' ORDER BY k) AS topics FROM n WHERE k <= 5 GROUP BY 1"""

QUERIES = {
    "query_expand": query_expand,
    "inverted_index": inverted_index,
    "idf_table": idf_table,
    "bm25_topk": bm25_topk,
    "heuristic_score": heuristic_score,
    "keyword_topk": keyword_topk,
    "vector_knn": vector_knn,
    "vector_multi_query": vector_multi_query,
    "rrf_fusion": rrf_fusion,
    "filter_or_all": filter_or_all,
    "rerank_topk": rerank_topk,
    "section_overview": section_overview,
    "document_overview": document_overview,
    "overview_topics": overview_topics,
}
ORACLES = {
    "query_expand": QUERY_EXPAND_SQL,
    "inverted_index": INVERTED_INDEX_SQL,
    "idf_table": IDF_SQL,
    "bm25_topk": BM25_TOPK_SQL,
    "heuristic_score": HEURISTIC_SCORE_SQL,
    "keyword_topk": KEYWORD_TOPK_SQL,
    "vector_knn": VECTOR_KNN_SQL,
    "vector_multi_query": VECTOR_MULTI_SQL,
    "rrf_fusion": RRF_FUSION_SQL,
    "filter_or_all": FILTER_OR_ALL_SQL,
    "rerank_topk": RERANK_TOPK_SQL,
    "section_overview": _overview_sql(6),
    "document_overview": _overview_sql(1),
    "overview_topics": OVERVIEW_TOPICS_SQL,
}
