"""Registered queries: document cleaning and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as tx
from lectern.operators import chunking, cleaning
from lectern.plans import fixtures as fx
from lectern.sources.tables import table

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def doc_clean(spark, root):
    return fx.documents(spark, root).select("doc_id", cleaning.clean_text("text", **fx.BOILERPLATE).alias("cleaned"))


DOC_CLEAN_SQL = rf"""
SELECT doc_id, array_to_string(list_filter(
         list_transform(regexp_split_to_array(translate(text, chr(13) || chr(160), chr(10) || ' '), '{BREAK}'),
                        lambda l: trim(regexp_replace(l, '{WS}+', ' ', 'g'))),
         lambda l: l <> '' AND upper(l) NOT IN ('AND.', 'THE.') AND NOT starts_with(l, 'Licensed under')
                   AND NOT starts_with(l, 'The ') AND NOT regexp_full_match(l, '[0-9]+')), chr(10)) AS cleaned
FROM documents"""


def line_filter_stats(spark, root):
    profile = cleaning.page_profile("text", **fx.SKIP_RULES)
    return fx.documents(spark, root).select("doc_id", profile.alias("p")).select("doc_id", "p.*")


LINES_SQL = rf"""list_filter(list_transform(regexp_split_to_array(text, '{BREAK}'),
    lambda l: regexp_replace(l, '^{WS}+|{WS}+$', '', 'g')), lambda l: l <> '')"""
SKIP_SQL = f"""(contains(upper(text), 'APACHE') OR contains(upper(text), 'EAUOUON.') OR line_count = 0
   OR (index_lines >= 1 AND sentence_lines <= 2))"""
LINE_COUNTS_SQL = rf"""len(list_filter(ls, lambda l: regexp_matches(l, '[0-9]$') AND
         (starts_with(l, 'Licensed ') OR starts_with(l, 'Copyright ')
          OR (starts_with(regexp_split_to_array(l, '{WS}+')[1], 'A')
              AND regexp_matches(regexp_split_to_array(l, '{WS}+')[1], '[0-9]'))))) AS index_lines,
       len(list_filter(ls, lambda l: ends_with(l, '.') AND length(l) > 60)) AS sentence_lines"""
LINE_FILTER_SQL = rf"""
WITH d AS (SELECT doc_id, text, {LINES_SQL} AS ls FROM documents),
s AS (SELECT doc_id, text, CAST(len(ls) AS BIGINT) AS line_count, {LINE_COUNTS_SQL} FROM d)
SELECT doc_id, line_count, CAST(index_lines AS BIGINT) AS index_lines,
       CAST(sentence_lines AS BIGINT) AS sentence_lines, {SKIP_SQL} AS skip
FROM s"""


def heading_carry_forward(spark, root):
    return chunking.carry_heading_forward(fx.documents(spark, root), ["doc_id"], "text", fx.HEADING_PATTERN)


HEADINGS = "^(The|Of|And|To|In|It|De|La|Le|Der|Die|El|Que|On)(?:[ ,.]|$)"
HEADING_SQL = rf"""
WITH d AS (SELECT doc_id, {LINES_SQL} AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM d)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line,
       last_value(nullif(upper(regexp_extract(line, '{HEADINGS}', 1)), '') IGNORE NULLS)
         OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS article
FROM l"""


def _chunks(spark, root):
    return chunking.chunk_pages(
        fx.pages_of_documents(spark, root), pattern=fx.HEADING_PATTERN, **fx.SKIP_RULES
    )


def chunk_pack(spark, root):
    return _chunks(spark, root).select(
        "chunk_id",
        "document_title",
        "section_code",
        "article",
        "page_number",
        "page_start",
        "page_end",
        F.array_join("heading_path", " > ").alias("heading_path"),
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "content",
    )


# The fold over a page's lines as a recursion: a state row per page and line, and the text each step closes.
CHUNKS_SQL = rf"""
{fx.PAGES_SQL},
d AS (SELECT *, {LINES_SQL} AS ls FROM pages_of_documents),
s AS (SELECT *, CAST(len(ls) AS BIGINT) AS line_count, {LINE_COUNTS_SQL} FROM d),
kept AS (SELECT document_title, page_number, ls FROM s WHERE NOT {SKIP_SQL}),
l AS (
  SELECT document_title, page_number, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no, len(ls) AS n
  FROM kept
),
h AS (
  SELECT *, nullif(upper(regexp_extract(line, '{HEADINGS}', 1)), '') AS heading FROM l
),
fold AS (
  SELECT document_title, page_number, CAST(0 AS BIGINT) AS line_no, CAST(NULL AS VARCHAR) AS article, '' AS buf,
         CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS closed, CAST(NULL AS VARCHAR) AS closed_article
  FROM kept
  UNION ALL
  SELECT h.document_title, h.page_number, h.line_no, coalesce(h.heading, f.article),
         CASE WHEN length(h.line) > 1000 THEN ''
              WHEN f.buf = '' OR h.heading IS NOT NULL OR f.used + length(h.line) + 1 > 1000 THEN h.line
              ELSE f.buf || chr(10) || h.line END,
         CASE WHEN length(h.line) > 1000 THEN 0
              WHEN f.buf = '' OR h.heading IS NOT NULL OR f.used + length(h.line) + 1 > 1000
                THEN length(h.line) + 1
              ELSE f.used + length(h.line) + 1 END,
         CASE WHEN f.buf <> '' AND (h.heading IS NOT NULL OR length(h.line) > 1000
                                    OR f.used + length(h.line) + 1 > 1000) THEN f.buf END,
         f.article
  FROM fold f JOIN h ON h.document_title = f.document_title AND h.page_number = f.page_number
                    AND h.line_no = f.line_no + 1
),
pieces AS (
  SELECT document_title, page_number, line_no, 0 AS piece_no, line AS rest, CAST(NULL AS VARCHAR) AS piece
  FROM h WHERE length(line) > 1000
  UNION ALL
  SELECT document_title, page_number, line_no, piece_no + 1, substr(rest, cut + 1), trim(substr(rest, 1, cut))
  FROM (SELECT *, CASE WHEN length(rest) <= 1000 THEN length(rest)
                       WHEN instr(reverse(substr(rest, 2, 999)), ' ') > 0
                         THEN 1000 - instr(reverse(substr(rest, 2, 999)), ' ')
                       ELSE 1000 END AS cut
        FROM pieces WHERE rest <> '')
),
emitted AS (
  SELECT document_title, page_number, line_no, 0 AS sub, closed_article AS article, closed AS content
  FROM fold WHERE closed IS NOT NULL
  UNION ALL
  SELECT p.document_title, p.page_number, p.line_no, piece_no, f.article, piece
  FROM pieces p JOIN fold f USING (document_title, page_number, line_no) WHERE piece <> ''
  UNION ALL
  SELECT f.document_title, f.page_number, f.line_no + 1, 0, article, buf
  FROM fold f JOIN kept k USING (document_title, page_number) WHERE f.line_no = len(k.ls) AND buf <> ''
),
chunks AS (
  SELECT document_title, page_number, article, content, regexp_extract(document_title, 'Section [A-F]') AS section_code,
         row_number() OVER (PARTITION BY document_title, page_number ORDER BY line_no, sub) AS chunk_index
  FROM emitted
)"""
CHUNK_PACK_SQL = rf"""
WITH RECURSIVE {CHUNKS_SQL}
SELECT trim(regexp_replace(lower(document_title), '[^a-z0-9]+', '-', 'g'), '-') || '-p' || page_number || '-c' || chunk_index
         AS chunk_id,
       document_title, section_code, article, page_number, page_number AS page_start, page_number AS page_end,
       concat_ws(' > ', section_code, article) AS heading_path, chunk_index, content
FROM chunks"""


def ingest_summary(spark, root):
    pages = fx.pages_of_documents(spark, root)
    return chunking.ingest_summary(pages, _chunks(spark, root))


INGEST_SUMMARY_SQL = rf"""
WITH RECURSIVE {CHUNKS_SQL},
p AS (SELECT document_title, count(*) AS page_count FROM pages_of_documents GROUP BY 1),
c AS (SELECT document_title, count(*) AS chunk_count FROM chunks GROUP BY 1),
j AS (SELECT document_title, page_count, coalesce(chunk_count, 0) AS chunk_count FROM p LEFT JOIN c USING (document_title))
SELECT document_title, count(*) AS document_count, CAST(sum(page_count) AS BIGINT) AS page_count,
       CAST(sum(chunk_count) AS BIGINT) AS chunk_count, CAST(sum(chunk_count) AS BIGINT) AS embedded_chunk_count,
       nullif(regexp_extract(document_title, 'Section [A-F]'), '') AS section_code
FROM j GROUP BY ROLLUP (document_title)"""


def slug_ids(spark, root):
    title = F.concat_ws(" / ", "p_brand", "p_name", "p_type")
    return table(spark, root, "part").select(
        "p_partkey", chunking.chunk_id(title, F.col("p_size"), F.col("p_partkey")).alias("chunk_id")
    )


SLUG_IDS_SQL = """
SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-')
       || '-p' || p_size || '-c' || p_partkey AS chunk_id
FROM part"""


def section_extract(spark, root):
    title = F.expr(
        "CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' SECTION ', substring('ABCDEF', CAST(p_size % 6 AS INT) + 1, 1)) "
        "WHEN 1 THEN concat(' ', substring('abcdef', CAST(p_size % 6 AS INT) + 1, 1), ' ') "
        "WHEN 2 THEN concat('section', substring('bcdefg', CAST(p_size % 6 AS INT) + 1, 1), ' ', p_brand) ELSE p_type END"
    )
    line = F.expr(
        "CASE p_partkey % 3 WHEN 0 THEN concat('Article ', p_size, ' ', p_name) "
        "WHEN 1 THEN concat(substring('ABCDEFG', CAST(p_size % 7 AS INT) + 1, 1), p_size, '.', p_partkey, ' ', p_type) "
        "ELSE p_name END"
    )
    return table(spark, root, "part").select(
        "p_partkey",
        chunking.section_code(title).alias("section"),
        chunking.section_of_title(title).alias("title_section"),
        chunking.heading_article(line).alias("article"),
    )


SECTION_EXTRACT_SQL = r"""
WITH t AS (
  SELECT p_partkey,
         CASE p_partkey % 4 WHEN 0 THEN p_name || ' SECTION ' || substr('ABCDEF', p_size % 6 + 1, 1)
           WHEN 1 THEN ' ' || substr('abcdef', p_size % 6 + 1, 1) || ' '
           WHEN 2 THEN 'section' || substr('bcdefg', p_size % 6 + 1, 1) || ' ' || p_brand ELSE p_type END AS title,
         CASE p_partkey % 3 WHEN 0 THEN 'Article ' || p_size || ' ' || p_name
           WHEN 1 THEN substr('ABCDEFG', p_size % 7 + 1, 1) || p_size || '.' || p_partkey || ' ' || p_type
           ELSE p_name END AS line
  FROM part
)
SELECT p_partkey,
       CASE WHEN regexp_matches(title, '(?i)section\s*[a-f]')
              THEN 'Section ' || upper(regexp_extract(title, '(?i)section\s*([a-f])', 1))
            WHEN regexp_full_match(title, '(?i)\s*[a-f]\s*') THEN 'Section ' || upper(trim(title))
            ELSE title END AS section,
       CASE WHEN regexp_matches(title, '(?i)section\s+[a-f]')
              THEN 'Section ' || upper(regexp_extract(title, '(?i)section\s+([a-f])', 1)) END AS title_section,
       nullif(upper(regexp_extract(line, '(?i)^(ARTICLE\s+\d+[A-Z]?(?:\.\d+)*|[A-F]\d+(?:\.\d+)*)\b', 1)), '') AS article
FROM t"""


def context_slices(spark, root):
    """Whole texts cut into slices of the streamed answer width."""
    docs = fx.documents(spark, root)
    slices = docs.select("doc_id", F.posexplode(tx.fixed_width_slices("text", vocab.DELTA_CHARS)).alias("i", "delta"))
    return slices.select("doc_id", F.col("i").cast("long").alias("slice_no"), "delta")


CONTEXT_SLICES_SQL = """
SELECT doc_id, CAST(i AS BIGINT) AS slice_no, substr(text, CAST(i * 24 + 1 AS BIGINT), 24) AS delta
FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / 24.0) AS BIGINT), 1))) AS i FROM documents)"""

QUERIES = {
    "doc_clean": doc_clean,
    "line_filter_stats": line_filter_stats,
    "heading_carry_forward": heading_carry_forward,
    "chunk_pack": chunk_pack,
    "ingest_summary": ingest_summary,
    "slug_ids": slug_ids,
    "section_extract": section_extract,
    "fixed_width_slices": context_slices,
}
ORACLES = {
    "doc_clean": DOC_CLEAN_SQL,
    "line_filter_stats": LINE_FILTER_SQL,
    "heading_carry_forward": HEADING_SQL,
    "chunk_pack": CHUNK_PACK_SQL,
    "ingest_summary": INGEST_SUMMARY_SQL,
    "slug_ids": SLUG_IDS_SQL,
    "section_extract": SECTION_EXTRACT_SQL,
    "fixed_width_slices": CONTEXT_SLICES_SQL,
}
