"""Registered queries over a chunk store that is brought up to changing files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans import fixtures as fx
from lectern.plans import text_queries as tq
from lectern.sources import store
from lectern.streaming.ingest import new_folder


def one_page(content: bytes) -> list[str]:
    return [content.decode()]


def zeros():
    """A stand-in for a model: vectors that tell how long a text is."""
    return lambda texts: [[float(len(text)), 1.0] for text in texts]


def _files(spark, root, whole: bool):
    """A file a document. Before they are whole, every fifth one ends in the middle."""
    doc = F.col("doc_id")
    letter = F.expr("substring('ABCDEF', CAST(doc_id % 6 AS INT) + 1, 1)")
    half = F.expr("left(text, CAST(length(text) DIV 2 AS INT))")
    text = F.col("text") if whole else F.when(doc % 5 == 0, half).otherwise(F.col("text"))
    path = F.concat(F.lit("in/Doc "), doc, F.lit(" Section "), letter, F.lit(".txt"))
    return fx.documents(spark, root).select(path.alias("path"), F.encode(text, "UTF-8").alias("content"))


def _ingest(spark, root, folder, whole: bool) -> int:
    return store.ingest(
        _files(spark, root, whole), folder, one_page, zeros, pattern=fx.HEADING_PATTERN, boilerplate=fx.BOILERPLATE, **fx.SKIP_RULES
    )


def store_versions(spark, root):
    """Three runs over files of which some change after the first: what each document holds and which run read it."""
    folder = new_folder(spark, "chunk-store")
    versions = [_ingest(spark, root, folder, whole) for whole in (False, True, True)]
    named = store.documents(spark, folder).select("document_title", "page_count", "chunk_count", "read_in")
    row = F.struct("chunk_index", "content", (F.col("embedding")[0] - F.length("content")).alias("off"))
    held = store.read(spark, folder).groupBy("document_title").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    held = held.select(
        "document_title",
        F.md5(F.array_join(F.transform("rows", lambda r: r["content"]), "\n")).alias("content_md5"),
        F.exists("rows", lambda r: r["off"] != 0).alias("stale_vectors"),
    )
    return named.join(held, "document_title", "left").withColumn("newest", F.lit(versions[-1]).cast("long"))


_STORE_PAGES = f"""cleaned AS ({tq.DOC_CLEAN_SQL}),
pages_of_documents AS (
  SELECT 'Doc ' || doc_id || ' Section ' || substr('ABCDEF', CAST(doc_id % 6 AS INT) + 1, 1) AS document_title,
         1 AS page_number, cleaned AS text, doc_id
  FROM cleaned
)"""
STORE_VERSIONS_SQL = rf"""
WITH RECURSIVE {tq.CHUNKS_SQL.replace(fx.PAGES_SQL, _STORE_PAGES)},
held AS (
  SELECT document_title, count(*) AS chunk_count, md5(string_agg(content, chr(10) ORDER BY chunk_index)) AS content_md5
  FROM chunks GROUP BY 1
)
SELECT p.document_title, 1::BIGINT AS page_count, coalesce(chunk_count, 0) AS chunk_count,
       CASE WHEN p.doc_id % 5 = 0 AND d.text <> '' THEN 2 ELSE 1 END::BIGINT AS read_in, content_md5,
       CASE WHEN chunk_count > 0 THEN false END AS stale_vectors, 2::BIGINT AS newest
FROM pages_of_documents p JOIN documents d ON d.doc_id = p.doc_id LEFT JOIN held USING (document_title)"""


def store_summary(spark, root):
    """Counts of a store after one run over all files."""
    folder = new_folder(spark, "chunk-store")
    _ingest(spark, root, folder, True)
    return store.summary(spark, folder)


STORE_SUMMARY_SQL = rf"""
WITH RECURSIVE {tq.CHUNKS_SQL.replace(fx.PAGES_SQL, _STORE_PAGES)}
SELECT (SELECT count(*) FROM documents) AS document_count, (SELECT count(*)::BIGINT FROM documents) AS page_count,
       (SELECT count(*) FROM chunks) AS chunk_count"""

QUERIES = {"store_versions": store_versions, "store_summary": store_summary}
ORACLES = {"store_versions": STORE_VERSIONS_SQL, "store_summary": STORE_SUMMARY_SQL}
