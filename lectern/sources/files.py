"""Readers and writers of the corpus, article and evaluation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import text as tx
from lectern.operators.chunking import section_of_title
from lectern.operators.cleaning import clean_text


def discover_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Path, size and title of the folder's document files, without opening them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", "length", F.regexp_replace(name, r"\.[^.]*$", "").alias("document_title")).orderBy("path")


def read_documents(spark: SparkSession, folder: str, page_reader, pattern: str = "*.pdf") -> DataFrame:
    """Pages of the folder's documents as ``(document_title, page_number, text, source_path)``.

    ``page_reader`` turns a file's bytes into the list of its page texts, which are cleaned. Files are read where
    they are processed, one at a time per task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def pages(frames):
        import os

        import pandas as pd

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                texts = [text or "" for text in page_reader(content)]
                yield pd.DataFrame(
                    {
                        "document_title": os.path.splitext(os.path.basename(path))[0],
                        "page_number": range(1, len(texts) + 1),
                        "text": texts,
                        "source_path": path,
                    }
                )

    read = files.mapInPandas(pages, "document_title string, page_number int, text string, source_path string")
    return read.withColumn("text", clean_text("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a manifest, either a JSON array or one object per line."""
    return spark.read.schema(schemas.CHUNK).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHUNK).option("mode", "FAILFAST").json(path)


def write_manifest(chunks: DataFrame, path: str) -> None:
    """One JSON object per line: parts are written where they are, in as many files as there are tasks."""
    chunks.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def chunk_table(rows: DataFrame) -> DataFrame:
    """Stored chunks in reading shape: page range and headings from the metadata, else from the page."""
    return rows.select(
        "chunk_id",
        F.col("id").alias("ord"),
        "document_title",
        F.col("section_code").alias("section"),
        "article",
        "page",
        F.coalesce("metadata.page_start", "page").alias("page_start"),
        F.coalesce("metadata.page_end", "page").alias("page_end"),
        F.coalesce("metadata.heading_path", tx.string_array([])).alias("heading_path"),
        "content",
    )


def first_filled(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The first table unless it is empty; one row is looked for, nothing is counted."""
    return fallback if primary.isEmpty() else primary


def import_rows(chunks: DataFrame, source: str, version: int = 1) -> DataFrame:
    """Manifest chunks as table rows that wait for their vectors."""
    return chunks.select(
        "chunk_id",
        "document_title",
        section_of_title("document_title").alias("section_code"),
        "article",
        F.col("page_number").alias("page"),
        "content",
        F.lit(None).cast("array<float>").alias("embedding"),
        F.struct(F.lit(source).alias("source"), F.lit(version).alias("ingest_version")).alias("metadata"),
    )


def embedding_worklist(chunks: DataFrame, limit: int | None = None, overwrite: bool = False) -> DataFrame:
    rows = chunks if overwrite else chunks.filter(F.col("embedding").isNull())
    return rows.orderBy("id") if limit is None else rows.orderBy("id").limit(limit)


def clear_embeddings(chunks: DataFrame) -> DataFrame:
    """Table rows without vectors, as after a change of their width."""
    return chunks.withColumn("embedding", F.lit(None).cast("array<float>"))


def valid_article() -> Column:
    """Null for an acceptable article, else what is wrong with it."""
    missing = [F.when(tx.blank_to_null(c).isNull(), F.lit(f"{c} is required")) for c in schemas.ARTICLE_REQUIRED]
    long = [F.when(F.length(c) > n, F.lit(f"{c} is longer than {n}")) for c, n in schemas.ARTICLE_LENGTHS.items()]
    return F.get(F.array_compact(F.array(*missing, *long)), 0)


def checked_articles(rows: DataFrame) -> DataFrame:
    """The rows; a job over an unacceptable one fails and names the fault."""
    fault = valid_article()
    return rows.withColumn("title", F.when(fault.isNull(), F.col("title")).otherwise(F.raise_error(fault)))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a JSON array file, checked."""
    rows = spark.read.schema(schemas.ARTICLE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return checked_articles(rows)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases, one per line; blank lines are skipped and a case that lacks a field fails the job."""
    rows = spark.read.schema(schemas.EVAL_CASE).option("mode", "FAILFAST").json(path)
    lacking = F.get(
        F.array_compact(
            F.array(*[F.when(F.col(c).isNull(), F.lit(f"case lacks {c}")) for c in schemas.REQUIRED_CASE_FIELDS])
        ),
        0,
    )
    name = F.when(lacking.isNull(), F.col("name")).otherwise(F.raise_error(lacking))
    empty = tx.string_array([])
    return rows.select(
        name.alias("name"),
        "messages",
        "expected_intent",
        "expected_tool",
        "expected_action",
        F.coalesce("must_include", empty).alias("must_include"),
        F.coalesce("must_not_include", empty).alias("must_not_include"),
        F.col("expected_answer_status").alias("expected_status"),
    )


def encode(record: Column | str) -> Column:
    """A session or memory record as stored text."""
    return F.to_json(tx.col(record))


def decode_session(stored: Column | str) -> Column:
    return F.from_json(tx.col(stored), schemas.SESSION)


def decode_memory(stored: Column | str) -> Column:
    return F.from_json(tx.col(stored), schemas.MEMORY)


def live(rows: DataFrame, now: Column, ttl_seconds: int, updated: str = "updated_at") -> DataFrame:
    """Records whose time to live has not passed."""
    return rows.filter(F.unix_timestamp(now) - F.unix_timestamp(updated) < ttl_seconds)


def newest_memories(index: DataFrame, memories: DataFrame, owner: str, top_k: int, now: Column, ttl_seconds: int) -> DataFrame:
    """An owner's live memories among the newest of the index; the index forgets nothing, so fewer may remain."""
    reach = max(top_k * 5, 20) + 1
    newest = index.filter(F.col("owner_id") == owner).orderBy(F.desc("updated_at"), F.asc("memory_id")).limit(reach)
    return live(memories.join(newest.select("memory_id"), "memory_id"), now, ttl_seconds)
