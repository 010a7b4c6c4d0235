"""A store of chunks that only changes where its files do.

Chunks lie in buckets by document. A manifest names, for each version, the place of every bucket and that of the list of
files that were read, with their digests. Ingestion compares digests, reads new and changed files, rewrites the buckets of
their documents and the list in places of their own and then writes the manifest, one small file, which makes the version
visible. What a run leaves behind that ends before is in no manifest. Places of earlier versions stay, so readers of those
are not disturbed.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from types import MappingProxyType

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern import vocab
from lectern.operators import chunking, vectors
from lectern.operators.cleaning import clean_text
from lectern.session import cut_lineage

BUCKETS = 64
CHUNKS = (
    "chunk_id string, document_title string, section_code string, article string, page_number int, page_start int, "
    "page_end int, heading_path array<string>, chunk_index int, content string, source_path string, embedding array<float>"
)
MANIFEST = (
    "kind string, path string, digest string, document_title string, page_count long, chunk_count long, "
    "read_in long, bucket int, place string"
)
PAGE = "path string, document_title string, page_number int, text string"


def document_title(path: Column) -> Column:
    """Name of a file without its folders and its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def manifest(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    """The newest version, 0 for an empty store, and what its manifest names."""
    try:
        rows = spark.read.schema(f"{MANIFEST}, version long").parquet(os.path.join(folder, "manifest"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, spark.createDataFrame([], MANIFEST)
    newest = rows.agg(F.max("version")).first()[0] or 0
    named = rows.filter(F.col("version") == newest).drop("version")
    # The files of older manifests lie in the manifest itself.
    lists = [r["place"] for r in named.filter("kind = 'files'").select("place").collect()]
    if lists:
        named = named.filter("kind <> 'files'").unionByName(spark.read.schema(MANIFEST).parquet(*lists))
    return newest, named


def places(named: DataFrame) -> dict[int, str]:
    """Place of each bucket; at most as many as the store has buckets."""
    return {r["bucket"]: r["place"] for r in named.filter("kind = 'bucket'").select("bucket", "place").collect()}


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the newest version."""
    found = places(manifest(spark, folder)[1])
    if not found:
        return spark.createDataFrame([], CHUNKS)
    return spark.read.schema(CHUNKS).parquet(*found.values())


def bucket_of(title: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(title), F.lit(buckets)).cast("int")


def changed(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose digest the manifest does not name. Of files with one title the last in path order is the document."""
    one = Window.partitionBy("document_title").orderBy(F.desc("path"))
    single = listed.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    old = known.filter("kind = 'file'").select("document_title", F.struct("path", "digest").alias("_old"))
    joined = single.join(old, "document_title", "left")
    same = F.coalesce((F.col("_old.digest") == F.col("digest")) & (F.col("_old.path") == F.col("path")), F.lit(False))
    return joined.filter(~same).select("path", "digest", "document_title")


def pages_of(files: DataFrame, page_reader: Callable[[bytes], list[str | None]], boilerplate: Mapping) -> DataFrame:
    """Cleaned pages of ``(path, document_title, content)``; a file is read where it lies."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, title, content in zip(frame["path"], frame["document_title"], frame["content"]):
                texts = [text or "" for text in page_reader(bytes(content))]
                yield pd.DataFrame(
                    {"path": path, "document_title": title, "page_number": range(1, len(texts) + 1), "text": texts}
                )

    pages = files.select("path", "document_title", "content").mapInPandas(work, PAGE)
    return pages.withColumn("text", clean_text("text", **boilerplate))


def ingest(
    files: DataFrame,
    folder: str,
    page_reader: Callable[[bytes], list[str | None]],
    embed: Callable | None = None,
    buckets: int = BUCKETS,
    cap: int = vocab.CHUNK_CHARS,
    pattern: str = vocab.HEADING_PATTERN,
    boilerplate: Mapping = MappingProxyType({}),
    **skip_rules,
) -> int:
    """Bring the store up to the files ``(path, content)``; the version that readers see then.

    Nothing is written if no file is new or changed. A file that is no longer there keeps its chunks. ``embed`` fills
    the vectors of the chunks that are written; those of other chunks stay.
    """
    spark = files.sparkSession
    version, known = manifest(spark, folder)
    listed = files.select(
        "path", F.sha2("content", 256).alias("digest"), document_title(F.col("path")).alias("document_title")
    )
    todo = cut_lineage(changed(listed, known), "changed-files")
    if todo.isEmpty():
        return version
    version += 1
    content = files.join(todo.select("path", "document_title"), "path")
    pages = cut_lineage(pages_of(content, page_reader, boilerplate), "pages")
    chunks = chunking.chunk_pages(pages.withColumnRenamed("path", "source_path"), cap, pattern, **skip_rules)
    empty = F.lit(None).cast("array<float>")
    chunks = chunks.withColumn("embedding", empty)
    if embed:
        chunks = vectors.embed_missing(chunks, embed)
    fresh = cut_lineage(chunks.withColumn("bucket", bucket_of("document_title", buckets)), "chunks")
    titles = todo.select("document_title")
    touched = {r["bucket"] for r in titles.select(bucket_of("document_title", buckets).alias("bucket")).distinct().collect()}
    standing = places(known)
    rewritten = [standing[b] for b in sorted(touched & set(standing))]
    columns = [*spark.createDataFrame([], CHUNKS).columns, "bucket"]
    whole = fresh.select(*columns)
    if rewritten:
        stored = spark.read.schema(CHUNKS).parquet(*rewritten).join(titles, "document_title", "left_anti")
        whole = stored.withColumn("bucket", bucket_of("document_title", buckets)).select(*columns).unionByName(whole)
    target = os.path.join(folder, "data", f"version={version:012d}")
    whole.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    written = spark.read.schema(f"{CHUNKS}, bucket int").parquet(target).select("bucket").distinct()
    new_places = written.select(
        "bucket", F.concat(F.lit(target + "/bucket="), F.col("bucket").cast("string")).alias("place")
    )
    kept = [(b, place) for b, place in standing.items() if b not in touched]
    all_places = new_places.unionByName(spark.createDataFrame(kept, "bucket int, place string"))
    counts = pages.groupBy("document_title").agg(F.count(F.lit(1)).alias("page_count"))
    chunk_counts = fresh.groupBy("document_title").agg(F.count(F.lit(1)).alias("chunk_count"))
    read_now = todo.join(counts, "document_title", "left").join(chunk_counts, "document_title", "left").select(
        F.lit("file").alias("kind"), "path", "digest", "document_title",
        F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.lit(version).cast("long").alias("read_in"),
    )
    before = known.filter("kind = 'file'").join(titles, "document_title", "left_anti")
    # The list is as long as there are files: its tasks write it where they join it. The manifest has a row a bucket.
    list_place = os.path.join(folder, "files", f"version={version:012d}")
    listing = before.unionByName(read_now, allowMissingColumns=True).select(*known.columns)
    listing.hint("rebalance").write.mode("overwrite").parquet(list_place)
    named = (
        all_places.withColumn("kind", F.lit("bucket"))
        .unionByName(spark.createDataFrame([("files", list_place)], "kind string, place string"), allowMissingColumns=True)
        .unionByName(spark.createDataFrame([], MANIFEST), allowMissingColumns=True)
        .select(*known.columns)
    )
    named.repartition(1).write.mode("overwrite").parquet(os.path.join(folder, "manifest", f"version={version:012d}"))
    return version


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the newest version: what they hold and the version that read them."""
    columns = ["path", "digest", "document_title", "page_count", "chunk_count", "read_in"]
    return manifest(spark, folder)[1].filter("kind = 'file'").select(*columns)


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts over the documents of the newest version."""
    return documents(spark, folder).agg(
        F.count(F.lit(1)).alias("document_count"),
        F.coalesce(F.sum("page_count"), F.lit(0)).alias("page_count"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunk_count"),
    )
