"""From raw documents to packed training sequences, in four stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as the next one's
documents. Rows of one id with different texts are documents of their own. Rows without an id pass the filters, which
know documents by id and text, and end at the last stage.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm import fuse_dedup, packing, rff_quality, setsketch
from lectern.session import cut_lineage, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
FOLDS = 5
PASS_SCORE = 0.3
#: Words of a shingle of the near-duplicate stage.
SHINGLE_WORDS = 5
END_ID = 0
ORACLE_SQL = None


def without(docs: DataFrame, gone: DataFrame, **prints: Column) -> DataFrame:
    """Documents whose id is not among those of ``gone``; with ``prints`` by column, whose id and print are not."""
    known = gone.select("doc_id", *prints).distinct()
    return docs.select(*COLUMNS).withColumns(prints).join(known, ["doc_id", *prints], "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of the documents at hand.

    Rows of one id are judged by the best of them.
    """
    ship_package(spark)
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    scored = rff_quality.score_documents(docs, labels, "quality", fold != 0, fold == 1)
    best = scored.groupBy("doc_id").agg(F.max("score").alias("score"))
    return without(docs, best.filter(F.col("score") < PASS_SCORE))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts. The older half by id is the snapshot."""
    ship_package(spark)
    middle = docs.agg(F.percentile_approx("doc_id", 0.5).alias("m")).first()["m"]
    groups = fuse_dedup.deduplicate(docs, F.col("doc_id") <= F.lit(middle))
    bare = F.sha2(F.translate(F.coalesce("text", F.lit("")), fuse_dedup.SPACES, ""), 256)
    left = without(docs, groups.filter("not kept"), text_sha256=bare)
    # Of equal texts under one id, the row that has the most of the text.
    again = Window.partitionBy("doc_id", "_bare").orderBy(F.length("text").desc(), F.xxhash64("text"))
    known = left.filter("doc_id is not null").withColumn("_bare", F.xxhash64(bare))
    single = known.withColumn("_copy", F.row_number().over(again)).filter("_copy = 1").select(*COLUMNS)
    return single.unionByName(left.filter("doc_id is null"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    ship_package(spark)
    groups = setsketch.near_duplicates(docs, words=SHINGLE_WORDS, prints=True)
    return without(docs, groups.filter("not kept"), print=F.xxhash64(F.coalesce("text", F.lit(""))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of tokens."""
    ship_package(spark)
    pieces = packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return packing.place_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole documents table."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
