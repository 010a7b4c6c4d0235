"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import checkpoint_dir, cut_lineage

#: Rows of one Arrow batch. Documents may be megabytes long, so the default of 10,000 is too many.
BATCH_ROWS = 256


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` over batches of a bounded number of rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def text_of(column: str) -> Column:
    """The text, a missing one as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``doc_id`` and ``text`` alone, whatever else the table holds; rows without an id go."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).filter(
        F.col("doc_id").isNotNull()
    )


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name in the shared folder that no earlier run has used."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{os.urandom(6).hex()}"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared location, as tasks open it."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def put_file(folder: str, name: str, content: bytes) -> str:
    """Write a file that no other attempt of the task writes; it counts once a manifest names it."""
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    unique = f"{name}-{os.urandom(8).hex()}"
    with system.open_output_stream(f"{path}/{unique}", compression=None) as out:
        out.write(content)
    return f"{folder}/{unique}"


def get_range(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    """Bytes of a shared file, all of them or a range."""
    system, path = place(uri)
    with system.open_input_file(path) as source:
        if offset:
            source.seek(offset)
        return source.read() if length is None else source.read(length)


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a small table of work items over all tasks; adaptive execution would join them in one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ranked(df: DataFrame, keys: list[str], order: list[str], blocks: int, name: str = "rank") -> DataFrame:
    """Add the gapless rank of each row within ``keys``, from 0, with no task that holds a whole key.

    Rows are cut into ``blocks`` hashed blocks a key. The first row of a block is the number of rows in the
    blocks before it, its other rows follow in ``order``, which must be unique within a key.
    """
    block = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        block.groupBy(*keys, "_block")
        .count()
        .select(*keys, "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        block.withColumn("_row", F.row_number().over(inside))
        .join(first, [*keys, "_block"])
        .withColumn(name, (F.col("_first") + F.col("_row") - 1).cast("long"))
        .drop("_block", "_first", "_row")
    )


def ranked_in_order(rows: DataFrame, key: str, order: list[str], total: str = "n", name: str = "rank") -> DataFrame:
    """Add the gapless place of each row among those of its ``key`` by ``order``, from 0, and their number ``total``.

    Rows are cut into ranges of key and order, so a key may fill many tasks; only counts of ranges meet by key. Rows
    equal in ``order`` come in any order. ``key`` must not be null. The ordered rows are written.
    """
    placed = cut_lineage(
        rows.repartitionByRange(key, *order)
        .sortWithinPartitions(key, *order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_part", F.shiftright("_at", 33))
    ranges = placed.groupBy(key, "_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranges.select(
        key,
        "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low")).alias("_shift"),
        F.sum("_rows").over(whole).alias(total),
    )
    return placed.join(shift, [key, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
