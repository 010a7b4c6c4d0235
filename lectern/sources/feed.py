"""News feed items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import dates
from lectern.functions import text as tx

ITEM = "title string, link string, description string, guid string, pubDate string"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of feed files as ``(xml fields…)`` rows with their file and position."""
    return (
        spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
        .withColumn("order", F.monotonically_increasing_id())
    )


def shape_items(items: DataFrame) -> DataFrame:
    """Valid items as article columns: an item needs a link and a title that is not blank."""
    title = tx.strip(F.coalesce("title", F.lit("")))
    return items.filter(tx.blank_to_null("link").isNotNull() & (title != "")).select(
        title.alias("title"),
        tx.collapse_or_null("description").alias("summary"),
        F.col("link").alias("article_url"),
        tx.last_url_segment("link").alias("source_article_id"),
        dates.parse_mail_date("pubDate").alias("published_at"),
        F.to_json(
            F.struct(F.col("guid").alias("id"), "link", F.col("pubDate").alias("published")), {"ignoreNullFields": "false"}
        ).alias("raw_payload"),
    )


def first_items(items: DataFrame, order: str, limit: int, feed: str | None) -> DataFrame:
    if feed is None:
        return items.orderBy(order).limit(limit)
    nth = F.row_number().over(Window.partitionBy(feed).orderBy(order))
    return items.withColumn("_nth", nth).filter(F.col("_nth") <= limit).drop("_nth")


def latest_items(items: DataFrame, order: str, limit: int = 20, feed: str | None = None) -> DataFrame:
    """First ``limit`` items of the feed, or of each ``feed``, then only the valid ones, so fewer may remain."""
    return shape_items(first_items(items, order, limit, feed))


def parse_items(
    rows: DataFrame, order: str, limit: int = 20, column: str = "xml", feed: str | None = None
) -> DataFrame:
    """As ``latest_items`` for item elements held in a text column."""
    first = first_items(rows, order, limit, feed)
    return shape_items(first.select(order, F.from_xml(F.col(column), F.lit(ITEM)).alias("i")).select("i.*"))
