"""Keyed merges into plain tables.

Every merge returns the new contents of a table; the caller writes them to a new path, because a path
that is being read cannot be overwritten safely.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.graph import components
from lectern.session import cut_lineage

MUTABLE = ("title", "summary", "content", "author", "published_at", "tags", "raw_payload")


def replace_documents(target: DataFrame, incoming: DataFrame, key: str = "chunk_id", document: str = "document_title"):
    """Contents after each incoming document's chunks replace all its stored ones.

    Stored chunks of other documents stay. Only the distinct documents of the batch are compared.
    """
    touched = incoming.select(document).distinct()
    kept = target.join(touched, document, "left_anti")
    return kept.unionByName(incoming.select(*target.columns))


def replaced_actions(target: DataFrame, incoming: DataFrame, key: str = "chunk_id", document: str = "document_title") -> DataFrame:
    """What the replacement does to each chunk of the touched documents: insert, update or delete."""
    touched = incoming.select(document).distinct()
    old = target.join(touched, document, "left_semi").select(key, F.lit(True).alias("_old"))
    new = incoming.select(key, F.lit(True).alias("_new"))
    action = (
        F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update")
    )
    return old.join(new, key, "full_outer").select(key, action.alias("action"))


def upsert_keep(target: DataFrame, incoming: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    """Insert or update by key; the columns in ``keep`` retain their stored value on update."""
    new = incoming.select(F.col(key), F.struct(*[c for c in incoming.columns if c != key]).alias("_new"))
    joined = target.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    incoming_columns = set(incoming.columns)

    def merged(name: str) -> Column:
        if name == key or name not in incoming_columns:
            return F.col(name)
        stays = F.col("_old") if name in keep else F.lit(False)
        return F.when(F.col("_new").isNotNull() & ~F.coalesce(stays, F.lit(False)), F.col(f"_new.{name}")).otherwise(
            F.col(name)
        ).alias(name)

    return joined.select(*[merged(c) for c in target.columns])


def source_key(df_source: Column | str, article_id: Column | str) -> Column:
    """Key of an article within its source; null when it has no id."""
    return F.when(
        tx.blank_to_null(article_id).isNotNull(), F.to_json(F.struct(tx.col(df_source), tx.col(article_id)))
    )


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """New rows among rows sorted by group and arrival; what is kept is the keys of one group's new rows."""
    group, taken = None, set()
    for batch in batches:
        new = []
        for own, skey, url in zip(batch["group"], batch["skey"], batch["article_url"]):
            if own != group:
                group, taken = own, set()
            keys = {("url", url)} | ({("key", skey)} if skey is not None else set())
            new.append(not keys & taken)
            if new[-1]:
                taken |= keys
        if any(new):
            yield batch.loc[new, ["arrival", "skey", "article_url"]].astype({"skey": object, "article_url": object})


def _round(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows among ``(arrival, skey, article_url)``, and the rows that none of them settles.

    A row is new if it arrives first among the rows of either of its keys. First arrivals are partial minima, so a key
    of any number of rows costs one row a task; its rows are then settled at once.
    """
    by_url = rows.groupBy("article_url").agg(F.min("arrival").alias("_url"))
    by_key = rows.filter("skey is not null").groupBy("skey").agg(F.min("arrival").alias("_key"))
    judged = cut_lineage(
        rows.join(by_url, "article_url").join(by_key, "skey", "left").withColumn(
            "new", (F.col("arrival") == F.col("_url")) & (F.col("skey").isNull() | (F.col("arrival") == F.col("_key")))
        ).select("arrival", "skey", "article_url", "new"),
        "judged-articles",
    )
    new = judged.filter("new").drop("new")
    left = judged.filter("not new").drop("new").join(new.select("article_url"), "article_url", "left_anti")
    left = left.join(new.filter("skey is not null").select("skey"), "skey", "left_anti")
    return new, cut_lineage(left.select("arrival", "skey", "article_url"), "open-articles")


def _new_articles(batch: DataFrame) -> DataFrame:
    """Keys of the batch rows that become new articles.

    Rows arrive one after another and a row is new when no earlier new row has its source key or URL. Of rows with the
    same two keys the first settles the rest. Rounds settle the open rows: those that arrive first for both of their
    keys are new, what shares a key with them is settled. Each round that leaves less than half of the open rows open is
    followed by another one. What is left after that are long chains of rows that wait for one another; their connected
    groups are replayed in order of arrival.
    """
    rows = cut_lineage(batch.groupBy("skey", "article_url").agg(F.min("arrival").alias("arrival")), "open-articles")
    rows = rows.select("arrival", "skey", "article_url")
    found, count = None, rows.count()
    while True:
        new, rows = _round(rows)
        found = new if found is None else found.unionByName(new)
        left = rows.count()
        if not left:
            return found
        if 2 * left > count:
            return found.unionByName(_replayed(rows))
        count = left


def _replayed(rows: DataFrame) -> DataFrame:
    """New rows of connected groups, each taken in order of arrival."""
    ends = rows.withColumn("_url", F.xxhash64(F.lit("url"), "article_url")).withColumn(
        "_key", F.when(F.col("skey").isNotNull(), F.xxhash64(F.lit("key"), "skey"))
    )
    groups = components(ends.filter(F.col("_key").isNotNull()), "_url", "_key")
    grouped = ends.join(groups, F.col("_url") == F.col("node"), "left").select(
        F.coalesce("component", "_url").alias("group"), "arrival", "skey", "article_url"
    )
    ordered = grouped.repartition("group").sortWithinPartitions("group", "arrival")
    return cut_lineage(ordered.mapInPandas(_replay, "arrival long, skey string, article_url string"), "new-articles")


def upsert_articles(
    stored: DataFrame, incoming: DataFrame, fetched_at: Column, address: str = "article_url"
) -> DataFrame:
    """Stored articles after a batch of ``incoming`` rows applied in ``arrival`` order.

    A row matches by source and id first, then by URL, also articles that are marked deleted. The last
    matching row sets the mutable columns and clears the mark; identity columns never change.
    ``address`` is the column that stands for the URL where several articles have one; both tables hold it.
    """
    keyed = incoming.withColumn("skey", source_key("source_name", "source_article_id"))
    stored_keys = stored.select(
        "id", source_key("source_name", "source_article_id").alias("skey"), F.col(address).alias("article_url")
    ).withColumn("arrival", F.lit(0).cast("long"))
    batch = keyed.select("arrival", "skey", F.col(address).alias("article_url"))
    unmatched = batch.join(stored_keys.filter(F.col("skey").isNotNull()).select("skey"), "skey", "left_anti").join(
        stored_keys.select("article_url"), "article_url", "left_anti"
    )
    inserted = _new_articles(unmatched)
    last_id = stored.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new_keys = inserted.select((last_id + F.col("arrival")).alias("id"), "skey", "article_url", "arrival")
    entities = stored_keys.select("id", "skey", "article_url", "arrival").unionByName(new_keys)
    # An article can only be matched by rows that arrive with it or after it.
    by_key = entities.filter(F.col("skey").isNotNull()).select(
        "skey", F.col("id").alias("_key_id"), F.col("arrival").alias("_key_from")
    )
    by_url = entities.select(
        F.col("article_url").alias(address), F.col("id").alias("_url_id"), F.col("arrival").alias("_url_from")
    )
    matched = keyed.join(by_key, "skey", "left").join(by_url, address, "left").withColumn(
        "id",
        F.coalesce(
            F.when(F.col("_key_from") <= F.col("arrival"), F.col("_key_id")),
            F.when(F.col("_url_from") <= F.col("arrival"), F.col("_url_id")),
        ),
    )
    identity = tuple(dict.fromkeys(("source_name", "source_article_id", "article_url", address)))
    changes = matched.groupBy("id").agg(
        F.max_by(F.struct(*MUTABLE), "arrival").alias("_last"),
        F.min_by(F.struct(*identity), "arrival").alias("_first"),
    )
    joined = stored.withColumn("_old", F.lit(True)).join(changes, "id", "full_outer")
    touched = F.col("_last").isNotNull()
    columns = []
    for name in stored.columns:
        if name in MUTABLE:
            value = F.when(touched, F.col(f"_last.{name}")).otherwise(F.col(name))
        elif name in identity:
            value = F.when(F.col("_old").isNull(), F.col(f"_first.{name}")).otherwise(F.col(name))
        elif name == "is_deleted":
            value = F.when(touched, F.lit(False)).otherwise(F.col(name))
        elif name == "fetched_at":
            value = F.when(F.col("_old").isNull(), fetched_at).otherwise(F.col(name))
        else:
            value = F.col(name)
        columns.append(value.alias(name))
    return joined.select(*columns)


def backfill(articles: DataFrame, details: DataFrame, key: str = "article_url") -> DataFrame:
    """Articles with each field replaced by the fetched detail's where that is not empty.

    ``details`` is one row per ``key``; the raw payload is kept.
    """
    fetched = details.select(
        key, *[F.col(c).alias(f"_new_{c}") for c in ("summary", "content", "author", "tags")]
    )
    joined = articles.join(fetched, key, "left")
    text_fields = {c: tx.first_of(f"_new_{c}", c) for c in ("summary", "content", "author")}
    tags = F.when(F.size("_new_tags") > 0, F.col("_new_tags")).otherwise(F.coalesce("tags", tx.string_array([])))
    return joined.select(*[text_fields.get(c, tags if c == "tags" else F.col(c)).alias(c) for c in articles.columns])
