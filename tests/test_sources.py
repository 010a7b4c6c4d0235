"""Documents, tables and stored records."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import html
from lectern.operators import routing, sessions
from lectern.sources import files


def test_documents_are_found_and_read_clean(spark, folder):
    for name, pages in {"Rules Section B": ["One  line\r\nTwo", ""], "Other": ["Alone"]}.items():
        with open(os.path.join(folder, f"{name}.pdf"), "wb") as out:
            out.write("\f".join(pages).encode())
    found = files.discover_documents(spark, folder).collect()
    assert [r.document_title for r in found] == ["Other", "Rules Section B"]
    pages = files.read_documents(spark, folder, lambda raw: raw.decode().split("\f"))
    rows = sorted((r.document_title, r.page_number, r.text) for r in pages.collect())
    assert rows == [("Other", 1, "Alone"), ("Rules Section B", 1, "One line\nTwo"), ("Rules Section B", 2, "")]


def test_chunk_rows_and_worklist(spark):
    chunk = [("c1", "Rules Section B", None, "B1", 3, 3, 4, ["H"], 0, "text", "p"), ("c2", "X", None, None, 1, 1, 1, [], 0, "t", "p")]
    rows = files.import_rows(spark.createDataFrame(chunk, schemas.CHUNK), "pdf").withColumn(
        "id", F.when(F.col("chunk_id") == "c1", 1).otherwise(2)
    )
    half = rows.withColumn("embedding", F.when(F.col("id") == 1, F.array(F.lit(1.0).cast("float"))))
    assert [r.id for r in files.embedding_worklist(half).collect()] == [2]
    assert [r.id for r in files.embedding_worklist(half, 1, overwrite=True).collect()] == [1]
    assert files.embedding_worklist(files.clear_embeddings(half)).count() == 2
    stored = rows.withColumn(
        "metadata", F.struct(F.lit(5).alias("page_start"), F.lit(None).cast("int").alias("page_end"), F.lit(None).cast("array<string>").alias("heading_path"))
    )
    shaped = {r.chunk_id: r for r in files.chunk_table(stored).collect()}
    assert (shaped["c1"].page_start, shaped["c1"].page_end, shaped["c1"].heading_path) == (5, 3, [])
    assert files.first_filled(rows.limit(0), half).count() == 2 and files.first_filled(rows, half.limit(0)).count() == 2


def test_articles_are_read_and_checked(spark, folder):
    path = os.path.join(folder, "articles.json")
    with open(path, "w") as out:
        out.write('[{"source_name": "s", "title": "t", "article_url": "u", "tags": ["a"]}]')
    assert files.read_articles(spark, path).first().title == "t"


def test_records_round_trip_and_expire(spark):
    now = datetime(2026, 1, 10)
    memories = spark.createDataFrame(
        [(f"m{i}", "likes it", "preference", "o", 0.6, "s", now, now - timedelta(days=i)) for i in range(30)],
        schemas.MEMORY.removeprefix("struct<").removesuffix(">"),
    )
    stored = memories.select("memory_id", files.encode(F.struct(*memories.columns)).alias("text"))
    back = stored.select(files.decode_memory("text").alias("m")).select("m.*")
    assert back.exceptAll(memories).count() == 0 and back.count() == 30
    session = spark.sql("SELECT named_struct('session_id', 's1', 'summary', 'x', 'compacted_turn_count', 2) AS s")
    assert session.select(files.decode_session(files.encode("s")).alias("r")).first().r.compacted_turn_count == 2
    index = memories.select("memory_id", "owner_id", "updated_at")
    newest = files.newest_memories(index, memories, "o", 3, F.lit(now), 5 * 86400)
    assert sorted(r.memory_id for r in newest.collect()) == [f"m{i}" for i in range(5)]


def test_what_is_routed(spark):
    rows = spark.createDataFrame(
        [(1, "and then?", "Long-term memory:\n- likes rain\n\nRecent turns:\nUser: x", True), (2, "hi", "Long-term memory:\n- likes rain", False), (3, "hi", None, False)],
        "id int, message string, context string, follow_up boolean",
    )
    routed = rows.select(sessions.effective_message("message", "context", F.col("follow_up")).alias("m")).collect()
    assert routed[0].m.startswith("Long-term memory:") and "Recent turns" in routed[0].m
    assert routed[1].m == "Long-term memory:\n- likes rain\n\nCurrent user message:\nUser: hi"
    assert routed[2].m == "hi"
    open_rows = spark.createDataFrame([("tell me more of it all", "general"), ("hello", "general"), ("x", "race")], "m string, i string")
    assert [r.w for r in open_rows.select(routing.wants_planner("m", "i").alias("w")).collect()][1:] == [False, False]
    text = spark.createDataFrame([("<p>A &amp; <b>b</b></p>",)], "h string").select(html.strip_html("h").alias("t")).first().t
    assert text.split() == ["A", "&", "b"]
