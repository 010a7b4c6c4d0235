"""Answers to questions about the rules: evidence by the kind of question, then status, text and citations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import vocab
from lectern.operators import answers, retrieval, routing

SECTION_CHUNKS = 6
TOPICS = 5
EVIDENCE = ["document_title", "article", "section", "page", "content"]


def overview_rows(chunks: DataFrame, limit: int) -> DataFrame:
    """Representative chunks of every section; a chunk's heading is the end of its heading path, or its article."""
    heading = F.col("article")
    if "heading_path" in chunks.columns:
        heading = F.coalesce(F.get("heading_path", F.size("heading_path") - 1), heading)
    chosen = retrieval.representative_chunks(chunks, limit)
    return chosen.select(
        "section_code", "rank", "chunk_id", "document_title", "article", F.col("section_code").alias("section"), "page",
        "content", heading.alias("heading"),
    )


def evidence_rows(judged: DataFrame, retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence of each question in order: its section's chunks, one chunk a section, or what was retrieved."""
    related = judged.filter(~F.col("unrelated"))
    columns = ["query_id", "rank", "chunk_id", *EVIDENCE, "heading", "strong"]
    sections = related.filter("query_type = 'section_overview'").join(
        overview_rows(chunks, SECTION_CHUNKS), F.col("asked_section") == F.col("section_code")
    )
    # One row a section goes to every question of this type, as one short array and not by a join.
    first = overview_rows(chunks, 1)
    row = F.struct("section_code", *[c for c in first.columns if c not in ("section_code", "rank")])
    listed = first.select(F.array_sort(F.collect_list(row))).scalar()
    document = related.filter("query_type = 'document_overview'").select("query_id", F.posexplode(listed).alias("_n", "_row"))
    document = document.select("query_id", (F.col("_n") + 1).alias("rank"), "_row.*")
    facts = related.filter("query_type = 'fact_lookup'").join(retrieved, "query_id")
    return (
        sections.withColumn("strong", F.lit(True)).select(columns)
        .unionByName(document.withColumn("strong", F.lit(True)).select(columns))
        .unionByName(facts.withColumn("heading", F.col("article")).select(columns))
    )


def ask(
    judged: DataFrame,
    retrieved: DataFrame,
    chunks: DataFrame,
    summaries: Mapping[str, str] = vocab.SECTION_SUMMARIES,
) -> DataFrame:
    """One answer a question: ``answer, answer_status, confidence, source_mode, evidence_count, citations``.

    ``judged`` is ``(query_id, question, query_type, asked_section, unrelated)``, ``retrieved`` the reranked chunks of
    the questions and ``chunks`` the corpus, with pages. A question has at most ``SECTION_CHUNKS`` rows of evidence.
    """
    rows = evidence_rows(judged, retrieved, chunks)
    row = F.struct("rank", "chunk_id", *EVIDENCE, "heading")
    gathered = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(row)).alias("evidence"),
        # Evidence that nothing has judged is taken for strong.
        F.coalesce(F.bool_or("strong"), F.lit(True)).alias("strong"),
    )
    best = F.get("evidence", 0)
    headings = F.array_distinct(F.array_compact(F.transform("evidence", lambda e: F.nullif(e["heading"], F.lit("")))))
    joined = (
        judged.join(gathered, "query_id", "left")
        .withColumn("best", best)
        .withColumn("topics", F.slice(headings, 1, TOPICS))
        .withColumn("evidence_count", F.when(F.col("evidence").isNull(), 0).otherwise(F.size("evidence")).cast("long"))
        .withColumn("strong", F.coalesce("strong", F.lit(False)))
    )
    parts = ["best.document_title", "best.article", "best.page"]
    text = (
        F.when(F.col("query_type") == "section_overview", section_text(summaries))
        .when(F.col("query_type") == "document_overview", document_text(summaries))
        .when((F.col("evidence_count") > 0) & ~F.col("strong"), answers.partial_answer(*parts))
        .otherwise(answers.fallback_answer("question", *parts))
    )
    status = routing.answer_status("query_type", "evidence_count", "strong")
    citations = F.coalesce(
        F.transform("evidence", lambda e: F.struct(*[e[c].alias(c) for c in EVIDENCE])),
        F.array().cast("array<struct<document_title:string,article:string,section:string,page:bigint,content:string>>"),
    )
    return joined.select(
        "query_id", "query_type", "evidence_count", status.alias("_s"), text.alias("answer"), citations.alias("citations")
    ).select("query_id", "query_type", "evidence_count", "_s.*", "answer", "citations")


def section_text(summaries: Mapping[str, str]) -> Column:
    missing = F.format_string(answers.NO_SECTION, "asked_section")
    found = answers.section_answer(
        F.col("asked_section"), F.col("topics"), F.col("best.document_title"), F.col("best.article"), F.col("best.page"),
        summaries,
    )
    return F.when(F.col("evidence_count") == 0, missing).otherwise(found)


def document_text(summaries: Mapping[str, str]) -> Column:
    """Summaries of the sections that the evidence shows, in their order."""
    known = F.array(*[F.struct(F.lit(k).alias("section"), F.lit(v).alias("summary")) for k, v in summaries.items()])
    shown = F.filter(
        known,
        lambda s: F.exists(
            "evidence", lambda e: (e["section"] == s["section"]) | F.contains(e["document_title"], s["section"])
        ),
    )
    lines = F.array_join(F.transform(shown, lambda s: F.concat(s["section"], F.lit(": "), s["summary"])), " ")
    article = F.coalesce(F.nullif("best.article", F.lit("")), F.lit("section metadata"))
    found = F.format_string(answers.DOCUMENT_ANSWER, lines, F.col("best.document_title"), article)
    return F.when(F.col("evidence_count") == 0, F.lit(answers.NO_DOCUMENT)).otherwise(found)


def judge(asked: DataFrame, kind: Column, unrelated: Column) -> DataFrame:
    """Questions with their type, the section that they ask about and whether they are beside the subject."""
    return asked.select(
        "query_id", "question", kind.alias("_k"), F.coalesce(unrelated, F.lit(False)).alias("unrelated")
    ).select("query_id", "question", "_k.query_type", F.col("_k.section").alias("asked_section"), "unrelated")
