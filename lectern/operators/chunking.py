"""Structural chunking of document pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import vocab
from lectern.functions import text as tx


def section_of_title(title: Column | str) -> Column:
    """``Section X`` named in a title, else null."""
    return tx.blank_to_null(F.initcap(F.regexp_extract(tx.col(title), vocab.TITLE_SECTION_PATTERN, 1)))


def section_code(value: Column | str) -> Column:
    """Canonical ``Section X`` for a code or bare letter; any other value is returned unchanged."""
    text = tx.col(value)
    named = F.regexp_extract(text, vocab.SECTION_PATTERN, 1)
    bare = F.regexp_extract(text, f"(?i)^{tx.WHITESPACE}*([a-f]){tx.WHITESPACE}*$", 1)
    letter = F.upper(tx.first_of(named, bare))
    return F.coalesce(F.concat(F.lit("Section "), letter), text)


def heading_article(line: Column, pattern: str = vocab.HEADING_PATTERN) -> Column:
    return tx.blank_to_null(F.upper(F.regexp_extract(line, pattern, 1)))


def chunk_id(title: Column | str, page: Column | str, index: Column | str) -> Column:
    return F.concat(tx.slug(title), F.lit("-p"), tx.col(page), F.lit("-c"), tx.col(index))


def carry_heading_forward(
    pages: DataFrame, keys: list[str], text_col: str, pattern: str = vocab.HEADING_PATTERN
) -> DataFrame:
    """One row per line with the last heading seen on its page.

    A page is one row, so its lines are cut at the headings and exploded segment by segment. This is
    linear in the page and needs neither a shuffle nor a window over the page.
    """
    lined = pages.select(*keys, tx.lines(text_col).alias("_lines"))
    starts = F.filter(
        F.transform(
            F.col("_lines"), lambda line, i: F.when((i == 0) | heading_article(line, pattern).isNotNull(), i)
        ),
        lambda i: i.isNotNull(),
    )
    segments = lined.withColumn("_starts", starts).select(
        *keys,
        "_lines",
        F.explode(
            F.transform(
                F.col("_starts"),
                lambda start, n: F.struct(
                    start.alias("first"),
                    F.coalesce(F.get(F.col("_starts"), n + 1), F.size("_lines")).alias("end"),
                ),
            )
        ).alias("_segment"),
    )
    opened = segments.select(
        *keys,
        F.col("_segment.first").alias("_first"),
        heading_article(F.get(F.col("_lines"), F.col("_segment.first")), pattern).alias("article"),
        F.slice("_lines", F.col("_segment.first") + 1, F.col("_segment.end") - F.col("_segment.first")).alias(
            "_segment_lines"
        ),
    )
    return opened.select(*keys, "_first", "article", F.posexplode("_segment_lines").alias("_offset", "line")).select(
        *keys, (F.col("_first") + F.col("_offset") + 1).cast("long").alias("line_no"), "line", "article"
    )


def split_long_line(line: str, cap: int) -> Iterator[str]:
    """Pieces of at most ``cap`` characters, cut at the last space when there is one."""
    rest = line
    while rest:
        cut = len(rest)
        if cut > cap:
            space = rest.rfind(" ", 1, cap)
            cut = space if space > 0 else cap
        piece = rest[:cut].strip()
        if piece:
            yield piece
        rest = rest[cut:]


def _fill(group: list[str], cap: int) -> Iterator[str]:
    """Chunks of one heading's lines: lines are joined while their running size stays within the cap."""
    held: list[str] = []
    for line in group:
        used = sum(map(len, held)) + len(held)
        joins = len(line) <= cap and used + len(line) + bool(held) <= cap
        if held and not joins:
            yield "\n".join(held)
            held = []
        if len(line) > cap:
            yield from split_long_line(line, cap)
        else:
            held.append(line)
    if held:
        yield "\n".join(held)


def pack_page(text: str | None, cap: int, heading: re.Pattern) -> list[dict]:
    groups: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in filter(None, (raw.strip() for raw in (text or "").splitlines())):
        found = heading.match(line)
        if found:
            groups.append((found.group(1).upper(), []))
        groups[-1][1].append(line)
    contents = ((article, content) for article, group in groups for content in _fill(group, cap))
    return [
        {"chunk_index": i, "article": article, "content": content}
        for i, (article, content) in enumerate(contents, start=1)
    ]


def pack_pages(pages: DataFrame, cap: int, pattern: str) -> DataFrame:
    """Rows ``(…, chunk_index, article, content)`` per page of ``(…, text)``; a null text gives none.

    The fold depends on its own output, hence an Arrow function over the partition's batches.
    """
    heading = re.compile(pattern)
    carried = [c for c in pages.columns if c != "text"]

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            chunks = frame["text"].map(lambda page: pack_page(page, cap, heading))
            rows = frame[carried].assign(_chunk=chunks).explode("_chunk").dropna(subset=["_chunk"])
            parts = pd.DataFrame(list(rows["_chunk"]), columns=["chunk_index", "article", "content"], index=rows.index)
            yield pd.concat([rows[carried], parts], axis=1)

    schema = T.StructType(
        [pages.schema[c] for c in carried]
        + [
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("article", T.StringType()),
            T.StructField("content", T.StringType()),
        ]
    )
    return pages.mapInPandas(packed, schema)


def chunk_pages(
    pages: DataFrame,
    cap: int = vocab.CHUNK_CHARS,
    pattern: str = vocab.HEADING_PATTERN,
    **skip_rules,
) -> DataFrame:
    """Chunks of ``(document_title, page_number, text)``; no row leaves its partition."""
    from lectern.operators.cleaning import page_profile

    # Skipped pages pack to nothing. As a filter the test would move below a repartitioning of the pages.
    kept = F.when(~page_profile("text", **skip_rules)["skip"], F.col("text"))
    source = ["source_path"] if "source_path" in pages.columns else []
    packed = pack_pages(pages.select("document_title", "page_number", *source, kept.alias("text")), cap, pattern)
    return packed.withColumn("section_code", section_of_title("document_title")).select(
        chunk_id("document_title", "page_number", "chunk_index").alias("chunk_id"),
        "document_title",
        "section_code",
        "article",
        "page_number",
        F.col("page_number").alias("page_start"),
        F.col("page_number").alias("page_end"),
        F.array_compact(F.array("section_code", "article")).alias("heading_path"),
        "chunk_index",
        "content",
        *source,
    )


def ingest_summary(pages: DataFrame, chunks: DataFrame, embedded: bool = True) -> DataFrame:
    """Counts per document, and their total in the row whose title is null.

    Both inputs are reduced per document before they meet, so a document that holds a third of the
    corpus costs one partial sum per task.
    """
    per_pages = pages.groupBy("document_title").agg(F.count(F.lit(1)).alias("page_count"))
    per_chunks = chunks.groupBy("document_title").agg(F.count(F.lit(1)).alias("chunk_count"))
    counts = per_pages.join(per_chunks, "document_title", "left").select(
        "document_title",
        "page_count",
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
    )
    embedded_count = F.sum("chunk_count") if embedded else F.lit(0)
    return (
        counts.rollup("document_title")
        .agg(
            F.count(F.lit(1)).alias("document_count"),
            F.sum("page_count").alias("page_count"),
            F.sum("chunk_count").alias("chunk_count"),
            embedded_count.cast("long").alias("embedded_chunk_count"),
        )
        .withColumn("section_code", section_of_title("document_title"))
    )
