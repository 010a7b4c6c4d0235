"""Document cleaning: line filters and page skipping, one row in and one row out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as tx


def is_boilerplate(
    line: Column,
    exact_upper: Sequence[str] = vocab.BOILERPLATE_EXACT_UPPER,
    prefixes: Sequence[str] = vocab.BOILERPLATE_PREFIXES,
    pattern: str = vocab.BOILERPLATE_PATTERN,
) -> Column:
    """Running headers, footers and page numbers, tested on a collapsed line."""
    return (
        F.upper(line).isin(*exact_upper)
        | F.exists(tx.string_array(prefixes), lambda p: F.startswith(line, p))
        | line.rlike(pattern)
    )


def clean_lines(value: Column | str, **rules) -> Column:
    """Array of collapsed lines without blanks and boilerplate."""
    unified = F.translate(tx.col(value), "\r\u00a0", "\n ")
    collapsed = F.transform(F.split(unified, tx.LINE_BREAK), tx.collapse)
    return F.filter(collapsed, lambda line: (line != "") & ~is_boilerplate(line, **rules))


def clean_text(value: Column | str, **rules) -> Column:
    return F.array_join(clean_lines(value, **rules), "\n")


def is_index_line(
    line: Column,
    prefixes: Sequence[str] = vocab.INDEX_LINE_PREFIXES,
    token_prefix: str = vocab.INDEX_TOKEN_PREFIX,
) -> Column:
    """Lines of a table of contents: they end in a digit and open with a numbered label."""
    ends_in_digit = F.right(line, F.lit(1)).rlike(r"\p{Nd}")
    first_token = F.element_at(F.split(line, f"{tx.WHITESPACE}+"), 1)
    labelled = F.exists(tx.string_array(prefixes), lambda p: F.startswith(line, p))
    numbered = F.startswith(first_token, F.lit(token_prefix)) & first_token.rlike(r"\p{Nd}")
    return ends_in_digit & (labelled | numbered)


def page_profile(
    value: Column | str,
    markers_upper: Sequence[str] = vocab.SKIP_PAGE_MARKERS_UPPER,
    index_prefixes: Sequence[str] = vocab.INDEX_LINE_PREFIXES,
    index_token_prefix: str = vocab.INDEX_TOKEN_PREFIX,
    min_index_lines: int = vocab.MIN_INDEX_LINES,
    max_sentence_lines: int = vocab.MAX_SENTENCE_LINES,
    sentence_chars: int = vocab.SENTENCE_LINE_CHARS,
) -> Column:
    """Struct of line counts and whether the page holds no running text worth indexing."""
    page = tx.col(value)

    def counts(page_lines: Column) -> Column:
        index = F.filter(page_lines, lambda x: is_index_line(x, index_prefixes, index_token_prefix))
        running = F.filter(page_lines, lambda x: F.endswith(x, F.lit(".")) & (F.length(x) > sentence_chars))
        return F.struct(
            F.size(page_lines).cast("long").alias("line_count"),
            F.size(index).cast("long").alias("index_lines"),
            F.size(running).cast("long").alias("sentence_lines"),
        )

    def profile(c: Column) -> Column:
        skip = (
            (c["line_count"] == 0)
            | ((c["index_lines"] >= min_index_lines) & (c["sentence_lines"] <= max_sentence_lines))
            | tx.contains_any(F.upper(page), markers_upper)
        )
        return F.struct(
            c["line_count"].alias("line_count"),
            c["index_lines"].alias("index_lines"),
            c["sentence_lines"].alias("sentence_lines"),
            F.coalesce(skip, F.lit(True)).alias("skip"),
        )

    return tx.let(tx.let(tx.lines(page), counts), profile)
