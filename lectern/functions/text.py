"""Column helpers for text: all stay in the JVM and work on one row at a time."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace and line-break characters of the Unicode string model being matched.
WHITESPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
CJK = r"[\u4e00-\u9fff]"
# Fixed value: characters stripped from both ends of a question or memory term.
TERM_PUNCTUATION = ".,?!:;()[]"
MIN_TERM_CHARS = 3


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column | str, body) -> Column:
    """``body`` of a value computed once. A lambda would otherwise compute it again for every element."""
    return F.get(F.transform(F.array(col(value)), body), 0)


def strip(value: Column | str) -> Column:
    return F.regexp_replace(col(value), f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def collapse(value: Column | str) -> Column:
    """One space between words, none at the ends."""
    return F.trim(F.regexp_replace(col(value), f"{WHITESPACE}+", " "))


def collapse_or_null(value: Column | str) -> Column:
    return F.nullif(collapse(value), F.lit(""))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(col(value), F.lit(""))


def words(value: Column | str) -> Column:
    """Whitespace-separated words, without blanks."""
    return F.filter(F.split(col(value), f"{WHITESPACE}+"), lambda w: w != "")


def tokens(value: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(col(value)), F.lit("[a-z0-9]+"), F.lit(0))


def lines(value: Column | str) -> Column:
    """Stripped non-blank lines."""
    stripped = F.transform(F.split(col(value), LINE_BREAK), strip)
    return F.filter(stripped, lambda line: line != "")


def terms(value: Column | str) -> Column:
    """Lower-cased words stripped of punctuation, at least three characters, duplicates kept."""
    escaped = "".join("\\" + c for c in TERM_PUNCTUATION)
    stripped = F.transform(
        words(F.lower(col(value))),
        lambda w: F.regexp_replace(w, f"^[{escaped}]+|[{escaped}]+$", ""),
    )
    return F.filter(stripped, lambda w: F.length(w) >= MIN_TERM_CHARS)


def memory_terms(value: Column | str) -> Column:
    """Set of terms plus single CJK characters."""
    return F.array_union(terms(value), F.regexp_extract_all(col(value), F.lit(CJK), F.lit(0)))


def string_array(values: Iterable[str]) -> Column:
    items = [F.lit(v) for v in values]
    return F.array(*items) if items else F.array().cast("array<string>")


def contains_any(value: Column | str, keys: Sequence[str]) -> Column:
    """True when any key is a substring."""
    return let(value, lambda text: F.exists(string_array(keys), lambda k: F.contains(text, k)))


def hits(value: Column | str, keys: Sequence[str]) -> Column:
    """The keys that are substrings, in key order."""
    return let(value, lambda text: F.filter(string_array(keys), lambda k: F.contains(text, k)))


def slug(value: Column | str) -> Column:
    dashed = F.regexp_replace(F.lower(col(value)), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def token_estimate(value: Column | str) -> Column:
    """A quarter token per ASCII character, one per other character, at least one unless empty."""
    text = F.coalesce(col(value), F.lit(""))
    ascii_chars = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    other = F.length(text) - ascii_chars
    estimate = F.greatest(F.lit(1), F.floor(ascii_chars / F.lit(4)).cast("int") + other)
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(estimate).cast("long")


def fixed_width_slices(value: Column | str, width: int) -> Column:
    """Slices of ``width`` characters; an empty text gives one empty slice."""
    return let(
        value,
        lambda text: F.transform(
            F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(width)),
            lambda start: F.substring(text, start + 1, F.lit(width)),
        ),
    )


def tail(value: Column | str, chars: int, blank: str = WHITESPACE) -> Column:
    """Last ``chars`` characters without leading whitespace, or what ``blank`` says; shorter text is returned unchanged."""
    text = col(value)
    cut = F.regexp_replace(F.right(text, F.lit(chars)), f"^{blank}+", "")
    return F.when(F.length(text) > chars, cut).otherwise(text)


def sentences(value: Column | str) -> Column:
    """Split after a sentence mark that whitespace follows; collapsed, blanks dropped."""
    parts = F.split(col(value), f"(?<=[.!?。！？]){WHITESPACE}+")
    return F.filter(F.transform(parts, collapse), lambda s: s != "")


def last_url_segment(url: Column | str) -> Column:
    trimmed = F.regexp_replace(col(url), "/+$", "")
    return blank_to_null(F.element_at(F.split(trimmed, "/"), -1))


def first_of(*values: Column | str) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(v) for v in values])
