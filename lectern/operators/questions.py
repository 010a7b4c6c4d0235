"""Turning questions into search terms: normalising, rewriting, phrases, keywords and sections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as tx


def normalize_question(question: Column | str, synonyms: Mapping[str, str] = vocab.QUESTION_SYNONYMS) -> Column:
    """Spell section names one way, then append the search words of each synonym found."""
    text = tx.col(question)
    for letter in vocab.SECTION_LETTERS:
        text = F.regexp_replace(text, f"(?i)(?<![a-z])section\\s*{letter}(?![a-z])", f"Section {letter}")
    if not synonyms:
        return text
    table = F.array(*[F.struct(F.lit(k).alias("source"), F.lit(v).alias("target")) for k, v in synonyms.items()])
    return F.aggregate(
        table,
        text,
        lambda acc, s: F.when(
            F.contains(acc, s["source"]) & ~F.contains(F.lower(acc), s["target"]),
            F.concat_ws(" ", acc, s["target"]),
        ).otherwise(acc),
    )


def needs_rewrite(question: Column | str) -> Column:
    return tx.col(question).rlike(tx.CJK)


def distinct_queries(queries: Column, limit: int | None = None) -> Column:
    """Stripped, non-blank, first spelling of each query regardless of case, in order."""
    cleaned = F.filter(F.transform(queries, tx.strip), lambda q: q != "")
    kept = tx.let(
        cleaned,
        lambda all_: tx.let(
            F.transform(all_, F.lower),
            lambda lowered: F.filter(all_, lambda q, i: F.array_position(lowered, F.lower(q)) == i + 1),
        ),
    )
    return kept if limit is None else F.slice(kept, 1, limit)


def rewrite_question(
    question: Column | str,
    suffix: str = vocab.REWRITE_SUFFIX,
    families: Sequence[tuple[Sequence[str], str]] = vocab.REWRITE_FAMILIES,
    defaults: Sequence[str] = vocab.REWRITE_DEFAULTS,
    gate: Column | None = None,
) -> Column:
    """Search queries for a question that holds CJK text; an empty array for any other."""
    text = tx.col(question)
    family_queries = F.array_compact(
        F.array(*[F.when(tx.contains_any(text, keys), F.lit(query)) for keys, query in families])
    )
    extra = F.when(F.size(family_queries) == 0, tx.string_array(defaults)).otherwise(family_queries)
    rewritten = distinct_queries(F.concat(F.array(F.concat_ws(" ", text, F.lit(suffix))), extra), vocab.MAX_REWRITES)
    return F.when(needs_rewrite(text) if gate is None else gate, rewritten).otherwise(tx.string_array([]))


def parse_rewrites(response: Column | str, limit: int = 3) -> Column:
    """Distinct strings of the ``queries`` array of a JSON reply; anything malformed gives an empty array."""
    items = F.from_json(F.get_json_object(tx.col(response), "$.queries"), "array<variant>")
    strings = F.filter(
        F.transform(
            items,
            lambda v: F.when(F.schema_of_variant(v) == "STRING", tx.strip(F.try_variant_get(v, "$", "string"))),
        ),
        lambda q: q.isNotNull() & (q != ""),
    )
    return F.coalesce(F.slice(F.array_distinct(strings), 1, limit), tx.string_array([]))


def extract_phrases(question: Column | str, rules=vocab.PHRASE_RULES) -> Column:
    lowered = F.lower(tx.col(question))
    return F.array_compact(F.array(*[F.when(tx.contains_any(lowered, keys), F.lit(phrase)) for keys, phrase in rules]))


def expand_keywords(question: Column | str, expansions: Mapping[str, Sequence[str]] = vocab.KEYWORD_EXPANSIONS) -> Column:
    """Question terms, each replaced by its expansion if it has one; first occurrence kept."""
    table = F.map_from_arrays(
        tx.string_array(expansions), F.array(*[tx.string_array(values) for values in expansions.values()])
    )
    return F.array_distinct(
        F.flatten(F.transform(tx.terms(question), lambda t: F.coalesce(F.try_element_at(table, t), F.array(t))))
    )


def preferred_sections(question: Column | str, section_words: Mapping[str, Sequence[str]] = vocab.SECTION_WORDS) -> Column:
    """Sections named in the question, then sections one of whose words occurs in it."""
    lowered = F.lower(tx.col(question))
    letters = F.regexp_extract_all(lowered, F.lit(r"(?<![a-z])section\s*([a-f])(?![a-z])"), F.lit(1))
    named = F.transform(letters, lambda x: F.concat(F.lit("Section "), F.upper(x)))
    implied = F.array_compact(
        F.array(*[F.when(tx.contains_any(lowered, keys), F.lit(section)) for section, keys in section_words.items()])
    )
    return F.array_distinct(F.concat(named, implied))


def parse_questions(
    questions: DataFrame,
    synonyms: Mapping[str, str] = vocab.QUESTION_SYNONYMS,
    phrase_rules=vocab.PHRASE_RULES,
    expansions: Mapping[str, Sequence[str]] = vocab.KEYWORD_EXPANSIONS,
    section_words: Mapping[str, Sequence[str]] = vocab.SECTION_WORDS,
    rewrites: Column | None = None,
) -> DataFrame:
    """``(query_id, question)`` with every part the retrieval stages use.

    ``rewrites`` is the strategy that adds queries to a question; by default the rule-based one.
    """
    rewritten = rewrite_question("question") if rewrites is None else rewrites
    return (
        questions.withColumn("normalized_question", normalize_question("question", synonyms))
        .withColumn("rewritten_queries", rewritten)
        .withColumn(
            "retrieval_queries", distinct_queries(F.concat(F.array("normalized_question"), F.col("rewritten_queries")))
        )
        .withColumn("scoring_text", F.array_join("retrieval_queries", " "))
        .withColumn("phrases", extract_phrases("scoring_text", phrase_rules))
        .withColumn("keywords", expand_keywords("scoring_text", expansions))
        .withColumn("sections", preferred_sections("scoring_text", section_words))
    )
