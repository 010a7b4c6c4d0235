"""Rule-based routing of messages: intent, tool plan and guards. All are expressions over one column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as tx

INTENT_WORDS = {
    "explicit": vocab.EXPLICIT_RULE_WORDS,
    "strategy": vocab.STRATEGY_WORDS,
    "rule": vocab.RULE_WORDS,
    "race": vocab.RACE_WORDS,
    "news": vocab.NEWS_WORDS,
    "follow_up": vocab.FOLLOW_UP_WORDS,
}
# Order of the word lists and the intent each one means.
PRECEDENCE = [("explicit", "regulation"), ("strategy", "strategy"), ("rule", "regulation"), ("race", "race"), ("news", "news")]


def is_follow_up(message: Column | str, words: Mapping[str, Sequence[str]] = INTENT_WORDS) -> Column:
    """The message only makes sense with the turns before it."""
    text = F.lower(tx.strip(message))
    domain = [w for name, _ in PRECEDENCE for w in words[name]]
    return (
        F.when(text.isin(*vocab.BARE_QUESTIONS), True)
        .when(tx.contains_any(text, domain), False)
        .otherwise(
            text.isin(*vocab.SHORT_FOLLOW_UPS)
            | ((F.length(text) <= vocab.SHORT_FOLLOW_UP_CHARS) & tx.contains_any(text, vocab.SHORT_FOLLOW_UP_TOKENS))
            | text.rlike(vocab.RANK_REFERENCE_PATTERN)
            | tx.contains_any(text, vocab.CORRECTION_WORDS)
            | tx.contains_any(text, words["follow_up"])
        )
    )


def route(
    message: Column | str, fallback: Column | None = None, words: Mapping[str, Sequence[str]] = INTENT_WORDS
) -> Column:
    """Intent of the first word list found; a follow-up takes the fallback intent; else general."""
    text = F.lower(tx.strip(message))
    chain = F
    for name, intent in PRECEDENCE:
        chain = chain.when(tx.contains_any(text, words[name]), F.lit(intent))
    if fallback is not None:
        chain = chain.when(tx.blank_to_null(fallback).isNotNull() & is_follow_up(text, words), fallback)
    return chain.otherwise(F.lit("general"))


def first_rule(text: Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    chain = F
    for keys, value in rules:
        chain = chain.when(tx.contains_any(text, keys), F.lit(value))
    return chain.otherwise(F.lit(default))


def plan(intent: Column | str, message: Column | str, race_actions=vocab.RACE_ACTIONS) -> Column:
    """Struct of tool, action and parameters for an intent; an unknown intent is unsupported."""
    kind, text = tx.col(intent), tx.col(message)
    tool, action = F, F
    for name, tool_name in vocab.TOOLS.items():
        tool = tool.when(kind == name, F.lit(tool_name))
    for name, action_name in vocab.DEFAULT_ACTIONS.items():
        action = action.when(kind == name, F.lit(action_name))
    action = action.when(kind == "race", first_rule(F.lower(text), race_actions, vocab.DEFAULT_RACE_ACTION))
    empty = F.create_map().cast("map<string,string>")
    params = (
        F.when(kind == "news", F.create_map(F.lit("limit"), F.lit(str(vocab.NEWS_LIMIT))))
        .when(kind.isin("regulation", "strategy", "general"), F.create_map(F.lit("question"), text))
        .otherwise(empty)
    )
    return F.struct(
        tool.otherwise(F.lit("dispatcher")).alias("tool_name"),
        action.otherwise(F.lit("unsupported")).alias("action"),
        params.alias("params"),
    )


def article_plan(
    message: Column | str,
    gate: Sequence[str] = vocab.ARTICLE_ID_GATE,
    pattern: str = vocab.ARTICLE_ID_PATTERN,
    actions=vocab.ARTICLE_ACTIONS,
) -> Column:
    """Struct of article id and action for a message about one article, else null."""
    text = F.lower(tx.col(message))
    number = F.regexp_extract(text, pattern, 1).try_cast("long")
    return F.when(
        tx.contains_any(text, gate) & number.isNotNull(),
        F.struct(number.alias("article_id"), first_rule(text, actions, "get_article").alias("action")),
    )


def is_casual(message: Column | str) -> Column:
    text = F.lower(tx.strip(message))
    return text.isin(*vocab.CASUAL_MESSAGES) | tx.contains_any(text, vocab.CASUAL_TOKENS)


def wants_planner(message: Column | str, intent: Column | str, words: Mapping[str, Sequence[str]] = INTENT_WORDS) -> Column:
    """The rules leave the message open: general, not small talk, not a follow-up."""
    return (tx.col(intent) == "general") & ~is_casual(message) & ~is_follow_up(message, words)


def recover_json(reply: Column | str) -> Column:
    """The reply as a JSON object text; text around the outermost braces is dropped, anything else is null."""
    text = tx.col(reply)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)

    def as_object(value: Column) -> Column:
        parsed = F.try_parse_json(value)
        return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.to_json(parsed))

    # Text that is JSON but no object is not searched for an object.
    return F.when(F.try_parse_json(text).isNotNull(), as_object(text)).otherwise(as_object(inner))


def validate_plan(reply: Column | str, message: Column | str) -> Column:
    """A model's plan if its intent and action are known and its parameters usable, else null."""
    data = recover_json(reply)
    intent = F.get_json_object(data, "$.intent")
    action = F.get_json_object(data, "$.action")
    known = F.lit(False)
    for name, actions in vocab.SUPPORTED_ACTIONS.items():
        known = known | ((intent == name) & action.isin(*actions))
    article_id = F.get_json_object(data, "$.params.article_id").try_cast("long")
    needs_id = (intent == "news") & (action != "list_recent")
    limit = F.coalesce(F.get_json_object(data, "$.params.limit"), F.lit(str(vocab.NEWS_LIMIT)))
    empty = F.create_map().cast("map<string,string>")
    params = (
        F.when(needs_id, F.create_map(F.lit("article_id"), article_id.cast("string")))
        .when(intent == "news", F.create_map(F.lit("limit"), limit))
        .when(intent.isin("regulation", "strategy", "general"), F.create_map(F.lit("question"), tx.col(message)))
        .otherwise(empty)
    )
    tool = F.try_element_at(F.create_map(*[F.lit(x) for pair in vocab.TOOLS.items() for x in pair]), intent)
    return F.when(
        known & (~needs_id | article_id.isNotNull()),
        F.struct(intent.alias("intent"), tool.alias("tool_name"), action.alias("action"), params.alias("params")),
    )


def is_unrelated(question: Column | str, tokens: Sequence[str] = vocab.UNRELATED_TOKENS) -> Column:
    return tx.contains_any(F.lower(tx.col(question)), tokens)


def needs_authority(question: Column | str, tokens: Sequence[str] = vocab.AUTHORITATIVE_TOKENS) -> Column:
    return tx.contains_any(F.lower(tx.col(question)), tokens)


def question_section(question: Column | str) -> Column:
    letter = tx.first_of(
        F.regexp_extract(tx.col(question), vocab.SECTION_PATTERN, 1),
        F.regexp_extract(tx.col(question), vocab.CJK_SECTION_PATTERN, 1),
    )
    return F.concat(F.lit("Section "), F.upper(letter))


def query_type(
    question: Column | str,
    overview: Sequence[str] = vocab.OVERVIEW_TOKENS,
    technical: Sequence[str] = vocab.TECHNICAL_RULE_TOKENS,
    technical_overview: Sequence[str] = vocab.TECHNICAL_OVERVIEW_TOKENS,
    document: Sequence[str] = vocab.DOCUMENT_TOKENS,
    subjects: Sequence[str] = vocab.DOCUMENT_SUBJECTS,
) -> Column:
    """Struct of query type and section: a section's overview, the document's, or a fact."""
    text, lowered = tx.col(question), F.lower(tx.col(question))
    section = question_section(text)

    def typed(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("query_type"), value.cast("string").alias("section"))

    return (
        F.when(section.isNotNull() & tx.contains_any(lowered, overview), typed("section_overview", section))
        .when(
            tx.contains_any(text, technical) & tx.contains_any(text, technical_overview),
            typed("section_overview", F.lit(vocab.TECHNICAL_SECTION)),
        )
        .when(
            tx.contains_any(text, document)
            | (F.contains(lowered, F.lit("overview")) & tx.contains_any(lowered, subjects)),
            typed("document_overview", F.lit(None)),
        )
        .otherwise(typed("fact_lookup", F.lit(None)))
    )


def answer_status(kind: Column | str, evidence_count: Column | str, strong: Column | str) -> Column:
    """Struct of status, confidence and source mode of an answer."""
    type_, found, sure = tx.col(kind), tx.col(evidence_count), tx.col(strong)
    answered = (type_ != "fact_lookup") | sure
    status = (
        F.when(found == 0, F.lit("insufficient_evidence")).when(answered, F.lit("answered")).otherwise(F.lit("partial_evidence"))
    )
    return F.struct(
        status.alias("answer_status"),
        F.when((found > 0) & answered, F.lit("medium")).otherwise(F.lit("low")).alias("confidence"),
        F.when(type_ != "fact_lookup", F.lit("regulation_overview")).otherwise(F.lit("regulation_rag")).alias("source_mode"),
    )
