"""Messages to answers: a plan for each message, the tool that it names, one answer a message.

The plan is a column. Each tool takes the messages that name it, all in one go, and returns one row for each; the rows
of all tools are one table. A tool that finds nothing returns an error for that message and the others are answered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as tx
from lectern.operators import answers, race, routing
from lectern.plans import tools
from lectern.session import cut_lineage

#: What is known about an answer, beside its text.
TRACE = {"answer_status": "string", "confidence": "string", "evidence_count": "long", "source_mode": "string", "query_type": "string"}


def planned(
    messages: DataFrame,
    words: Mapping[str, Sequence[str]] = routing.INTENT_WORDS,
    race_actions=vocab.RACE_ACTIONS,
) -> DataFrame:
    """``messages(query_id, message, ...)`` with ``intent, tool_name, action, params`` and ``planned_by``.

    A message about one article is planned by its number. Else the words decide, a follow-up taking the intent in
    ``fallback`` if there is one. What they leave open takes the model's plan in ``planner_reply``, if there is a usable
    one.
    """
    have = messages.columns
    fallback = F.col("fallback") if "fallback" in have else None
    heuristic = messages.withColumn("_article", routing.article_plan("message")).withColumn(
        "_intent", routing.route("message", fallback, words)
    )
    kinds = "struct<intent: string, tool_name: string, action: string, params: map<string,string>>"
    by_article = F.struct(
        F.lit("news"), F.lit(vocab.TOOLS["news"]), F.col("_article.action"),
        F.create_map(F.lit("article_id"), F.col("_article.article_id").cast("string")),
    ).cast(kinds)
    by_words = routing.plan("_intent", "message", race_actions)
    whole = F.struct(F.col("_intent"), by_words["tool_name"], by_words["action"], by_words["params"]).cast(kinds)
    open_ = F.col("_article").isNull() & routing.wants_planner("message", "_intent", words)
    reply = routing.validate_plan("planner_reply", "message").cast(kinds) if "planner_reply" in have else F.lit(None).cast(kinds)
    chosen = heuristic.withColumn("_model", F.when(open_, reply)).withColumn(
        "_plan", F.when(F.col("_article").isNotNull(), by_article).otherwise(F.coalesce("_model", whole))
    )
    by = F.when(F.col("_model").isNotNull(), "model").when(F.col("_article").isNotNull(), "article").otherwise("words")
    return chosen.withColumn("planned_by", by).select(
        *have, "_plan.intent", "_plan.tool_name", "_plan.action", "_plan.params", "planned_by"
    )


def outcome(rows: DataFrame, answer: Column, error: Column | None = None, **trace: Column) -> DataFrame:
    """One answered or failed message a row."""
    failed = F.lit(None).cast("string") if error is None else error
    known = [trace.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in TRACE.items()]
    return rows.select("query_id", failed.alias("error"), F.when(failed.isNull(), answer).alias("answer"), *known)


def _list_recent(tables: tools.Tables, requests: DataFrame) -> DataFrame:
    titles = tools.list_recent(tables, requests).filter("rank <= 3").groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda t: t["title"]).alias("titles")
    )
    none = F.array().cast("array<string>")
    return outcome(requests.join(titles, "query_id", "left"), answers.recent_answer(F.coalesce("titles", none)))


def _get_article(tables: tools.Tables, requests: DataFrame) -> DataFrame:
    return outcome(tools.get_article(tables, requests), answers.article_answer("title", "summary", "content"), F.col("error"))


def _get_insights(tables: tools.Tables, requests: DataFrame) -> DataFrame:
    return outcome(
        tools.get_insights(tables, requests), answers.insight_answer(F.col("summary"), F.col("key_points")), F.col("error")
    )


def _get_rules_analysis(tables: tools.Tables, requests: DataFrame) -> DataFrame:
    return outcome(tools.get_rules_analysis(tables, requests), F.col("summary"), F.col("error"))


def _list_schedule(tables: tools.Tables, requests: DataFrame) -> DataFrame:
    rows = tools.list_schedule(tables, requests)
    return outcome(rows, F.when(F.col("events") > 0, F.col("answer")).otherwise(F.lit(answers.RACE_DONE)))


def _race(action: str) -> Callable[[tools.Tables, DataFrame], DataFrame]:
    def run(tables: tools.Tables, requests: DataFrame) -> DataFrame:
        found = tools.TOOLS["race_tool", action](tables, requests)
        parts = ["event_id", "round_number", "grand_prix_name", "circuit_name", "country", "end_date", "sessions"]
        event = found.select("query_id", F.struct(*parts).alias("e"))
        rows = requests.select("query_id", race.wants_session_times("message").alias("times")).join(event, "query_id")
        missing = F.when(F.col("e.event_id").isNull(), F.lit(answers.NO_RACE[action]))
        return outcome(rows, answers.race_answer(F.col("e"), action, F.col("times")), missing)

    return run


def _standings(action: str) -> Callable[[tools.Tables, DataFrame], DataFrame]:
    def run(tables: tools.Tables, requests: DataFrame) -> DataFrame:
        return outcome(tools.TOOLS["race_tool", action](tables, requests), F.coalesce("answer", F.lit(answers.RACE_DONE)))

    return run


def _ask(tables: tools.Tables, requests: DataFrame) -> DataFrame:
    return outcome(tools.ask(tables, requests), F.col("answer"), F.col("error"), **{name: F.col(name) for name in TRACE})


def _analyze(tables: tools.Tables, requests: DataFrame) -> DataFrame:
    rows = tools.analyze(tables, requests)
    text = F.format_string(answers.STRATEGY_ANSWER, "recommendation", "confidence", F.get("analysis", 0))
    return outcome(rows, text, confidence=F.col("confidence"))


def _answer(tables: tools.Tables, requests: DataFrame) -> DataFrame:
    """Refusals; a greeting and the notice that no model answers are what is left without one."""
    rows = tools.answer(tables, requests).withColumnRenamed("answer", "refused").join(requests, "query_id")
    blank = F.when(F.coalesce(F.trim("message"), F.lit("")) == "", F.lit(tools.NO_QUESTION))
    return outcome(
        rows, F.coalesce("refused", answers.general_answer("message")), blank,
        answer_status=F.lit("insufficient_evidence"), confidence=F.lit("low"), evidence_count=F.lit(0),
        source_mode=F.when(F.col("refused").isNotNull(), "general_guardrail").otherwise("general_fallback"),
    )


ANSWERED: dict[tuple[str, str], Callable[[tools.Tables, DataFrame], DataFrame]] = {
    ("news_tool", "list_recent"): _list_recent,
    ("news_tool", "get_article"): _get_article,
    ("news_tool", "get_insights"): _get_insights,
    ("news_tool", "get_rules_analysis"): _get_rules_analysis,
    ("race_tool", "list_schedule"): _list_schedule,
    ("race_tool", "get_next_race"): _race("get_next_race"),
    ("race_tool", "get_previous_race"): _race("get_previous_race"),
    ("race_tool", "get_driver_standings"): _standings("get_driver_standings"),
    ("race_tool", "get_constructor_standings"): _standings("get_constructor_standings"),
    ("regulation_tool", "ask"): _ask,
    ("strategy_tool", "analyze"): _analyze,
    ("general_tool", "answer"): _answer,
}


def answered(tables: tools.Tables, plans: DataFrame) -> DataFrame:
    """One row a planned message: success, error, answer and what is known about it.

    ``plans`` is written first, so that each tool reads its own messages and none is planned twice. The tools that no
    message names are left out.
    """
    plans = cut_lineage(plans, "plans")
    named = plans.select("tool_name", "action").distinct().collect()  # at most as many rows as there are tools, and one
    present = {(r["tool_name"], r["action"]) for r in named}
    results = None
    for pair in sorted(present & set(ANSWERED)):
        own = plans.filter((F.col("tool_name") == pair[0]) & (F.col("action") == pair[1]))
        rows = ANSWERED[pair](tables, own)
        results = rows if results is None else results.unionByName(rows)
    if present - set(ANSWERED) or results is None:
        known = F.concat_ws("/", "tool_name", "action").isin(*["/".join(p) for p in ANSWERED])
        lost = plans.filter(~F.coalesce(known, F.lit(False)))
        rows = outcome(lost, F.lit(None).cast("string"), F.format_string(answers.UNSUPPORTED_INTENT, F.coalesce("intent", F.lit(""))))
        results = rows if results is None else results.unionByName(rows)
    success = F.col("error").isNull()
    status = F.coalesce("answer_status", F.when(success, "answered").otherwise("error"))
    return plans.join(results, "query_id").select(
        "query_id", "intent", "tool_name", "action", "planned_by", success.alias("success"), "error",
        F.coalesce("answer", "error").alias("answer"), status.alias("answer_status"), "confidence",
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), "source_mode", "query_type",
    )
