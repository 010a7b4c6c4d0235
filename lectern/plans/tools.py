"""Named queries a tool plan can ask for, each over whole tables of requests.

``requests`` is ``(query_id, message, params)`` with ``params`` a string map; the result is one row per
request or per request and found row. Composition stays lazy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import vocab
from lectern.operators import answers, articles, order, questions, race, retrieval, routing, rules
from lectern.session import cut_lineage


# Error texts.
NO_ARTICLE = "News article not found."
NO_QUESTION = "Question is required."
#: Articles that a request without a number of its own lists.
NEWS_LISTED = 10
#: Pieces of evidence, and headlines, that a strategy request gets.
CONTEXT_ITEMS = 3


@dataclass
class Tables:
    """What the tools read. ``now`` is the time at which requests without a time ``at`` ask the calendar, as text.

    Events and standings may have a ``season``; a request without one asks for the newest. ``retrieved`` finds the
    evidence of ``(query_id, question)``, in place of a keyword search over the chunks. ``attach`` lets strategy requests
    take what they bring no context for from the other tables.
    """

    articles: DataFrame | None = None
    chunks: DataFrame | None = None
    events: DataFrame | None = None
    drivers: DataFrame | None = None
    teams: DataFrame | None = None
    now: str | None = None
    retrieved: Callable[[DataFrame], DataFrame] | None = None
    attach: bool = False

    def evidence(self, asked: DataFrame) -> DataFrame:
        """Reranked chunks of the questions ``(query_id, question)``."""
        if self.retrieved:
            return self.retrieved(asked)
        parsed = cut_lineage(questions.parse_questions(asked), "questions")
        return retrieval.retrieve(parsed, self.chunks, None, None)["retrieved"]


def _requested_articles(tables: Tables, requests: DataFrame) -> DataFrame:
    """The article of every request; one that asks for no stored article has an ``error`` and nothing else."""
    wanted = requests.select("query_id", F.col("params")["article_id"].try_cast("long").alias("id"))
    found = wanted.join(articles.active(tables.articles).withColumn("_found", F.lit(True)), "id", "left")
    return found.withColumn("error", F.when(F.col("_found").isNull(), F.lit(NO_ARTICLE))).drop("_found")


def list_recent(tables: Tables, requests: DataFrame) -> DataFrame:
    """Newest articles, undated ones last; each request takes as many as it asks for, none below one.

    The articles are numbered once, up to the largest number that any request asks for.
    """
    limit = F.coalesce(F.col("params")["limit"].try_cast("int"), F.lit(NEWS_LISTED))
    asked = requests.select("query_id", F.greatest(limit, F.lit(0)).alias("_n"))
    most = asked.agg(F.max("_n")).first()[0] or 0
    newest = articles.recent(tables.articles, most).select(
        F.lit("").alias("_key"), "id", "title", "summary", "published_at"
    )
    numbered = order.ranked_in_order(newest, "_key", [F.desc_nulls_last("published_at"), F.desc("id")]).select(
        (F.col("rank") + 1).alias("rank"), "id", "title", "summary"
    )
    wanted = asked.filter("_n > 0").select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long"))).alias("rank"))
    return wanted.join(numbered, "rank").select("query_id", "rank", "id", "title", "summary")


def get_article(tables: Tables, requests: DataFrame) -> DataFrame:
    return _requested_articles(tables, requests)


def get_insights(tables: Tables, requests: DataFrame) -> DataFrame:
    rows = _requested_articles(tables, requests).withColumn("_text", articles.corpus_text())
    judged = rows.filter("error is null").withColumn("category", articles.category("_text"))
    missing = rows.filter("error is not null").select("query_id", "id", "error")
    insight = judged.select(
        "query_id", "id", "category", articles.entities("_text").alias("entities"), articles.key_points().alias("key_points"),
        articles.relevance("_text", "category.key").alias("relevance"),
        articles.summary_or_point(articles.key_points()).alias("summary"),
    )
    return insight.unionByName(missing, allowMissingColumns=True)


def get_rules_analysis(tables: Tables, requests: DataFrame) -> DataFrame:
    """Topics, questions, the chunks behind the first questions and a summary of them, for every article."""
    rows = _requested_articles(tables, requests)
    found = rows.filter("error is null").withColumn("topics", articles.topics(articles.corpus_text()))
    asked = cut_lineage(
        found.select("query_id", "id", "title", "topics", articles.suggested_questions(F.col("topics")).alias("questions")),
        "article-questions",
    )
    distinct = asked.select(F.explode("questions").alias("question")).distinct()
    parsed = cut_lineage(
        questions.parse_questions(distinct.select(F.col("question").alias("query_id"), "question")), "questions"
    )
    retrieved = retrieval.retrieve(parsed, tables.chunks, None, None)["retrieved"]
    linked = articles.linked_chunks(
        asked.select(F.col("query_id").alias("article_id"), "questions"),
        retrieved.select(F.col("query_id").alias("question"), "chunk_id", "rank"),
    )
    listed = linked.groupBy(F.col("article_id").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))), lambda c: c["chunk_id"]).alias("chunks")
    )
    whole = asked.join(listed, "query_id", "left").withColumn(
        "chunks", F.coalesce("chunks", F.array().cast(f"array<{dict(tables.chunks.dtypes)['chunk_id']}>"))
    )
    titles = F.transform("topics", lambda t: t["title"])
    analysis = whole.withColumn("summary", answers.topic_summary(titles, "title", F.size("chunks")))
    missing = rows.filter("error is not null").select("query_id", "id", "error")
    return analysis.unionByName(missing, allowMissingColumns=True)


def _season(table: DataFrame) -> Column:
    return F.col("season").cast("string") if "season" in table.columns else F.lit("")


def _of_season(table: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests with the season that they ask for, or the newest one of the table."""
    newest = table.select(F.max("season").cast("string")).scalar() if "season" in table.columns else F.lit("")
    return requests.withColumn("_season", F.coalesce(F.col("params")["season"], newest))


def list_schedule(tables: Tables, requests: DataFrame) -> DataFrame:
    """Schedule answers and the number of events; a request meets the events that its answer shows."""
    in_season = Window.partitionBy("_season")
    numbered = tables.events.withColumn("_season", _season(tables.events)).select(
        "_season",
        F.row_number().over(in_season.orderBy("start_date", "event_id")).alias("_n"),
        F.count(F.lit(1)).over(in_season).alias("_events"),
        F.struct("round_number", "grand_prix_name", "circuit_name", "country", "end_date", "sessions").alias("_e"),
    )
    asked = _of_season(tables.events, requests).select(
        "query_id", "_season", race.wants_full_schedule("message").alias("_full"), race.wants_session_times("message").alias("_times")
    )
    shown = asked.withColumn("_most", F.when(F.col("_full"), F.lit(None)).otherwise(F.lit(answers.SCHEDULED)))
    met = shown.join(numbered, "_season", "left").filter("_n is null or _most is null or _n <= _most")
    line = F.when(F.col("_n").isNotNull(), F.struct("_n", answers.event_line(F.col("_e"), F.col("_times")).alias("line")))
    gathered = met.groupBy("query_id", "_full").agg(
        F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("_lines"),
        F.coalesce(F.first("_events"), F.lit(0)).alias("events"),
    )
    return gathered.select(
        "query_id", "events", answers.schedule_answer(F.col("_lines"), F.col("_full"), total=F.col("events")).alias("answer")
    )


def _times(tables: Tables, requests: DataFrame) -> DataFrame:
    at = F.to_timestamp(F.lit(tables.now))
    return requests.withColumn("at", F.coalesce(F.col("at").cast("timestamp"), at) if "at" in requests.columns else at)


def neighbours(tables: Tables, requests: DataFrame) -> DataFrame:
    """``query_id, previous_id, next_id`` of each request's season at its own time."""
    events = tables.events.withColumn("_season", _season(tables.events))
    probes = _times(tables, _of_season(tables.events, requests)).select("query_id", "_season", "at")
    return requests.select("query_id").join(order.around(probes, events, ["_season"]), "query_id", "left")


def _event(side: str) -> Callable[[Tables, DataFrame], DataFrame]:
    def run(tables: Tables, requests: DataFrame) -> DataFrame:
        found = neighbours(tables, requests).select("query_id", F.col(side).alias("event_id"))
        return found.join(tables.events, "event_id", "left")

    return run


def _standings(kind: str) -> Callable[[Tables, DataFrame], DataFrame]:
    def run(tables: Tables, requests: DataFrame) -> DataFrame:
        driver = kind == "driver"
        table = tables.drivers if driver else tables.teams
        name, aliases = ("driver_name", vocab.STANDING_DRIVER_ALIASES) if driver else ("team_name", vocab.STANDING_TEAM_ALIASES)
        fields = ["position", *(["driver_name"] if driver else []), "team_name", "points"]
        # A season's entrants are few; their table is one row, which its requests meet by the season.
        seasons = table.groupBy(_season(table).alias("_season")).agg(
            F.array_sort(F.collect_list(F.struct(*fields))).alias("standings")
        )
        rows = _of_season(table, requests).join(seasons, "_season", "left").select(
            "query_id", "standings", race.wants_full_standings("message").alias("full"), race.requested_top("message").alias("top_n"),
            race.match_entry("message", F.col("standings"), name, aliases).alias("subject"),
            race.requested_position("message").alias("position"),
        ).withColumn("picked", race.pick_position(F.col("standings"), F.col("position")))
        parts = [F.col(c) for c in ("full", "top_n", "subject", "position", "picked")]
        answer = F.when(F.col("standings").isNotNull(), answers.standings_answer(F.col("standings"), kind, *parts))
        return rows.select("query_id", answer.alias("answer"))

    return run


def ask(tables: Tables, requests: DataFrame) -> DataFrame:
    """One answer a question, with status, confidence and citations; a blank question is an error."""
    chunks = tables.chunks if "page" in tables.chunks.columns else tables.chunks.withColumn("page", F.lit(None).cast("long"))
    asked = _questions(requests)
    judged = rules.judge(asked, routing.query_type("question"), routing.is_unrelated("question"))
    retrieved = replace(tables, chunks=chunks).evidence(asked)
    blank = requests.filter(_is_blank()).select("query_id", F.lit(NO_QUESTION).alias("error"))
    return rules.ask(judged, retrieved, chunks).unionByName(blank, allowMissingColumns=True)


def debug_retrieval(tables: Tables, requests: DataFrame) -> DataFrame:
    """What every stage of the retrieval holds: ``query_id, stage, rank, chunk_id``."""
    parsed = cut_lineage(questions.parse_questions(_questions(requests)), "questions")
    stages = retrieval.retrieve(parsed, tables.chunks, None, None)
    ranks = {"vector": "vector_rank", "keyword": "keyword_rank", "fused": "hybrid_rank", "hybrid": "hybrid_rank", "retrieved": "rank"}
    parts = [
        stages[name].select("query_id", F.lit(name).alias("stage"), F.col(rank).cast("long").alias("rank"), "chunk_id")
        for name, rank in ranks.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _is_blank() -> Column:
    return F.coalesce(F.trim("message"), F.lit("")) == ""


def _questions(requests: DataFrame) -> DataFrame:
    return requests.filter(~_is_blank()).select("query_id", F.col("message").alias("question"))


def strategy_context(tables: Tables, requests: DataFrame) -> DataFrame:
    """What the tables know for each request: the races around its time, three pieces of evidence, three headlines."""
    names = tables.events.select("event_id", "grand_prix_name")
    races = neighbours(tables, requests)
    for side, name in (("previous_id", "previous_race"), ("next_id", "next_race")):
        races = races.join(names.toDF(side, name), side, "left")
    item = F.concat_ws(" | ", "document_title", F.coalesce(F.nullif("article", F.lit("")), F.lit(answers.UNKNOWN_ARTICLE)), "content")
    rule = (
        tables.evidence(_questions(requests)).filter(F.col("rank") <= CONTEXT_ITEMS)
        .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("_r"))
        .select("query_id", F.transform("_r", lambda r: r["item"]).alias("regulation_context"))
    )
    headline = F.concat_ws(": ", "title", F.nullif("summary", F.lit("")))
    # Three rows whatever the table.
    newest = articles.recent(tables.articles, CONTEXT_ITEMS).select(
        F.struct(F.col("published_at").isNull().alias("undated"), (-F.unix_micros("published_at")).alias("age"), (-F.col("id")).alias("id"), headline.alias("line")).alias("a")
    )
    news = newest.select(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["line"])).scalar()
    return races.select("query_id", "previous_race", "next_race").join(rule, "query_id", "left").withColumn("news_context", news)


def analyze(tables: Tables, requests: DataFrame) -> DataFrame:
    """Strategy answers without a model.

    The context that a request brings is counted in its parameters. With ``attach``, the races are added to what it
    brings, and rules and news where it brings none.
    """
    counts = {k: F.coalesce(F.col("params")[k].try_cast("int"), F.lit(0)) for k in ("race_items", "rule_items", "news_items")}
    brought = requests.select("query_id", *[v.alias(k) for k, v in counts.items()])
    if not tables.attach:
        return brought.select("query_id", answers.strategy_answer(*[F.col(k) for k in counts]).alias("s")).select("query_id", "s.*")
    whole = brought.join(strategy_context(tables, requests), "query_id")
    rules_there, news_there = F.coalesce(F.size("regulation_context"), F.lit(0)), F.coalesce(F.size("news_context"), F.lit(0))
    races = F.col("race_items") + F.col("previous_race").isNotNull().cast("int") + F.col("next_race").isNotNull().cast("int")
    strategy = answers.strategy_answer(
        races,
        F.when(F.col("rule_items") > 0, F.col("rule_items")).otherwise(rules_there),
        F.when(F.col("news_items") > 0, F.col("news_items")).otherwise(news_there),
    )
    context = ["previous_race", "next_race", "regulation_context", "news_context"]
    return whole.select("query_id", strategy.alias("s"), *context).select("query_id", "s.*", *context)


def answer(tables: Tables, requests: DataFrame) -> DataFrame:
    """General questions that need authoritative data are refused; others are left to a model (null)."""
    return requests.select(
        "query_id", F.when(routing.needs_authority("message"), F.lit(answers.AUTHORITY_ANSWER)).alias("answer")
    )


TOOLS: dict[tuple[str, str], Callable[[Tables, DataFrame], DataFrame]] = {
    ("news_tool", "list_recent"): list_recent,
    ("news_tool", "get_article"): get_article,
    ("news_tool", "get_insights"): get_insights,
    ("news_tool", "get_rules_analysis"): get_rules_analysis,
    ("race_tool", "list_schedule"): list_schedule,
    ("race_tool", "get_next_race"): _event("next_id"),
    ("race_tool", "get_previous_race"): _event("previous_id"),
    ("race_tool", "get_driver_standings"): _standings("driver"),
    ("race_tool", "get_constructor_standings"): _standings("constructor"),
    ("regulation_tool", "ask"): ask,
    ("regulation_tool", "debug_retrieval"): debug_retrieval,
    ("strategy_tool", "analyze"): analyze,
    ("general_tool", "answer"): answer,
}


def execute(tables: Tables, tool: str, action: str, requests: DataFrame) -> DataFrame:
    """The named query over the requests; an unknown name is an error of the caller."""
    if (tool, action) not in TOOLS:
        raise ValueError(f"unsupported tool or action: {tool}, {action}")
    return TOOLS[tool, action](tables, requests)
