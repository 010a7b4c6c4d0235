"""Deterministic answer texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import dates
from lectern.functions import text as tx

# Answer texts.
NO_ARTICLE = "未识别条款"
NO_PRIMARY_ARTICLE = "未识别具体条款"
NO_PAGE = "页码未知"
PAGE = "第 %d 页"
NO_EVIDENCE = "未检索到与问题“%s”相关的 FIA 规则证据。为了避免编造规则，我不能基于当前资料给出确定答案。"
PRIMARY = "根据当前检索结果，最相关的依据来自《%s》的 %s（%s）。"
PARTIAL = (
    "我在当前 FIA 规则索引中找到了可能相关的章节，但证据还不够精确，不能直接下确定结论。"
    " 最接近的依据来自 %s，%s，%s。"
    " 建议把问题再具体到场景、处罚类型或涉及的赛段，我可以继续收窄到更明确的条款。"
)
FRAGMENT = "[片段 %d]\n文档: %s\n条款: %s\n页码: %s\n检索分数: %s\n内容:\n%s"
NO_SECTION = "当前索引中没有 %s，所以不能基于现有资料概括这一部分。"
SECTION_ANSWER = "%s 的定位：%s 索引中可见的代表性主题包括：%s。引用：%s，%s，%s。"
NO_DOCUMENT = "当前索引中没有可用于概括 2026 FIA F1 Regulations 的 section 数据。"
DOCUMENT_ANSWER = "2026 FIA F1 Regulations 当前索引大致分为 Section A-F：%s 引用：%s，%s。"
NO_SUMMARY = "当前索引中有该 Section，但缺少预置摘要。"
NO_TOPICS = "可从索引中的代表性条款继续追问具体规则。"
DRIVER_LINE = "%d. %s | %s | %d分"
TEAM_LINE = "%d. %s | %d分"
FULL_STANDINGS = {"driver": "当前完整车手积分榜：", "constructor": "当前完整车队积分榜："}
TOP_STANDINGS = {"driver": "当前车手积分榜前 %d 名：", "constructor": "当前车队积分榜前 %d 名："}
DRIVER_ENTRY = "当前车手积分榜第 %d 名是 %s，所属车队 %s，积分 %d。"
TEAM_ENTRY = "当前车队积分榜第 %d 名是 %s，积分 %d。"
DRIVER_SUBJECT = "%s 当前排在车手积分榜第 %d 名，所属车队 %s，积分 %d。"
TEAM_SUBJECT = "%s 当前排在车队积分榜第 %d 名，积分 %d。"
NO_ENTRY = "当前只获取到前 %d 名%s积分榜数据，无法确认第 %d 名。"
KINDS = {"driver": "车手", "constructor": "车队"}
FULL_SCHEDULE = "当前完整赛历："
NEAR_SCHEDULE = "近期赛历："
MORE_SCHEDULE = "共获取 %d 场比赛；如需全年列表，请问“完整赛历”。"
SCHEDULED = 3
RACE_LABELS = {"get_previous_race": "上一站比赛", "get_next_race": "下一站比赛"}
NO_RACE = {"get_previous_race": "No previous race found.", "get_next_race": "No upcoming race found."}
RECENT_NEWS = "已获取最近的 F1 新闻，重点包括：%s。"
NEWS_DONE = "已完成新闻查询。"
RACE_DONE = "已完成比赛信息查询。"
ARTICLE = "%s：%s"
NO_SUMMARY_YET = "暂无摘要。"
KEY_POINTS = "%s 关键点：%s。"
STRATEGY_ANSWER = "策略建议：%s 置信度：%s。 关键判断：%s"
UNSUPPORTED_INTENT = "Unsupported intent: %s"
UNKNOWN_ARTICLE = "Unknown article"
GREETING_TOKENS = ("你好", "hello", "hi", "hey")
GREETING = "你好，我可以回答 F1 的新闻、赛程、积分、规则和一般性问题。"
NO_MODEL = (
    "这个问题更适合走通用 F1 问答，但当前通用回答能力不可用。"
    "你可以换一种更具体的问法，例如问某位车手、某支车队、某场比赛，或者直接问最新积分、赛程、规则。"
)
TOPIC_SUMMARY = "这条新闻主要关联 %s，已生成规则检索问题并召回 %d 个相关规则片段。"
GENERIC_SUMMARY = "这条新闻未命中明确的预设规则主题，系统已根据标题《%s》生成通用规则检索问题，并召回 %d 个相关规则片段。"


def page_text(page: Column | str) -> Column:
    return F.when(tx.col(page) > 0, F.format_string(PAGE, tx.col(page))).otherwise(F.lit(NO_PAGE))


def fallback_answer(question: Column | str, title: Column | str, article: Column | str, page: Column | str) -> Column:
    """Answer that only names the best chunk; without one (null title), that there is no evidence."""
    found = F.format_string(
        PRIMARY, tx.col(title), F.coalesce(tx.blank_to_null(article), F.lit(NO_PRIMARY_ARTICLE)), page_text(page)
    )
    return F.when(tx.col(title).isNull(), F.format_string(NO_EVIDENCE, tx.col(question))).otherwise(found)


def partial_answer(title: Column | str, article: Column | str, page: Column | str) -> Column:
    shown = F.when(tx.col(page) > 0, F.format_string("p.%d", tx.col(page))).otherwise(F.lit("page unknown"))
    return F.format_string(PARTIAL, tx.col(title), F.coalesce(tx.blank_to_null(article), F.lit(NO_PRIMARY_ARTICLE)), shown)


def fragment(rank: Column, title: Column, article: Column, page: Column, score: Column, content: Column) -> Column:
    """One numbered piece of evidence."""
    # Rounds the double's exact value, half to even; a cast to decimal or a printf format goes by its shortest print.
    shown = F.when(score.isNull(), F.lit("N/A")).otherwise(F.call_function("format_number", score, F.lit("0.00")))
    return F.format_string(
        FRAGMENT, rank, title, F.coalesce(tx.blank_to_null(article), F.lit(NO_ARTICLE)), page_text(page), shown, content
    )


def evidence_context(retrieved: DataFrame) -> DataFrame:
    """Evidence text per question from its few reranked chunks."""
    piece = fragment(*[F.col(c) for c in ("rank", "document_title", "article", "page", "final", "content")])
    ordered = F.array_sort(F.collect_list(F.struct("rank", piece.alias("piece"))))
    return retrieved.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["piece"]), "\n\n").alias("context"),
        F.count(F.lit(1)).alias("evidence_count"),
    )


def section_answer(
    section: Column, topics: Column, title: Column, article: Column, page: Column,
    summaries: Mapping[str, str] = vocab.SECTION_SUMMARIES,
) -> Column:
    table = F.create_map(*[F.lit(x) for pair in summaries.items() for x in pair])
    summary = F.coalesce(F.try_element_at(table, section), F.lit(NO_SUMMARY))
    listed = F.when(F.size(topics) > 0, F.array_join(topics, "；")).otherwise(F.lit(NO_TOPICS))
    shown = F.when(page > 0, F.format_string("p.%d", page)).otherwise(F.lit("page unknown"))
    return F.format_string(
        SECTION_ANSWER, section, summary, listed, title,
        F.coalesce(tx.blank_to_null(article), F.lit("section metadata")), shown,
    )


def standing_lines(standings: Column, kind: str) -> Column:
    if kind == "driver":
        return F.transform(
            standings, lambda e: F.format_string(DRIVER_LINE, e["position"], e["driver_name"], e["team_name"], e["points"])
        )
    return F.transform(standings, lambda e: F.format_string(TEAM_LINE, e["position"], e["team_name"], e["points"]))


def standings_answer(
    standings: Column, kind: str, full: Column, top_n: Column, subject: Column, position: Column, picked: Column
) -> Column:
    """Full list, else first entries, else the entry the message names, else the entry at the position asked for."""
    entries = F.slice(standings, 1, F.coalesce(top_n, F.lit(1)))
    if kind == "driver":
        named = F.format_string(DRIVER_SUBJECT, subject["driver_name"], subject["position"], subject["team_name"], subject["points"])
        placed = F.format_string(DRIVER_ENTRY, picked["position"], picked["driver_name"], picked["team_name"], picked["points"])
    else:
        named = F.format_string(TEAM_SUBJECT, subject["team_name"], subject["position"], subject["points"])
        placed = F.format_string(TEAM_ENTRY, picked["position"], picked["team_name"], picked["points"])
    return (
        F.when(full, F.concat(F.lit(FULL_STANDINGS[kind] + "\n"), F.array_join(standing_lines(standings, kind), "\n")))
        .when(
            top_n.isNotNull(),
            F.concat(
                F.format_string(TOP_STANDINGS[kind] + "\n", F.size(entries)),
                F.array_join(standing_lines(entries, kind), "\n"),
            ),
        )
        .when(subject.isNotNull(), named)
        .when(picked.isNotNull(), placed)
        .otherwise(F.format_string(NO_ENTRY, F.size(standings), F.lit(KINDS[kind]), position))
    )


def event_line(event: Column, include_sessions: Column) -> Column:
    """One event of a schedule."""
    number = F.when(event["round_number"] > 0, F.format_string("R%d ", event["round_number"])).otherwise(F.lit(""))
    parts = F.array_compact(F.array(tx.blank_to_null(event["circuit_name"]), tx.blank_to_null(event["country"])))
    place = F.when(F.size(parts) > 0, F.concat(F.lit("（"), F.array_join(parts, "，"), F.lit("）"))).otherwise(F.lit(""))
    main = F.get(F.filter(event["sessions"], lambda s: s["name"] == vocab.MAIN_SESSION), 0)["start_time"]
    when = dates.display_time(F.coalesce(main, event["end_date"]))
    listed = F.transform(
        F.filter(event["sessions"], lambda s: s["start_time"].isNotNull()),
        lambda s: F.concat(s["name"], F.lit(" "), dates.display_time(s["start_time"])),
    )
    weekend = F.when(
        include_sessions & (F.size(listed) > 0), F.concat(F.lit("；周末安排："), F.array_join(listed, "；"))
    ).otherwise(F.lit(""))
    return F.concat(number, event["grand_prix_name"], place, F.lit("，正赛时间 "), when, weekend, F.lit("。"))


def schedule_answer(lines: Column, full: Column, shown: int = SCHEDULED, total: Column | None = None) -> Column:
    """Schedule of event lines; the first ones unless the full list is asked for.

    ``total`` is the number of events where ``lines`` holds only those that are shown.
    """
    some, count = F.slice(lines, 1, shown), F.size(lines) if total is None else total
    more = F.when(count > shown, F.format_string("\n" + MORE_SCHEDULE, count)).otherwise(F.lit(""))
    return F.when(full, F.concat(F.lit(FULL_SCHEDULE + "\n"), F.array_join(lines, "\n"))).otherwise(
        F.concat(F.lit(NEAR_SCHEDULE + "\n"), F.array_join(some, "\n"), more)
    )


def topic_summary(topic_titles: Column, title: Column | str, chunk_count: Column) -> Column:
    return F.when(
        F.size(topic_titles) > 0,
        F.format_string(TOPIC_SUMMARY, F.array_join(F.slice(topic_titles, 1, 3), "、"), chunk_count),
    ).otherwise(F.format_string(GENERIC_SUMMARY, tx.col(title), chunk_count))


def enrich(requests: DataFrame, attachments: Sequence[tuple[str, Column]]) -> DataFrame:
    """Attach one-row facts (scalar subqueries) to every request; a value the request brings stays."""
    for name, value in attachments:
        requests = requests.withColumn(name, F.coalesce(F.col(name), value) if name in requests.columns else value)
    return requests


# The answer to a strategy request that no model has answered.
STRATEGY = {
    "recommendation": "Combine live tyre degradation, pit-loss window, and track position before committing to the stop.",
    "confidence": "low",
    "analysis": [
        "The current context does not include enough tyre, traffic, or lap-time data to issue a high-confidence pit instruction.",
        "A conditional recommendation is safer than a deterministic call when live race variables are incomplete.",
    ],
    "assumptions": ["The supplied context reflects the current race state."],
    "cautions": ["A Safety Car, VSC, red flag, or sudden weather change can invalidate this view immediately."],
}
STRATEGY_FACT = "Received %d %s context items."
AUTHORITY_ANSWER = (
    "这个问题需要实时或权威资料支持，我不能只凭通用模型知识猜测。"
    "请改问更具体的查询，例如“最新车手积分榜”“下一站比赛”“最近 F1 新闻”或“某条 FIA 规则如何规定”。"
)


def strategy_answer(race_items: Column, rule_items: Column, news_items: Column) -> Column:
    """Struct of the deterministic strategy answer; its facts count the context items of each kind."""
    counts = (("race", race_items), ("regulation", rule_items), ("news", news_items))
    facts = F.array_compact(F.array(*[F.when(n > 0, F.format_string(STRATEGY_FACT, n, F.lit(kind))) for kind, n in counts]))
    return F.struct(
        F.lit(STRATEGY["recommendation"]).alias("recommendation"),
        F.lit(STRATEGY["confidence"]).alias("confidence"),
        facts.alias("facts"),
        *[tx.string_array(STRATEGY[part]).alias(part) for part in ("analysis", "assumptions", "cautions")],
    )


def race_answer(event: Column, action: str, include_sessions: Column) -> Column:
    """The race before or after the time of a message."""
    return F.concat(F.lit(RACE_LABELS[action] + "："), event_line(event, include_sessions))


def article_answer(title: Column | str, summary: Column | str, content: Column | str) -> Column:
    return F.format_string(ARTICLE, tx.col(title), F.coalesce(tx.first_of(summary, content), F.lit(NO_SUMMARY_YET)))


def insight_answer(summary: Column, points: Column) -> Column:
    listed = F.array_join(F.slice(points, 1, 3), "；")
    return F.when(F.size(points) > 0, F.format_string(KEY_POINTS, summary, listed)).otherwise(summary)


def recent_answer(titles: Column) -> Column:
    """Of the newest articles, the first three titles."""
    shown = F.array_join(F.slice(titles, 1, 3), "；")
    return F.when(F.size(titles) > 0, F.format_string(RECENT_NEWS, shown)).otherwise(F.lit(NEWS_DONE))


def general_answer(message: Column | str) -> Column:
    """What is said where no model answers: a greeting, or that the question needs one."""
    greeted = tx.contains_any(F.lower(tx.col(message)), GREETING_TOKENS)
    return F.when(greeted, F.lit(GREETING)).otherwise(F.lit(NO_MODEL))
