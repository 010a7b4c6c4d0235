import pytest
from pyspark.sql import functions as F
from test_operators import ARTICLE, CHUNK_SCHEMA, CHUNKS

from lectern.plans import tools
from lectern.sources import seed


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        (1, "s", "a", "Red flag at Monza", None, "The stewards stopped it. Verstappen waited.", "u1", None, None, ["x"], None, None, False),
        (2, "s", "b", "New livery", "A launch", None, "u2", None, None, [], None, None, False),
    ]
    return tools.Tables(
        articles=spark.createDataFrame(rows, ARTICLE),
        chunks=spark.createDataFrame(CHUNKS, CHUNK_SCHEMA),
        events=seed.seed_calendar(spark, 2026).withColumn("event_id", F.col("round_number")),
        drivers=seed.seed_drivers(spark, 2026),
        teams=seed.seed_teams(spark, 2026),
        now="2026-07-06T00:00:00Z",
    )


def ask(spark, tables, tool, action, message, **params):
    requests = spark.createDataFrame([(1, message, params)], "query_id long, message string, params map<string,string>")
    return tools.execute(tables, tool, action, requests).collect()


def test_news(spark, tables):
    assert [r.id for r in ask(spark, tables, "news_tool", "list_recent", "", limit="1")] == [2]
    assert ask(spark, tables, "news_tool", "get_article", "", article_id="2")[0].title == "New livery"
    insight = ask(spark, tables, "news_tool", "get_insights", "", article_id="1")[0]
    assert insight.category.key == "race_control" and insight.relevance.relevance == "direct"
    assert [(e.entity_type, e.name) for e in insight.entities] == [("driver", "Max Verstappen"), ("circuit", "Monza")]
    rules = ask(spark, tables, "news_tool", "get_rules_analysis", "", article_id="1")[0]
    assert [t.topic_key for t in rules.topics] == ["red_flag", "stewards_penalty"] and len(rules.questions) == 4
    assert rules.chunks and rules.summary.startswith("这条新闻主要关联") and f"召回 {len(rules.chunks)} 个" in rules.summary
    plain = ask(spark, tables, "news_tool", "get_rules_analysis", "", article_id="2")[0]
    assert plain.topics == [] and plain.summary.startswith("这条新闻未命中")
    for action in ("get_article", "get_insights", "get_rules_analysis"):
        assert ask(spark, tables, "news_tool", action, "", article_id="99")[0].error == "News article not found."


def test_recent_articles_and_insight_summary(spark):
    from datetime import datetime

    dated = [(n, "s", str(n), f"t{n}", None, "First. Second.", f"u{n}", None, datetime(2026, 1, n), [], None, None, False) for n in range(1, 9)]
    undated = [(20, "s", "x", "undated", "the summary", "First. Second.", "u20", None, None, [], None, None, False)]
    many = tools.Tables(articles=spark.createDataFrame(dated + undated, ARTICLE))
    listed = sorted(ask(spark, many, "news_tool", "list_recent", "", limit="120"), key=lambda r: r.rank)
    assert [r.id for r in listed] == [8, 7, 6, 5, 4, 3, 2, 1, 20]
    assert ask(spark, many, "news_tool", "list_recent", "", limit="-3") == []
    assert len(ask(spark, many, "news_tool", "list_recent", "")) == 9
    assert ask(spark, many, "news_tool", "get_insights", "", article_id="20")[0].summary == "the summary"
    assert ask(spark, many, "news_tool", "get_insights", "", article_id="3")[0].summary == "First."


def test_race(spark, tables):
    assert ask(spark, tables, "race_tool", "get_next_race", "")[0].grand_prix_name == "Belgian Grand Prix"
    assert ask(spark, tables, "race_tool", "get_previous_race", "")[0].grand_prix_name == "British Grand Prix"
    schedule = ask(spark, tables, "race_tool", "list_schedule", "完整赛历")[0].answer
    assert schedule.splitlines() == [
        "当前完整赛历：",
        "R9 British Grand Prix（Silverstone Circuit，United Kingdom），正赛时间 2026-07-05 22:00 CST。",
        "R10 Belgian Grand Prix（Spa-Francorchamps，Belgium），正赛时间 2026-07-19 22:00 CST。",
    ]
    second = ask(spark, tables, "race_tool", "get_driver_standings", "第二名是谁")[0].answer
    assert second == "当前车手积分榜第 2 名是 George Russell，所属车队 Mercedes，积分 131。"
    named = ask(spark, tables, "race_tool", "get_driver_standings", "勒克莱尔 now")[0].answer
    assert named == "Charles Leclerc 当前排在车手积分榜第 3 名，所属车队 Ferrari，积分 112。"
    beyond = ask(spark, tables, "race_tool", "get_constructor_standings", "第九名? 第 9 名")[0].answer
    assert beyond == "当前只获取到前 3 名车队积分榜数据，无法确认第 9 名。"


def test_rules_strategy_and_general(spark, tables):
    found = ask(spark, tables, "regulation_tool", "ask", "unsafe release in the pit lane")[0]
    assert found.citations[0].content.startswith("An unsafe release") and found.answer_status == "answered"
    assert found.answer == "根据当前检索结果，最相关的依据来自《Rules Section B》的 B2（页码未知）。"
    off = ask(spark, tables, "regulation_tool", "ask", "unsafe release of a ufo")[0]
    assert (off.evidence_count, off.answer_status, off.citations) == (0, "insufficient_evidence", [])
    section = ask(spark, tables, "regulation_tool", "ask", "What does Section B cover?")[0]
    assert section.query_type == "section_overview" and "B2；B3" in section.answer
    none = ask(spark, tables, "regulation_tool", "ask", "overview of section E")[0]
    assert none.answer == "当前索引中没有 Section E，所以不能基于现有资料概括这一部分。"
    whole = ask(spark, tables, "regulation_tool", "ask", "FIA regulation overview")[0]
    assert whole.query_type == "document_overview" and whole.evidence_count == 3
    assert whole.answer.startswith("2026 FIA F1 Regulations 当前索引大致分为 Section A-F：Section A: General")
    assert ask(spark, tables, "regulation_tool", "ask", " ")[0].error == "Question is required."
    stages = ask(spark, tables, "regulation_tool", "debug_retrieval", "unsafe release in the pit lane")
    assert {r.stage for r in stages} == {"keyword", "fused", "hybrid", "retrieved"}
    assert min((r.rank, r.chunk_id) for r in stages if r.stage == "retrieved") == (1, 2)
    strategy = ask(spark, tables, "strategy_tool", "analyze", "box now?", race_items="2")[0]
    assert strategy.facts == ["Received 2 race context items."] and strategy.confidence == "low"
    assert ask(spark, tables, "general_tool", "answer", "latest news")[0].answer.startswith("这个问题")
    assert ask(spark, tables, "general_tool", "answer", "hello")[0].answer is None


def test_unknown_tool(spark, tables):
    with pytest.raises(ValueError):
        ask(spark, tables, "race_tool", "fly", "")
