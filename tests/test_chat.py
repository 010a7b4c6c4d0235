"""Plans and answers of messages, races around a time, new articles in rounds; against literal and brute-force answers."""

import random

import pytest
from pyspark.sql import functions as F
from test_tools import tables  # noqa: F401

from lectern.operators import merge, order
from lectern.plans import chat, tools

MESSAGE = "query_id long, message string, fallback string, planner_reply string"


@pytest.fixture(scope="module")
def answers(spark, tables):  # noqa: F811
    asked = [
        (1, "article #1 and its rules", None, None), (2, "news 99", None, None), (3, "analysis of article 2", None, None),
        (4, "下一站", None, None), (5, "previous race", None, None), (6, "what about 2027", "race", None),
        (7, "完整赛历", None, None), (8, "车手积分榜前2名", None, None), (9, "team standings first", None, None),
        (10, "unsafe release penalty", None, None), (11, "box now?", None, None), (12, "sing", None, "{}"),
        (13, "sing more", None, 'so: {"intent": "race", "action": "get_next_race"}'), (14, "  ", None, None),
        (15, "hello", None, '{"intent": "race", "action": "get_next_race"}'), (16, "latest news", None, None),
    ]
    plans = chat.planned(spark.createDataFrame(asked, MESSAGE))
    lost = plans.filter("query_id = 12").withColumn("query_id", F.lit(17).cast("long")).withColumn("intent", F.lit("weather"))
    lost = lost.withColumn("tool_name", F.lit("dispatcher")).withColumn("action", F.lit("unsupported"))
    rows = chat.answered(tables, plans.unionByName(lost)).collect()
    assert len(rows) == 17
    return {r["query_id"]: r for r in rows}


def test_plans(answers):
    told = {n: (r["tool_name"], r["action"], r["planned_by"]) for n, r in answers.items()}
    assert told[1] == ("news_tool", "get_rules_analysis", "article")
    assert told[3] == ("news_tool", "get_insights", "article")
    assert told[6] == ("race_tool", "list_schedule", "words")
    assert told[12] == ("general_tool", "answer", "words")
    assert told[13] == ("race_tool", "get_next_race", "model")
    assert told[15] == ("general_tool", "answer", "words")


def test_answers(answers):
    said = {n: r["answer"] for n, r in answers.items()}
    assert said[1].startswith("这条新闻主要关联")
    assert (answers[2]["success"], said[2], answers[2]["answer_status"]) == (False, "News article not found.", "error")
    assert said[3] == "A launch 关键点：A launch。"
    assert said[4].startswith("下一站比赛：R10 Belgian Grand Prix（") and said[13] == said[4]
    assert said[5].startswith("上一站比赛：R9 British Grand Prix（")
    assert said[6].startswith("近期赛历：\nR9") and said[7].startswith("当前完整赛历：\nR9")
    assert said[8].startswith("当前车手积分榜前 2 名：\n1. ")
    assert said[9].startswith("当前车队积分榜第 1 名是 ")
    assert said[10].startswith("根据当前检索结果") and answers[10]["answer_status"] == "answered"
    assert said[11].startswith("策略建议：Combine live") and answers[11]["confidence"] == "low"
    assert "通用回答能力不可用" in said[12] and answers[12]["source_mode"] == "general_fallback"
    assert said[14] == "Question is required." and not answers[14]["success"]
    assert said[15].startswith("你好") and said[16] == "已获取最近的 F1 新闻，重点包括：New livery；Red flag at Monza。"
    assert said[17] == "Unsupported intent: weather" and answers[17]["answer_status"] == "error"


def test_no_messages(spark, tables):  # noqa: F811
    plans = chat.planned(spark.createDataFrame([], MESSAGE))
    assert chat.answered(tables, plans).count() == 0


def test_seasons_and_times(spark, tables):  # noqa: F811
    older = tables.events.withColumn("season", F.lit(2025).cast(dict(tables.events.dtypes)["season"])).withColumn(
        "event_id", F.col("event_id") + 100
    )
    for column in ("start_date", "end_date"):
        older = older.withColumn(column, F.col(column) - F.expr("INTERVAL 1 YEAR"))
    both = tools.Tables(events=tables.events.unionByName(older), now="2026-07-06T00:00:00Z")
    rows = [(1, "", {}, "2026-07-01 00:00:00"), (2, "", {"season": "2025"}, None), (3, "", {"season": "1999"}, None), (4, "", {}, "2030-01-01 00:00:00")]
    requests = spark.createDataFrame(rows, "query_id long, message string, params map<string,string>, at string")
    names = {r["query_id"]: (r["season"], r["round_number"]) for r in tools.execute(both, "race_tool", "get_next_race", requests).collect()}
    assert names == {1: (2026, 9), 2: (None, None), 3: (None, None), 4: (None, None)}
    names = {r["query_id"]: (r["season"], r["round_number"]) for r in tools.execute(both, "race_tool", "get_previous_race", requests).collect()}
    assert names[4] == (2026, 10) and names[1] == (None, None) and names[2] == (2025, 10)


def test_strategy_context(spark, tables):  # noqa: F811
    whole = tools.Tables(**{**vars(tables), "attach": True})
    rows = [(1, "unsafe release in the pit lane", {}), (2, "unsafe release in the pit lane", {"news_items": "7", "race_items": "1"}), (3, "zzz", {})]
    requests = spark.createDataFrame(rows, "query_id long, message string, params map<string,string>")
    found = {r["query_id"]: r for r in tools.execute(whole, "strategy_tool", "analyze", requests).collect()}
    assert found[1]["next_race"] == "Belgian Grand Prix" and found[1]["previous_race"] == "British Grand Prix"
    assert found[1]["news_context"] == ["New livery: A launch", "Red flag at Monza"]
    assert found[1]["regulation_context"][0].startswith("Rules Section B | B2 | An unsafe release")
    assert found[2]["facts"][0] == "Received 3 race context items." and found[2]["facts"][-1] == "Received 7 news context items."
    assert found[3]["regulation_context"] is None and len(found[3]["facts"]) == 2


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_events_around_times(spark, keys):
    draw = random.Random(3)
    events = [(i, draw.randrange(4), draw.randrange(60), None if i % 17 == 0 else draw.randrange(60)) for i in range(150)]
    probes = [(i, draw.randrange(4), None if i % 19 == 0 else draw.randrange(64)) for i in range(200)]
    known = spark.createDataFrame(events, "event_id long, k int, start_date int, end_date int").repartition(6)
    asked = spark.createDataFrame(probes, "query_id long, k int, at int")
    found = {r["query_id"]: (r["previous_id"], r["next_id"]) for r in order.around(asked, known, keys).collect()}
    for query, k, at in probes:
        own = [e for e in events if e[3] is not None and (not keys or e[1] == k)]
        past = [(-e[3], e[0]) for e in own if at is not None and e[3] < at]
        coming = [(e[2], e[0]) for e in own if at is not None and e[3] >= at]
        expected = (min(past)[1] if past else None, min(coming)[1] if coming else None)
        assert found.get(query, (None, None)) == expected


@pytest.mark.parametrize("kind", ["random", "chain", "hot"])
def test_new_articles_in_rounds(spark, kind):
    draw = random.Random(11)
    if kind == "chain":
        rows = [(i, f"k{i // 2}", f"u{(i + 1) // 2}") for i in range(60)]
    elif kind == "hot":
        rows = [(i, "hot" if i % 3 == 0 else f"k{draw.randrange(90)}", f"u{draw.randrange(200)}") for i in range(300)]
    else:
        rows = [(i, None if i % 9 == 0 else f"k{draw.randrange(60)}", f"u{draw.randrange(70)}") for i in range(200)]
    taken, expected = set(), []
    for arrival, key, url in rows:
        own = {("u", url)} | ({("k", key)} if key else set())
        if not own & taken:
            taken |= own
            expected.append(arrival)
    found = merge._new_articles(spark.createDataFrame(rows, "arrival long, skey string, article_url string"))
    assert sorted(r["arrival"] for r in found.collect()) == expected
