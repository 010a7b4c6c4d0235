"""Registered queries over messages: plans, answers, and the races around each message's time."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import answers, order
from lectern.plans import chat, tools
from lectern.plans import fixtures as fx
from lectern.plans import search_queries as sq
from lectern.plans import state_queries as st
from lectern.session import cut_lineage
from lectern.sources.tables import table

#: What a benchmark item asks, one message a kind; the first one is about the item's own text.
KINDS = [
    None,
    "article #{n}",
    "news {n} insight please",
    "latest paddock dispatch {n}",
    "next race date {n}",
    "previous race {n}",
    "race calendar {n}",
    "complete race calendar with sessions {n}",
    "driver standings top 2 of {n}",
    "constructor standings of {n}: 2nd",
    "pit stop or not {n}",
    "hello {n}",
    "a current question {n}",
    "what about {n}",
    "sing for {n}",
]
ABOUT = "regulation: "
#: The model's plan for the last kind; every other one is of no use.
REPLIES = ('{"intent": "race", "action": "list_schedule"}', "no plan")
SEASONS = 25


def _messages(spark, root):
    """Fifteen messages an item, each with a time and a season of its own."""
    item = F.col("query_id")
    text = F.when(F.col("k") == 0, F.concat(F.lit(ABOUT), "question"))
    for k, form in enumerate(KINDS):
        if form is not None:
            front, back = form.split("{n}")
            text = text.when(F.col("k") == k, F.concat(F.lit(front), (item * 3 + 1).cast("string"), F.lit(back)))
    return (
        fx.questions(spark, root)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(KINDS) - 1))))
        .select(
            (item * 16 + F.col("k")).alias("query_id"),
            text.alias("message"),
            F.when(F.col("k") == 13, "race").alias("fallback"),
            F.when(F.col("k") == 14, F.when(item % 2 == 0, REPLIES[0]).otherwise(REPLIES[1])).alias("planner_reply"),
            F.timestamp_seconds(F.lit(725846400) + (item * 61 + F.col("k") * 7) % 2200 * 86400).alias("at"),
            (item % SEASONS).cast("string").alias("season"),
        )
    )


MESSAGES_SQL = f"""{fx.QUESTIONS_SQL},
messages AS (
  SELECT query_id AS item, query_id * 16 + k AS query_id, k, question, query_id * 3 + 1 AS n, query_id % {SEASONS} AS season,
         make_timestamp((725846400 + (query_id * 61 + k * 7) % 2200 * 86400) * 1000000) AS asked_at
  FROM questions, range({len(KINDS)}) r(k)
)"""


def _plans(spark, root):
    plans = chat.planned(_messages(spark, root))
    return plans.withColumn("params", F.map_concat("params", F.create_map(F.lit("season"), F.col("season"))))


def chat_plans(spark, root):
    """Plan of every message, by its article, its words or the model."""
    params = F.array_join(F.transform(F.map_entries("params"), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";")
    return chat.planned(_messages(spark, root)).select(
        "query_id", "intent", "tool_name", "action", "planned_by", F.when(F.col("intent") == "news", params).alias("params")
    )


_KIND_TABLE = fx.sql_values(
    [
        (0, "regulation", "ask", "words"), (1, "news", "get_article", "article"), (2, "news", "get_insights", "article"),
        (3, "news", "list_recent", "words"), (4, "race", "get_next_race", "words"), (5, "race", "get_previous_race", "words"),
        (6, "race", "list_schedule", "words"), (7, "race", "list_schedule", "words"), (8, "race", "get_driver_standings", "words"),
        (9, "race", "get_constructor_standings", "words"), (10, "strategy", "analyze", "words"), (11, "general", "answer", "words"),
        (12, "general", "answer", "words"), (13, "race", "list_schedule", "words"), (14, "general", "answer", "words"),
    ]
)
PLANS_SQL = f"""{MESSAGES_SQL},
kinds(k, intent, action, planned_by) AS ({_KIND_TABLE}),
plans AS (
  SELECT m.* REPLACE (CASE WHEN k = 14 AND item % 2 = 0 THEN 13 ELSE k END AS k),
         CASE WHEN k = 14 AND item % 2 = 0 THEN 'race' ELSE intent END AS intent,
         CASE WHEN k = 14 AND item % 2 = 0 THEN 'race' ELSE intent END || '_tool' AS tool_name,
         CASE WHEN k = 14 AND item % 2 = 0 THEN 'list_schedule' ELSE action END AS action,
         CASE WHEN k = 14 AND item % 2 = 0 THEN 'model' ELSE planned_by END AS planned_by
  FROM messages m JOIN kinds USING (k)
)"""
CHAT_PLANS_SQL = f"""
WITH {PLANS_SQL}
SELECT query_id, intent, tool_name, action, planned_by,
       CASE WHEN k IN (1, 2) THEN 'article_id=' || n WHEN k = 3 THEN 'limit=5' END AS params
FROM plans"""


def _tables(spark, root):
    orders = st._order_events(spark, root)
    events = orders.select(
        "event_id", F.col("o_custkey").cast("string").alias("season"), "start_date", "end_date",
        (F.col("event_id") % 24).cast("int").alias("round_number"), F.concat(F.lit("Prix "), "event_id").alias("grand_prix_name"),
        F.col("o_orderpriority").alias("circuit_name"), F.when(F.col("event_id") % 3 == 0, "Land").alias("country"),
        F.array(F.struct(F.lit("Race").alias("name"), F.col("end_date").alias("start_time"))).alias("sessions"),
    )
    nation = table(spark, root, "nation")
    drivers = table(spark, root, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_nationkey").cast("string").alias("season"), (F.col("s_suppkey") / SEASONS + 1).cast("int").alias("position"),
        F.concat(F.lit("Driver "), "s_suppkey").alias("driver_name"), F.col("n_name").alias("team_name"),
        F.floor("s_acctbal").cast("int").alias("points"),
    )
    teams = nation.select(
        F.col("n_regionkey").cast("string").alias("season"), (F.col("n_nationkey") + 1).cast("int").alias("position"),
        F.col("n_name").alias("team_name"), (F.col("n_nationkey") * 10).cast("int").alias("points"),
    )
    found = cut_lineage(sq.stages(spark, root)["retrieved"], "evidence")

    def evidence(asked):
        """The messages of an item are its number and their kind."""
        return asked.select("query_id", F.floor(F.col("query_id") / 16).alias("item")).join(
            found.withColumnRenamed("query_id", "item"), "item"
        ).drop("item")

    return tools.Tables(
        articles=fx.page_articles(spark, root), chunks=fx.corpus(spark, root), events=events, drivers=drivers, teams=teams,
        retrieved=evidence, attach=True,
    )


def chat_answers(spark, root):
    """Every message planned, run through its tool and answered."""
    return chat.answered(_tables(spark, root), _plans(spark, root))


CHAT_ANSWERS_SQL = rf"""
WITH {PLANS_SQL}, {fx.PAGE_ARTICLES_SQL},
e AS (
  SELECT o_orderkey AS event_id, o_custkey AS season, o_orderdate AS start_date, o_orderdate + to_days(CAST(o_orderkey % 5 AS INT)) AS end_date,
         CASE WHEN o_orderkey % 24 > 0 THEN 'R' || (o_orderkey % 24) || ' ' ELSE '' END || 'Prix ' || o_orderkey || '（' || o_orderpriority
           || CASE WHEN o_orderkey % 3 = 0 THEN '，Land' ELSE '' END || '），正赛时间 '
           || strftime(o_orderdate + to_days(CAST(o_orderkey % 5 AS INT)) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') || ' CST' AS line,
         '；周末安排：Race ' || strftime(o_orderdate + to_days(CAST(o_orderkey % 5 AS INT)) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') || ' CST' AS weekend
  FROM orders
),
races AS (
  SELECT p.query_id, arg_min(e, (start_date, event_id)) FILTER (end_date >= asked_at) AS coming,
         arg_max(e, (end_date, -event_id)) FILTER (end_date < asked_at) AS ended
  FROM plans p JOIN e USING (season) WHERE k IN (4, 5) GROUP BY ALL
),
seasons AS (
  SELECT season, count(*) AS n, string_agg(line || weekend || '。', chr(10) ORDER BY start_date, event_id) AS everything,
         array_to_string(list(line || '。' ORDER BY start_date, event_id)[1:3], chr(10)) AS head
  FROM e GROUP BY 1
),
news AS (
  SELECT string_agg(title, '；' ORDER BY published_at DESC NULLS LAST, id DESC) AS titles FROM (
    SELECT * FROM page_articles WHERE NOT is_deleted ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 3)
),
drivers AS (
  SELECT s_nationkey AS season, count(*) AS n, list(CAST(floor(s_suppkey / {SEASONS}.0 + 1) AS INT) || '. Driver ' || s_suppkey || ' | ' || n_name || ' | ' || CAST(floor(s_acctbal) AS INT) || '分'
           ORDER BY CAST(floor(s_suppkey / {SEASONS}.0 + 1) AS INT), 'Driver ' || s_suppkey)[1:2] AS best
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1
),
teams AS (
  SELECT n_regionkey AS season, list({{'position': n_nationkey + 1, 'name': n_name, 'points': n_nationkey * 10}} ORDER BY n_nationkey) AS t
  FROM nation GROUP BY 1
),
picked AS (
  SELECT season, len(t) AS n, coalesce(list_filter(t, lambda x: x.position = 2)[1], t[2]) AS pick FROM teams
),
s AS (
  SELECT *, list_filter(list_transform(
      string_split(regexp_replace(coalesce(nullif(content, ''), nullif(summary, ''), title), '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)),
      lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')[1:3] AS sents
  FROM page_articles WHERE NOT is_deleted
),
a AS (
  SELECT *, CASE WHEN len(sents) > 0 THEN list_filter(sents, lambda x, i: list_position(sents, x) = i) ELSE [title] END AS points FROM s
),
rules AS ({st.ANSWER_STATUS_SQL})
SELECT p.query_id, intent, tool_name, action, planned_by,
       NOT (k IN (1, 2) AND a.id IS NULL OR k = 4 AND coming IS NULL OR k = 5 AND ended IS NULL) AS success,
       CASE WHEN k IN (1, 2) AND a.id IS NULL THEN 'News article not found.'
            WHEN k = 4 AND coming IS NULL THEN 'No upcoming race found.'
            WHEN k = 5 AND ended IS NULL THEN 'No previous race found.' END AS error,
       CASE WHEN k = 0 AND rules.evidence_count = 0 THEN replace(rules.answer, question, '{ABOUT}' || question)
            WHEN k = 0 THEN rules.answer
            WHEN k IN (1, 2) AND a.id IS NULL THEN 'News article not found.'
            WHEN k = 1 THEN a.title || '：' || coalesce(nullif(a.summary, ''), nullif(a.content, ''), '暂无摘要。')
            WHEN k = 2 THEN coalesce(nullif(a.summary, ''), nullif(points[1], ''), a.title) || ' 关键点：' || array_to_string(points[1:3], '；') || '。'
            WHEN k = 3 THEN coalesce('已获取最近的 F1 新闻，重点包括：' || news.titles || '。', '已完成新闻查询。')
            WHEN k = 4 THEN coalesce('下一站比赛：' || coming.line || coming.weekend || '。', 'No upcoming race found.')
            WHEN k = 5 THEN coalesce('上一站比赛：' || ended.line || '。', 'No previous race found.')
            WHEN k = 7 THEN coalesce('当前完整赛历：' || chr(10) || everything, '已完成比赛信息查询。')
            WHEN k IN (6, 13) THEN coalesce('近期赛历：' || chr(10) || head || CASE WHEN seasons.n > 3
                 THEN chr(10) || '共获取 ' || seasons.n || ' 场比赛；如需全年列表，请问“完整赛历”。' ELSE '' END, '已完成比赛信息查询。')
            WHEN k = 8 THEN coalesce('当前车手积分榜前 ' || len(best) || ' 名：' || chr(10) || array_to_string(best, chr(10)), '已完成比赛信息查询。')
            WHEN k = 9 THEN coalesce('当前车队积分榜第 ' || pick.position || ' 名是 ' || pick.name || '，积分 ' || pick.points || '。', '已完成比赛信息查询。')
            WHEN k = 10 THEN '策略建议：{answers.STRATEGY["recommendation"]} 置信度：low。 关键判断：{answers.STRATEGY["analysis"][0]}'
            WHEN k = 11 THEN '{answers.GREETING}'
            WHEN k = 12 THEN '{answers.AUTHORITY_ANSWER}'
            ELSE '{answers.NO_MODEL}' END AS answer,
       CASE WHEN k = 0 THEN rules.answer_status WHEN k IN (11, 12, 14) THEN 'insufficient_evidence'
            WHEN k IN (1, 2) AND a.id IS NULL OR k = 4 AND coming IS NULL OR k = 5 AND ended IS NULL THEN 'error' ELSE 'answered' END AS answer_status,
       CASE WHEN k = 0 THEN rules.confidence WHEN k IN (10, 11, 12, 14) THEN 'low' END AS confidence,
       CASE WHEN k = 0 THEN rules.evidence_count ELSE 0 END AS evidence_count,
       CASE WHEN k = 0 THEN 'regulation_rag' WHEN k = 12 THEN 'general_guardrail' WHEN k IN (11, 14) THEN 'general_fallback' END AS source_mode,
       CASE WHEN k = 0 THEN 'fact_lookup' END AS query_type
FROM plans p CROSS JOIN news LEFT JOIN rules ON rules.query_id = p.item AND k = 0 LEFT JOIN a ON a.id = p.n AND k IN (1, 2)
LEFT JOIN races ON races.query_id = p.query_id LEFT JOIN seasons ON seasons.season = p.season LEFT JOIN drivers ON drivers.season = p.season
LEFT JOIN picked ON picked.season = p.season"""


def strategy_context(spark, root):
    """What a strategy request gets from the tables: races around its time, three pieces of evidence, three headlines."""
    tables = _tables(spark, root)
    requests = cut_lineage(_plans(spark, root).filter("action = 'analyze'"), "requests")
    brought = F.map_concat("params", F.create_map(F.lit("rule_items"), (F.col("query_id") % 3).cast("string")))
    found = tools.analyze(tables, requests.withColumn("params", brought))
    rules = F.transform("regulation_context", lambda r: F.md5(r))
    return found.select(
        "query_id", "previous_race", "next_race", F.array_join(rules, ";").alias("regulation_context"),
        F.array_join("news_context", ";").alias("news_context"), F.array_join("facts", " ").alias("facts"),
    )


STRATEGY_CONTEXT_SQL = f"""
WITH {MESSAGES_SQL}, {fx.PAGE_ARTICLES_SQL}, {st.ORDER_EVENTS_SQL},
races AS (
  SELECT m.query_id, 'Prix ' || arg_max(event_id, (end_date, -event_id)) FILTER (end_date < asked_at) AS previous_race,
         'Prix ' || arg_min(event_id, (start_date, event_id)) FILTER (end_date >= asked_at) AS next_race
  FROM messages m JOIN e ON e.o_custkey = m.season WHERE k = 10 GROUP BY 1
),
news AS (
  SELECT string_agg(title || CASE WHEN summary <> '' THEN ': ' || summary ELSE '' END, ';' ORDER BY published_at DESC NULLS LAST, id DESC) AS news_context,
         count(*) AS n
  FROM (SELECT * FROM page_articles WHERE NOT is_deleted ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 3)
),
evidence AS (
  SELECT query_id AS item, count(*) AS n,
         string_agg(md5(concat_ws(' | ', document_title, coalesce(nullif(article, ''), 'Unknown article'), content)), ';' ORDER BY rank) AS regulation_context
  FROM ({{reranked}}) WHERE rank <= 3 GROUP BY 1
),
c AS (
  SELECT m.query_id, previous_race, next_race, regulation_context, news_context,
         (previous_race IS NOT NULL)::INT + (next_race IS NOT NULL)::INT AS race_items, news.n AS news_items,
         CASE WHEN m.query_id % 3 > 0 THEN m.query_id % 3 ELSE coalesce(evidence.n, 0) END AS rule_items
  FROM messages m CROSS JOIN news LEFT JOIN races USING (query_id) LEFT JOIN evidence USING (item) WHERE k = 10
)
SELECT query_id, previous_race, next_race, regulation_context, news_context,
       concat_ws(' ', CASE WHEN race_items > 0 THEN 'Received ' || race_items || ' race context items.' END,
                 CASE WHEN rule_items > 0 THEN 'Received ' || rule_items || ' regulation context items.' END,
                 CASE WHEN news_items > 0 THEN 'Received ' || news_items || ' news context items.' END) AS facts
FROM c""".replace("{reranked}", f"WITH {sq.RERANKED_SQL} SELECT * FROM reranked")


def event_around(spark, root):
    """The orders that ended last before each line was shipped, and that come next after it, among those of its priority."""
    events = st._order_events(spark, root).withColumnRenamed("o_orderpriority", "priority")
    lines = table(spark, root, "lineitem").join(
        table(spark, root, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority")),
        "l_orderkey",
    )
    probes = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query_id"), "priority", F.col("l_shipdate").cast("timestamp").alias("at")
    )
    return order.around(probes, events, ["priority"])


EVENT_AROUND_SQL = f"""
WITH {st.ORDER_EVENTS_SQL},
p AS (SELECT l_orderkey * 10 + l_linenumber AS query_id, o_orderpriority AS priority, l_shipdate AS at FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
x AS (
  SELECT o_orderpriority AS priority, end_date, max(-event_id) AS low,
         min(min({{'s': start_date, 'id': event_id}})) OVER (PARTITION BY o_orderpriority ORDER BY end_date DESC) AS coming
  FROM e GROUP BY 1, 2
)
SELECT p.query_id, -b.low AS previous_id, c.coming.id AS next_id
FROM p ASOF LEFT JOIN x b ON b.priority = p.priority AND b.end_date < p.at
ASOF LEFT JOIN x c ON c.priority = p.priority AND c.end_date >= p.at"""

QUERIES = {
    "chat_plans": chat_plans,
    "chat_answers": chat_answers,
    "strategy_context": strategy_context,
    "event_around": event_around,
}
ORACLES = {
    "chat_plans": CHAT_PLANS_SQL,
    "chat_answers": CHAT_ANSWERS_SQL,
    "strategy_context": STRATEGY_CONTEXT_SQL,
    "event_around": EVENT_AROUND_SQL,
}
