"""Registered queries: calendar, standings, sessions, memory, routing, evaluation and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import dates
from lectern.functions import text as tx
from lectern.operators import answers, articles, evaluation, questions, race, routing, rules, search, sessions, vectors
from lectern.plans import fixtures as fx
from lectern.plans import search_queries as sq
from lectern.plans.text_queries import WS
from lectern.sources.tables import spread, table

TIME = "yyyy-MM-dd HH:mm:ss"
NOW = "1998-06-15 12:00:00"


def _order_events(spark, root):
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("event_id"), "o_custkey", "o_orderpriority",
        F.col("o_orderdate").cast("timestamp").alias("start_date"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.col("o_orderkey") % 5)).alias("end_date"),
    )


def next_event(spark, root):
    found = race.next_events(_order_events(spark, root), F.lit(NOW).cast("timestamp"), ["o_custkey"])
    return found.select("o_custkey", "event_id", F.date_format("start_date", TIME).alias("start_date"))


def previous_event(spark, root):
    found = race.previous_events(_order_events(spark, root), F.lit(NOW).cast("timestamp"), ["o_custkey"])
    return found.select("o_custkey", "event_id", F.date_format("end_date", TIME).alias("end_date"))


ORDER_EVENTS_SQL = """e AS (
  SELECT o_orderkey AS event_id, o_custkey, o_orderpriority, o_orderdate AS start_date, o_orderdate + to_days(CAST(o_orderkey % 5 AS INT)) AS end_date
  FROM orders
)"""
NEXT_SQL = f"""
WITH {ORDER_EVENTS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY start_date, event_id) AS n FROM e WHERE end_date >= TIMESTAMP '{NOW}')
SELECT o_custkey, event_id, strftime(start_date, '%Y-%m-%d %H:%M:%S') AS start_date FROM r WHERE n = 1"""
PREVIOUS_SQL = f"""
WITH {ORDER_EVENTS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY end_date DESC, event_id) AS n FROM e WHERE end_date < TIMESTAMP '{NOW}')
SELECT o_custkey, event_id, strftime(end_date, '%Y-%m-%d %H:%M:%S') AS end_date FROM r WHERE n = 1"""


def _calendar_documents(spark, root):
    """A calendar document per order: some sessions are missing, some have no time."""
    day = "date_format(o_orderdate + make_interval(0, 0, 0, {d}), 'yyyy-MM-dd')"

    def session(days: int, clock: str, present: str) -> str:
        return f"CASE WHEN {present} THEN named_struct('date', {day.format(d=days)}, 'time', {clock}) END"

    document = f"""to_json(named_struct('MRData', named_struct('RaceTable', named_struct('Races', array(named_struct(
      'season', date_format(o_orderdate, 'yyyy'), 'round', CAST(o_orderkey % 24 AS STRING), 'raceName', concat('Prix ', o_orderkey),
      'Circuit', named_struct('circuitName', concat('Ring ', o_custkey % 30), 'Location', named_struct('country', o_orderpriority)),
      'date', {day.format(d=2)}, 'time', CASE WHEN o_orderkey % 4 <> 0 THEN '14:00:00Z' END,
      'FirstPractice', {session(0, "'11:30:00Z'", 'o_orderkey % 2 = 0')},
      'SecondPractice', {session(0, "CAST(NULL AS STRING)", 'o_orderkey % 3 = 0')},
      'Sprint', {session(1, "'10:00:00+02:00'", 'o_orderkey % 5 = 0')},
      'Qualifying', {session(2, "'14:00:00Z'", 'o_orderkey % 7 = 0')}))))))"""
    return table(spark, root, "orders").select("o_orderkey", F.expr(document).alias("document"))


def calendar_parse(spark, root):
    events = race.parse_calendar(_calendar_documents(spark, root), "document", ["o_orderkey"])
    return events.select(
        "o_orderkey", "season", "round_number", "grand_prix_name", "circuit_name", "country",
        F.date_format("start_date", TIME).alias("start_date"), F.date_format("end_date", TIME).alias("end_date"),
        F.size("sessions").cast("long").alias("session_count"),
    )


CALENDAR_SQL = """
WITH s AS (
  SELECT *, o_orderdate + INTERVAL 2 DAY + CASE WHEN o_orderkey % 4 <> 0 THEN INTERVAL 14 HOUR ELSE INTERVAL 0 HOUR END AS main,
         CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 690 MINUTE END AS p1,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS p2,
         CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 32 HOUR END AS sp,
         CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 62 HOUR END AS q
  FROM orders
)
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS season, CAST(o_orderkey % 24 AS INT) AS round_number,
       'Prix ' || o_orderkey AS grand_prix_name, 'Ring ' || (o_custkey % 30) AS circuit_name, o_orderpriority AS country,
       strftime(least(main, p1, p2, sp, q), '%Y-%m-%d %H:%M:%S') AS start_date, strftime(main, '%Y-%m-%d %H:%M:%S') AS end_date,
       CAST(1 + (p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT + (sp IS NOT NULL)::INT + (q IS NOT NULL)::INT AS BIGINT) AS session_count
FROM s"""


def nested_sessions(spark, root):
    """Session names of each event in time order."""
    events = race.parse_calendar(_calendar_documents(spark, root), "document", ["o_orderkey"])
    named = F.transform("sessions", lambda s: F.concat(s["name"], F.lit(" "), dates.display_time(s["start_time"])))
    return events.select("o_orderkey", F.array_join(named, "; ").alias("sessions"))


NESTED_SQL = """
WITH s AS (
  SELECT o_orderkey, 6 AS i, 'Race' AS name,
         o_orderdate + INTERVAL 2 DAY + CASE WHEN o_orderkey % 4 <> 0 THEN INTERVAL 14 HOUR ELSE INTERVAL 0 HOUR END AS t FROM orders
  UNION ALL SELECT o_orderkey, 0, 'Practice 1', o_orderdate + INTERVAL 690 MINUTE FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 1, 'Practice 2', o_orderdate FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 4, 'Sprint', o_orderdate + INTERVAL 32 HOUR FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, 5, 'Qualifying', o_orderdate + INTERVAL 62 HOUR FROM orders WHERE o_orderkey % 7 = 0
)
SELECT o_orderkey, string_agg(name || ' ' || strftime(t + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') || ' CST', '; ' ORDER BY t, i) AS sessions
FROM s GROUP BY 1"""


def display_time(spark, root):
    """Event times on the display zone's wall clock, a tenth of them unknown."""
    at = F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp"))
    return table(spark, root, "events").select("event_id", dates.display_time(at).alias("shown"))


DISPLAY_SQL = """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '时间未知' ELSE strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') || ' CST' END AS shown
FROM events"""


def _revenue(spark, root):
    """Revenue per supplier, reduced before it meets the suppliers."""
    lines = table(spark, root, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )
    return table(spark, root, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"))


def standings_parse(spark, root):
    """Standings documents written per supplier, read back: half points are cut, some teams are missing."""
    document = F.expr(
        """to_json(named_struct('MRData', named_struct('StandingsTable', named_struct('StandingsLists', array(named_struct(
        'DriverStandings', array(named_struct('position', CAST(s_suppkey % 20 + 1 AS STRING), 'points', CAST(round(s_acctbal, 1) AS STRING),
          'Driver', named_struct('givenName', 'Given', 'familyName', s_name),
          'Constructors', CASE WHEN s_suppkey % 6 = 0 THEN array() ELSE array(named_struct('name', concat('Team ', s_nationkey))) END)),
        'ConstructorStandings', array(named_struct('position', CAST(s_nationkey + 1 AS STRING), 'points', CAST(floor(s_acctbal) + 0.5 AS STRING),
          'Constructor', named_struct('name', concat('Team ', s_nationkey))))))))))"""
    )
    rows = table(spark, root, "supplier").select("s_suppkey", document.alias("document"))
    drivers = race.parse_standings(rows, "document", "driver", ["s_suppkey"])
    teams = race.parse_standings(rows, "document", "constructor", ["s_suppkey"])
    return drivers.select("s_suppkey", F.lit("driver").alias("kind"), "position", "driver_name", "team_name", "points").unionByName(
        teams.select("s_suppkey", F.lit("constructor").alias("kind"), "position", F.lit(None).cast("string").alias("driver_name"),
                     "team_name", "points")
    )


STANDINGS_PARSE_SQL = """
SELECT s_suppkey, 'driver' AS kind, CAST(s_suppkey % 20 + 1 AS INT) AS position, 'Given ' || s_name AS driver_name,
       CASE WHEN s_suppkey % 6 = 0 THEN 'Unknown' ELSE 'Team ' || s_nationkey END AS team_name,
       CAST(trunc(round(s_acctbal, 1)) AS INT) AS points
FROM supplier
UNION ALL
SELECT s_suppkey, 'constructor', s_nationkey + 1, NULL, 'Team ' || s_nationkey, CAST(trunc(floor(s_acctbal) + 0.5) AS INT) FROM supplier"""


def standings_topn(spark, root):
    """Ten best suppliers of each nation by revenue."""
    best = search.ranked(_revenue(spark, root), "s_nationkey", [F.desc("revenue"), F.asc("s_suppkey")], 10, "position")
    return best.select("s_nationkey", F.col("position").cast("long").alias("position"), "s_suppkey", "revenue")


TOPN_SQL = """
WITH r AS (
  SELECT s_nationkey, s_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2
)
SELECT * FROM (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY revenue DESC, s_suppkey) AS position, s_suppkey, revenue FROM r)
WHERE position <= 10"""


def _nation_standings(spark, root):
    """The ten nations with the largest customer balances, as one array of at most ten entries."""
    sums = table(spark, root, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"))
    named = sums.join(table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    best = named.orderBy(F.desc("balance"), F.asc("n_nationkey")).limit(10)
    entries = F.array_sort(
        F.collect_list(F.struct((-F.col("balance")).alias("o"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"),
                                F.floor("balance").cast("int").alias("p")))
    )
    return best.select(
        F.transform(entries, lambda e, i: F.struct((i + 1).alias("position"), e["n"].alias("team_name"), e["p"].alias("points")))
    ).scalar()


def _messages(spark, root):
    """A message per customer that names a nation, a place or nothing, over one or two lines."""
    key = F.col("c_custkey")
    return table(spark, root, "customer").select(
        "c_custkey",
        F.expr(
            """CASE c_custkey % 6
              WHEN 0 THEN concat('How is nation_', c_nationkey, ' doing\\nand now?')
              WHEN 1 THEN concat('the ', CAST(c_custkey % 40 AS STRING), 'th of the standings')
              WHEN 2 THEN concat('Top ', CAST(c_custkey % 9 AS STRING), ' please')
              WHEN 3 THEN concat('第 ', CAST(c_custkey % 12 AS STRING), ' 名 zone', CAST(c_nationkey AS STRING), '!')
              WHEN 4 THEN concat('前', element_at(array('三', '十', '十二', '二十', '四十五', '百'), CAST(c_custkey % 6 AS INT) + 1), '名 second')
              ELSE concat('full standings of ', c_mktsegment) END"""
        ).alias("message"),
    ).where(key.isNotNull())


MESSAGES_SQL = """messages AS (
  SELECT c_custkey, CASE c_custkey % 6
    WHEN 0 THEN 'How is nation_' || c_nationkey || ' doing' || chr(10) || 'and now?'
    WHEN 1 THEN 'the ' || (c_custkey % 40) || 'th of the standings'
    WHEN 2 THEN 'Top ' || (c_custkey % 9) || ' please'
    WHEN 3 THEN '第 ' || (c_custkey % 12) || ' 名 zone' || c_nationkey || '!'
    WHEN 4 THEN '前' || (['三', '十', '十二', '二十', '四十五', '百'])[c_custkey % 6 + 1] || '名 second'
    ELSE 'full standings of ' || c_mktsegment END AS message
  FROM customer
)"""
ZONES = [(f"zone{i}", f"NATION_{i}") for i in range(25)]
NATION_SQL = """n AS (
  SELECT n_name AS team_name, CAST(floor(balance) AS INT) AS points,
         CAST(row_number() OVER (ORDER BY balance DESC, n_nationkey) AS INT) AS position
  FROM (SELECT n_name, n_nationkey, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
  ORDER BY balance DESC, n_nationkey LIMIT 10
)"""


def alias_lookup(spark, root):
    rows = _messages(spark, root).withColumn("standings", _nation_standings(spark, root))
    entry = race.match_entry("message", F.col("standings"), "team_name", ZONES)
    return rows.select("c_custkey", entry.alias("e")).select("c_custkey", "e.position", "e.team_name", "e.points")


ALIAS_SQL = f"""
WITH {MESSAGES_SQL}, {NATION_SQL},
m AS (
  SELECT c_custkey, min(position) AS position FROM messages JOIN n
    ON contains(lower(message), lower(team_name))
    OR len(list_filter(range(25), lambda i: contains(lower(message), 'zone' || i) AND contains(lower(team_name), 'nation_' || i))) > 0
  GROUP BY 1
)
SELECT c_custkey, position, team_name, points FROM messages LEFT JOIN m USING (c_custkey) LEFT JOIN n USING (position)"""


def position_parse(spark, root):
    return _messages(spark, root).select(
        "c_custkey", race.requested_position("message").alias("position"), race.requested_top("message").alias("top_n"),
        race.wants_full_standings("message").alias("full_list"),
    )


POSITION_SQL = rf"""
WITH {MESSAGES_SQL},
w(ord, word, pos) AS ({fx.sql_values([(i, w, p) for i, (w, p) in enumerate(vocab.POSITION_WORDS)])}),
k AS (SELECT c_custkey, arg_min(pos, ord) AS pos FROM messages JOIN w ON contains(lower(message), word) GROUP BY 1)
SELECT c_custkey,
       CAST(coalesce(pos, try_cast(nullif(regexp_extract(message, '第\s*(\d+)\s*名?', 1), '') AS INT),
                     try_cast(nullif(regexp_extract(lower(message), '\b(\d+)(st|nd|rd|th)\b', 1), '') AS INT), 1) AS INT) AS position,
       CASE c_custkey % 6 WHEN 2 THEN CAST(greatest(c_custkey % 9, 1) AS INT)
            WHEN 4 THEN ([3, 10, 12, 20, 45, NULL])[c_custkey % 6 + 1] END AS top_n,
       c_custkey % 6 = 5 AS full_list
FROM messages LEFT JOIN k USING (c_custkey)"""


def standings_by_position(spark, root):
    rows = _messages(spark, root).withColumn("standings", _nation_standings(spark, root))
    picked = race.pick_position(F.col("standings"), race.requested_position("message"))
    return rows.select("c_custkey", picked.alias("e")).select("c_custkey", "e.position", "e.team_name", "e.points")


BY_POSITION_SQL = f"""
WITH p AS ({POSITION_SQL}), {NATION_SQL}
SELECT c_custkey, n.position, team_name, points FROM p LEFT JOIN n ON n.position = p.position"""


def answer_format(spark, root):
    """Standings answers to all messages."""
    rows = _messages(spark, root).withColumn("standings", _nation_standings(spark, root))
    parsed = rows.select(
        "c_custkey", "standings", race.wants_full_standings("message").alias("full"), race.requested_top("message").alias("top_n"),
        race.match_entry("message", F.col("standings"), "team_name", ZONES).alias("subject"),
        race.requested_position("message").alias("position"),
    ).withColumn("picked", race.pick_position(F.col("standings"), F.col("position")))
    answer = answers.standings_answer(*([F.col("standings"), "constructor"] + [F.col(c) for c in ("full", "top_n", "subject", "position", "picked")]))
    return parsed.select("c_custkey", answer.alias("answer"))


ANSWER_SQL = f"""
WITH p AS ({POSITION_SQL}), a AS ({ALIAS_SQL}), {NATION_SQL}
SELECT p.c_custkey, CASE
    WHEN full_list THEN '当前完整车队积分榜：' || chr(10) ||
      (SELECT string_agg(position || '. ' || team_name || ' | ' || points || '分', chr(10) ORDER BY position) FROM n)
    WHEN top_n IS NOT NULL THEN '当前车队积分榜前 ' || least(top_n, (SELECT count(*) FROM n)) || ' 名：' || chr(10) ||
      array_to_string((SELECT list(position || '. ' || team_name || ' | ' || points || '分' ORDER BY position) FROM n)[1:top_n], chr(10))
    WHEN a.position IS NOT NULL THEN a.team_name || ' 当前排在车队积分榜第 ' || a.position || ' 名，积分 ' || a.points || '。'
    WHEN n.position IS NOT NULL THEN '当前车队积分榜第 ' || n.position || ' 名是 ' || n.team_name || '，积分 ' || n.points || '。'
    ELSE '当前只获取到前 ' || (SELECT count(*) FROM n) || ' 名车队积分榜数据，无法确认第 ' || p.position || ' 名。' END AS answer
FROM p JOIN a USING (c_custkey) LEFT JOIN n ON n.position = p.position"""


def _turns(spark, root):
    """Conversation turns; roles stand in for the intents the tables lack."""
    return spread(table(spark, root, "conversations"), "conv_id").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), "role", F.col("text").alias("message"),
        F.when((F.col("role") == "assistant") & (F.col("turn") % 4 != 3), F.concat(F.lit("intent"), F.col("conv_id") % 5)).alias("intent"),
    )


def recent_turns(spark, root):
    return sessions.recent_turns(_turns(spark, root), 3).select(
        "session_id", F.col("back").cast("long").alias("back"), "ord", sessions.speaker("role").alias("speaker")
    )


RECENT_TURNS_SQL = """
SELECT * FROM (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, turn AS ord,
         CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END AS speaker FROM conversations) WHERE back <= 3"""


def session_summary(spark, root):
    return sessions.last_intent(_turns(spark, root))


SESSION_SUMMARY_SQL = """
SELECT conv_id AS session_id, count(*) AS turn_count,
       arg_max('intent' || (conv_id % 5), turn) FILTER (WHERE role = 'assistant' AND turn % 4 <> 3) AS last_intent
FROM conversations GROUP BY 1"""

FOLD = {"max_turns": 5, "recent": 2, "max_tokens": 300, "summary_tokens": 100}


def compact_history(spark, root):
    return sessions.compact_history(_turns(spark, root), **FOLD, block=4)


COMPACT_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text,
         CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS line
  FROM conversations
),
fold AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS texts, CAST([] AS VARCHAR[]) AS lines,
         CAST(NULL AS VARCHAR) AS summary, CAST(0 AS BIGINT) AS compacted
  FROM t
  UNION ALL
  SELECT conv_id, i, texts[drop_n + 1:], lines[drop_n + 1:],
         CASE WHEN drop_n > 0 THEN
           CASE WHEN length(merged) > 400 THEN ltrim(right(merged, 400)) ELSE merged END ELSE summary END,
         compacted + drop_n
  FROM (
    SELECT *, concat_ws(chr(10), summary, array_to_string(lines[1:drop_n], chr(10))) AS merged FROM (
      SELECT *, CAST(CASE WHEN len(texts) > 5 THEN len(texts) - 5
                     WHEN asc_n // 4 + (length(joined) - asc_n) > 300 THEN greatest(len(texts) - 2, 0) ELSE 0 END AS BIGINT) AS drop_n
      FROM (
        SELECT *, array_to_string(texts, chr(10)) AS joined,
               length(regexp_replace(array_to_string(texts, chr(10)), '[^\x00-\x7f]', '', 'g')) AS asc_n
        FROM (SELECT f.conv_id, t.i, list_append(f.texts, t.text) AS texts, list_append(f.lines, t.line) AS lines, f.summary, f.compacted
              FROM fold f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
      )
    )
  )
)
SELECT conv_id AS session_id, i AS turn_count, CAST(len(texts) AS BIGINT) AS retained_turns, compacted AS compacted_turns, summary
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS n FROM fold) WHERE n = 1"""


def session_list(spark, root):
    """Users as sessions last updated by their newest event; a day's time to live."""
    events = table(spark, root, "events")
    updated = events.groupBy(F.col("user_id").alias("session_id")).agg(
        F.max(F.col("ts").cast("timestamp")).alias("updated_at"), F.count(F.lit(1)).alias("turn_count")
    )
    now = events.select(F.max(F.col("ts").cast("timestamp"))).scalar()
    return sessions.recent_sessions(updated, now, ttl_seconds=7200, limit=100).select(
        "session_id", F.date_format("updated_at", TIME).alias("updated_at"), "turn_count"
    )


SESSION_LIST_SQL = """
SELECT session_id, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at, turn_count FROM (
  SELECT user_id AS session_id, max(ts) AS updated_at, count(*) AS turn_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100) u
WHERE epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', u.updated_at)) < 7200"""


def _memories(spark, root):
    turns = _turns(spark, root)
    replies = turns.filter(F.col("role") == "assistant").select(
        "session_id", (F.col("ord") - 1).alias("ord"), F.col("message").alias("reply")
    )
    pairs = turns.filter(F.col("role") == "user").join(replies, ["session_id", "ord"], "left")
    memory = sessions.extract_memory("message", F.col("reply"), fx.PREFERENCE_MARKERS, fx.INTEREST_MARKERS)
    return pairs.select("session_id", "ord", memory.alias("m")).filter(F.col("m").isNotNull()).select(
        sessions.memory_id("session_id", "ord").alias("memory_id"), (F.col("session_id") % 7).alias("owner_id"), "m.*",
        F.col("ord").alias("updated_at"),
    )


def memory_extract(spark, root):
    return _memories(spark, root)


MEMORY_SQL = rf"""memories AS (
  SELECT sha256(conv_id || chr(31) || turn) AS memory_id, conv_id % 7 AS owner_id,
         CASE WHEN length(c) > 240 THEN rtrim(left(c, 237)) || '...' ELSE c END AS content,
         CASE WHEN {fx.sql_any('lower(c0)', fx.INTEREST_MARKERS)} THEN 'topic_interest' ELSE 'preference' END AS memory_type,
         CASE WHEN reply IS NOT NULL AND reply <> '' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS confidence, turn AS updated_at
  FROM (
    SELECT u.conv_id, u.turn, a.text AS reply, regexp_replace(u.text, '^{WS}+|{WS}+$', '', 'g') AS c0,
           trim(regexp_replace(u.text, '{WS}+', ' ', 'g')) AS c
    FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    WHERE u.role = 'user'
  ) WHERE {fx.sql_any('lower(c0)', fx.PREFERENCE_MARKERS)}
)"""
MEMORY_EXTRACT_SQL = f"WITH {MEMORY_SQL} SELECT memory_id, owner_id, content, memory_type, confidence, updated_at FROM memories"


def memory_topk(spark, root):
    """Best memories for the newest user turn of each conversation."""
    newest = (
        _turns(spark, root).filter(F.col("role") == "user").groupBy("session_id").agg(F.max_by("message", "ord").alias("message"))
    )
    queries = newest.select(F.col("session_id").alias("query_id"), (F.col("session_id") % 7).alias("owner_id"), "message")
    found = sessions.top_memories(_memories(spark, root), queries)
    return found.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "memory_id", F.round("score", 4).alias("score")
    )


MEMORY_TOPK_SQL = f"""
WITH {MEMORY_SQL},
q AS (SELECT conv_id AS query_id, conv_id % 7 AS owner_id, arg_max(text, turn) AS message FROM conversations WHERE role = 'user' GROUP BY 1, 2),
qt AS (SELECT query_id, owner_id, list_distinct({sq._terms_sql('message')}) AS terms FROM q),
mt AS (SELECT *, list_distinct({sq._terms_sql('content')}) AS terms FROM memories),
s AS (
  SELECT query_id, memory_id, updated_at, len(list_intersect(qt.terms, mt.terms)) + confidence AS score
  FROM qt JOIN mt USING (owner_id)
)
SELECT query_id, rank, memory_id, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_at DESC, memory_id) AS rank FROM s) WHERE rank <= 3"""


def context_render(spark, root):
    """Request context of each conversation from its folded history and its newest turns."""
    turns = _turns(spark, root)
    state = sessions.compact_history(turns, **FOLD)
    newest = sessions.recent_turns(turns, 2)
    line = F.concat(sessions.speaker("role"), F.lit(": "), F.col("message"))
    lines = newest.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    rendered = sessions.render_context(
        F.lit("and then?"), "summary", turns=F.transform("l", lambda x: x["line"])
    )
    return (
        state.join(lines, "session_id")
        .select("session_id", sessions.fit_budget(rendered, 250).alias("context"))
        .select("session_id", "context", tx.token_estimate("context").alias("tokens"))
    )


CONTEXT_SQL = rf"""
WITH c AS ({COMPACT_SQL}),
l AS (
  SELECT conv_id AS session_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY turn) AS recent
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 2 GROUP BY 1
),
r AS (
  SELECT session_id, CASE WHEN summary IS NOT NULL THEN 'Conversation summary:' || chr(10) || summary || chr(10) || chr(10) ELSE '' END
         || 'Recent turns:' || chr(10) || recent || chr(10) || chr(10) || 'Current user message:' || chr(10) || 'User: and then?' AS full_text
  FROM c JOIN l USING (session_id)
),
e AS (SELECT *, length(regexp_replace(full_text, '[^\x00-\x7f]', '', 'g')) AS a FROM r),
f AS (SELECT session_id, CASE WHEN a // 4 + length(full_text) - a <= 250 OR length(full_text) <= 750 THEN full_text
              ELSE ltrim(right(full_text, 750), ' ' || chr(10)) END AS context FROM e)
SELECT session_id, context,
       CAST(length(regexp_replace(context, '[^\x00-\x7f]', '', 'g')) // 4 + length(context)
            - length(regexp_replace(context, '[^\x00-\x7f]', '', 'g')) AS BIGINT) AS tokens
FROM f"""


def context_memory(spark, root):
    """Request context of each conversation from what is remembered of its owner and its newest turns, and what is routed."""
    best = search.ranked(_memories(spark, root), "owner_id", [F.desc("updated_at"), F.asc("memory_id")], 3, "place")
    known = best.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("place", "content"))).alias("m"))
    line = F.concat(sessions.speaker("role"), F.lit(": "), F.col("message"))
    newest = sessions.recent_turns(_turns(spark, root), 2)
    lines = newest.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    rows = lines.withColumn("owner_id", F.col("session_id") % 7).join(known, "owner_id", "left")
    remembered = F.coalesce(F.transform("m", lambda x: x["content"]), F.array().cast("array<string>"))
    message = F.lit("and then?")
    context = sessions.render_context(message, None, remembered, F.transform("l", lambda x: x["line"]))
    return rows.select("session_id", context.alias("context")).withColumn(
        "routed", sessions.effective_message(message, "context", F.lit(False))
    )


CONTEXT_MEMORY_SQL = rf"""
WITH {MEMORY_SQL},
m AS (
  SELECT owner_id, 'Long-term memory:' || chr(10) || string_agg('- ' || content, chr(10) ORDER BY n) || chr(10) || chr(10) AS listed
  FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC, memory_id) AS n FROM memories) WHERE n <= 3 GROUP BY 1
),
l AS (
  SELECT conv_id AS session_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY turn) AS recent
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 2 GROUP BY 1
)
SELECT session_id, coalesce(listed, '') || 'Recent turns:' || chr(10) || recent || chr(10) || chr(10) || 'Current user message:' || chr(10) || 'User: and then?' AS context,
       CASE WHEN listed IS NOT NULL THEN listed || 'Current user message:' || chr(10) || 'User: and then?' ELSE 'and then?' END AS routed
FROM l LEFT JOIN m ON m.owner_id = session_id % 7"""


def rewrite_gate(spark, root):
    """Messages that hold CJK characters, which alone are rewritten."""
    return _messages(spark, root).select("c_custkey", questions.needs_rewrite("message").alias("rewritten"))


REWRITE_GATE_SQL = rf"""
WITH {MESSAGES_SQL}
SELECT c_custkey, regexp_matches(message, '[\x{{4e00}}-\x{{9fff}}]') AS rewritten FROM messages"""


def intent_route(spark, root):
    fallback = F.expr("CASE session_id % 3 WHEN 0 THEN 'race' WHEN 1 THEN 'news' END")
    return _turns(spark, root).select(
        "session_id", "ord", routing.route("message", fallback, fx.INTENTS).alias("intent"),
        routing.is_follow_up("message", fx.INTENTS).alias("follow_up"),
    )


def _route_sql() -> str:
    text = rf"lower(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'))"
    cases = " ".join(f"WHEN {fx.sql_any('m', fx.INTENTS[name])} THEN '{intent}'" for name, intent in routing.PRECEDENCE)
    domain = [w for name, _ in routing.PRECEDENCE for w in fx.INTENTS[name]]
    return f"""routed AS (
  SELECT conv_id AS session_id, turn AS ord, text, CASE {cases} WHEN fb IS NOT NULL AND follow_up THEN fb ELSE 'general' END AS intent, follow_up
  FROM (SELECT *, NOT {fx.sql_any('m', domain)} AND {fx.sql_any('m', fx.INTENTS['follow_up'])} AS follow_up FROM (
    SELECT *, {text} AS m, CASE conv_id % 3 WHEN 0 THEN 'race' WHEN 1 THEN 'news' END AS fb FROM conversations))
)"""


INTENT_SQL = f"WITH {_route_sql()} SELECT session_id, ord, intent, follow_up FROM routed"


def race_subroute(spark, root):
    fallback = F.expr("CASE session_id % 3 WHEN 0 THEN 'race' WHEN 1 THEN 'news' END")
    routed = _turns(spark, root).withColumn("intent", routing.route("message", fallback, fx.INTENTS))
    return routed.select("session_id", "ord", "intent", routing.plan("intent", "message", fx.RACE_ACTIONS).alias("p")).select(
        "session_id", "ord", "intent", "p.tool_name", "p.action", F.size("p.params").cast("long").alias("param_count")
    )


SUBROUTE_SQL = f"""
WITH {_route_sql()}
SELECT session_id, ord, intent, intent || '_tool' AS tool_name,
       CASE intent WHEN 'news' THEN 'list_recent' WHEN 'regulation' THEN 'ask' WHEN 'strategy' THEN 'analyze' WHEN 'general' THEN 'answer'
         ELSE CASE {' '.join(f"WHEN {fx.sql_any('lower(text)', keys)} THEN '{action}'" for keys, action in fx.RACE_ACTIONS)}
              ELSE 'list_schedule' END END AS action,
       CAST(CASE WHEN intent = 'race' THEN 0 ELSE 1 END AS BIGINT) AS param_count
FROM routed"""


def guard_flags(spark, root):
    return _turns(spark, root).select(
        "session_id", "ord", routing.is_unrelated("message", ["thatin", "ouai"]).alias("unrelated"),
        routing.needs_authority("message", ["now", "rule", "erth", "heit"]).alias("authoritative"),
        routing.is_casual("message").alias("casual"),
        race.wants_session_times("message").alias("session_times"), race.wants_full_schedule("message").alias("full_schedule"),
    )


GUARD_SQL = f"""
SELECT conv_id AS session_id, turn AS ord, {fx.sql_any('lower(text)', ['thatin', 'ouai'])} AS unrelated,
       {fx.sql_any('lower(text)', ['now', 'rule', 'erth', 'heit'])} AS authoritative,
       lower(trim(text)) IN ('hello', 'hi', 'hey') OR {fx.sql_any('lower(text)', vocab.CASUAL_TOKENS)} AS casual,
       {fx.sql_any('lower(text)', vocab.SESSION_TIME_WORDS)} AS session_times,
       {fx.sql_any('lower(text)', vocab.SCHEDULE_WORDS)} AND {fx.sql_any('lower(text)', [*vocab.FULL_LIST_WORDS, *vocab.FULL_SEASON_WORDS])} AS full_schedule
FROM conversations"""


def query_type(spark, root):
    asked = fx.questions(spark, root)
    kind = routing.query_type("question", ["erth", "thon"], ["eroun"], ["ther"], ["thwh", "ndthre"], ["fia"])
    return asked.select("query_id", kind.alias("k")).select("query_id", "k.*")


QUERY_TYPE_SQL = rf"""
WITH {fx.QUESTIONS_SQL},
s AS (SELECT *, CASE WHEN regexp_matches(question, '(?i)section\s*[a-f]') THEN 'Section ' || upper(regexp_extract(question, '(?i)section\s*([a-f])', 1)) END AS sec FROM questions),
k AS (SELECT *, CASE WHEN sec IS NOT NULL AND {fx.sql_any('lower(question)', ['erth', 'thon'])} THEN 1
                     WHEN contains(question, 'eroun') AND contains(question, 'ther') THEN 2
                     WHEN {fx.sql_any('question', ['thwh', 'ndthre'])} OR (contains(lower(question), 'overview') AND contains(lower(question), 'fia')) THEN 3
                     ELSE 4 END AS c FROM s)
SELECT query_id, CASE WHEN c <= 2 THEN 'section_overview' WHEN c = 3 THEN 'document_overview' ELSE 'fact_lookup' END AS query_type,
       CASE c WHEN 1 THEN sec WHEN 2 THEN 'Section C' END AS section
FROM k"""


def answer_status(spark, root):
    """Evidence status and the deterministic answer of every question."""
    retrieved = sq.stages(spark, root)["retrieved"]
    first = retrieved.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("evidence_count"), F.bool_or("strong").alias("strong"),
        F.min_by(F.struct("document_title", "article", "page"), "rank").alias("best"),
    )
    joined = fx.questions(spark, root).join(first, "query_id", "left").select(
        "query_id", "question", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
        F.coalesce("strong", F.lit(False)).alias("strong"), "best",
    )
    status = routing.answer_status(F.lit("fact_lookup"), "evidence_count", "strong")
    partial = answers.partial_answer("best.document_title", "best.article", "best.page")
    fallback = answers.fallback_answer("question", "best.document_title", "best.article", "best.page")
    return joined.select("query_id", "evidence_count", status.alias("s"), F.when(F.col("strong") | (F.col("evidence_count") == 0), fallback).otherwise(partial).alias("answer")).select(
        "query_id", "evidence_count", "s.*", "answer"
    )


ANSWER_STATUS_SQL = f"""
WITH {sq.RERANKED_SQL},
b AS (SELECT query_id, count(*) AS evidence_count, bool_or(strong) AS strong FROM reranked GROUP BY 1),
q AS (SELECT p.query_id, p.question, coalesce(evidence_count, 0) AS evidence_count, coalesce(b.strong, false) AS strong,
             f.document_title, coalesce(f.article, '未识别具体条款') AS art, f.page
      FROM parsed p LEFT JOIN b USING (query_id) LEFT JOIN (SELECT * FROM reranked WHERE rank = 1) f USING (query_id))
SELECT query_id, evidence_count,
       CASE WHEN evidence_count = 0 THEN 'insufficient_evidence' WHEN strong THEN 'answered' ELSE 'partial_evidence' END AS answer_status,
       CASE WHEN strong THEN 'medium' ELSE 'low' END AS confidence, 'regulation_rag' AS source_mode,
       CASE WHEN evidence_count = 0 THEN '未检索到与问题“' || question || '”相关的 FIA 规则证据。为了避免编造规则，我不能基于当前资料给出确定答案。'
            WHEN strong THEN '根据当前检索结果，最相关的依据来自《' || document_title || '》的 ' || art || '（第 ' || page || ' 页）。'
            ELSE '我在当前 FIA 规则索引中找到了可能相关的章节，但证据还不够精确，不能直接下确定结论。 最接近的依据来自 ' || document_title || '，' || art || '，p.' || page
                 || '。 建议把问题再具体到场景、处罚类型或涉及的赛段，我可以继续收窄到更明确的条款。' END AS answer
FROM q"""


def rule_answers(spark, root):
    """Answers of all kinds of questions; a third ask about the whole document, an eighth is beside the subject."""
    asked = fx.questions(spark, root)
    kind = routing.query_type("question", ["erth", "thon"], ["eroun"], ["ther"], ["thwh", "ndthre"], ["fia"])
    judged = rules.judge(asked, kind, F.contains("question", F.lit("ouer")) | (F.col("query_id") % 8 == 7))
    found = rules.ask(judged, sq.stages(spark, root)["retrieved"], fx.corpus(spark, root))
    cited = F.transform("citations", lambda c: F.concat_ws("|", c["document_title"], c["article"], c["section"], c["page"], F.md5(c["content"])))
    return found.withColumn("citations", F.array_join(cited, ";"))


RULE_ANSWERS_SQL = rf"""
WITH {sq.RERANKED_SQL},
typed AS (
  SELECT t.query_id, question, query_type, t.section AS asked_section, contains(question, 'ouer') OR query_id % 8 = 7 AS unrelated
  FROM ({QUERY_TYPE_SQL}) t JOIN questions USING (query_id)
),
six AS (SELECT o.*, c.document_title, c.page, c.content FROM ({sq._overview_sql(6)}) o JOIN corpus c USING (chunk_id)),
evidence AS (
  SELECT query_id, rank, document_title, article, section_code AS section, page, content, true AS strong
  FROM typed JOIN six ON asked_section = section_code WHERE query_type = 'section_overview' AND NOT unrelated
  UNION ALL
  SELECT query_id, dense_rank() OVER (PARTITION BY query_id ORDER BY section_code), document_title, article, section_code, page, content, true
  FROM typed, six WHERE rank = 1 AND query_type = 'document_overview' AND NOT unrelated
  UNION ALL
  SELECT query_id, rank, document_title, article, section_or_title, page, content, strong
  FROM typed JOIN reranked USING (query_id) WHERE query_type = 'fact_lookup' AND NOT unrelated
),
heads AS (
  SELECT query_id, string_agg(article, '；' ORDER BY first_rank) AS topics FROM (
    SELECT query_id, article, first_rank, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS k
    FROM (SELECT query_id, article, min(rank) AS first_rank FROM evidence WHERE article <> '' GROUP BY 1, 2)
  ) WHERE k <= 5 GROUP BY 1
),
per AS (
  SELECT query_id, count(*) AS n, bool_or(strong) AS strong, arg_min(document_title, rank) AS title,
         list(article ORDER BY rank)[1] AS article, arg_min(page, rank) AS page,
         string_agg(concat_ws('|', document_title, article, section, page, md5(content)), ';' ORDER BY rank) AS citations,
         list(section) AS sections
  FROM evidence GROUP BY 1
),
sums AS (SELECT unnest({fx.sql_list(list(vocab.SECTION_SUMMARIES))}) AS section, unnest({fx.sql_list(list(vocab.SECTION_SUMMARIES.values()))}) AS summary),
lines AS (
  SELECT query_id, string_agg(s.section || ': ' || summary, ' ' ORDER BY s.section) AS shown
  FROM (SELECT DISTINCT query_id, section FROM evidence) e JOIN sums s USING (section) GROUP BY 1
),
j AS (SELECT *, coalesce(n, 0) AS evidence_count, coalesce(strong, false) AS sure, coalesce(nullif(article, ''), '未识别具体条款') AS art,
             coalesce(nullif(article, ''), 'section metadata') AS meta
      FROM typed LEFT JOIN per USING (query_id) LEFT JOIN heads USING (query_id) LEFT JOIN lines USING (query_id)
           LEFT JOIN sums s ON s.section = asked_section)
SELECT query_id, query_type, evidence_count,
       CASE WHEN evidence_count = 0 THEN 'insufficient_evidence' WHEN query_type <> 'fact_lookup' OR sure THEN 'answered' ELSE 'partial_evidence' END AS answer_status,
       CASE WHEN evidence_count > 0 AND (query_type <> 'fact_lookup' OR sure) THEN 'medium' ELSE 'low' END AS confidence,
       CASE WHEN query_type <> 'fact_lookup' THEN 'regulation_overview' ELSE 'regulation_rag' END AS source_mode,
       CASE WHEN query_type = 'section_overview' AND evidence_count = 0 THEN '当前索引中没有 ' || asked_section || '，所以不能基于现有资料概括这一部分。'
            WHEN query_type = 'section_overview' THEN asked_section || ' 的定位：' || summary || ' 索引中可见的代表性主题包括：'
              || coalesce(topics, '可从索引中的代表性条款继续追问具体规则。') || '。引用：' || title || '，' || meta || '，p.' || page || '。'
            WHEN query_type = 'document_overview' AND evidence_count = 0 THEN '当前索引中没有可用于概括 2026 FIA F1 Regulations 的 section 数据。'
            WHEN query_type = 'document_overview' THEN '2026 FIA F1 Regulations 当前索引大致分为 Section A-F：' || shown || ' 引用：' || title || '，' || meta || '。'
            WHEN evidence_count = 0 THEN '未检索到与问题“' || question || '”相关的 FIA 规则证据。为了避免编造规则，我不能基于当前资料给出确定答案。'
            WHEN sure THEN '根据当前检索结果，最相关的依据来自《' || title || '》的 ' || art || '（第 ' || page || ' 页）。'
            ELSE '我在当前 FIA 规则索引中找到了可能相关的章节，但证据还不够精确，不能直接下确定结论。 最接近的依据来自 ' || title || '，' || art || '，p.' || page
                 || '。 建议把问题再具体到场景、处罚类型或涉及的赛段，我可以继续收窄到更明确的条款。' END AS answer,
       coalesce(citations, '') AS citations
FROM j"""


def json_recover(spark, root):
    """Event properties inside chatty replies, some of them broken or no object."""
    reply = F.expr(
        """CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('Sure: ', props, ' done') WHEN 2 THEN concat('[', props, ']')
           WHEN 3 THEN substring(props, 2) ELSE concat('{"n": ', props, '} and ', event_type) END"""
    )
    recovered = routing.recover_json(reply)
    return table(spark, root, "events").select(
        "event_id", recovered.isNotNull().alias("ok"),
        F.coalesce(F.get_json_object(recovered, "$.k"), F.get_json_object(recovered, "$.n.k")).cast("long").alias("k"),
    )


JSON_RECOVER_SQL = """
SELECT event_id, event_id % 5 IN (0, 1, 4) AS ok,
       CASE WHEN event_id % 5 IN (0, 1, 4) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k
FROM events"""


def article_id_parse(spark, root):
    message = F.expr(
        """CASE event_id % 6 WHEN 0 THEN concat('Article #', event_id) WHEN 1 THEN concat('rules for news ', event_id)
           WHEN 2 THEN concat('分析新闻', event_id) WHEN 3 THEN concat('news of ', event_type) WHEN 4 THEN concat(event_type, ' ', event_id)
           ELSE concat('Insight on article', user_id) END"""
    )
    return table(spark, root, "events").select("event_id", routing.article_plan(message).alias("p")).select(
        "event_id", "p.article_id", "p.action"
    )


ARTICLE_ID_SQL = """
SELECT event_id, CASE event_id % 6 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN user_id ELSE event_id END AS article_id,
       CASE event_id % 6 WHEN 0 THEN 'get_article' WHEN 1 THEN 'get_rules_analysis' WHEN 2 THEN 'get_insights' WHEN 5 THEN 'get_insights' END AS action
FROM events"""


def plan_validate(spark, root):
    """Model replies written from events: known and unknown actions, with and without an article id."""
    reply = F.expr(
        """concat('plan: {"intent": "', element_at(array('news', 'race', 'regulation', 'weather'), CAST(event_id % 4 AS INT) + 1), '", "action": "',
           element_at(array('get_article', 'list_recent', 'get_next_race', 'ask', 'fly'), CAST(event_id % 5 AS INT) + 1), '", "params": {"article_id": ',
           CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS STRING) ELSE '"x"' END, '}}')"""
    )
    return table(spark, root, "events").select("event_id", routing.validate_plan(reply, "event_type").alias("p")).select(
        "event_id", "p.intent", "p.tool_name", "p.action",
        F.coalesce(F.col("p.params")["article_id"], F.col("p.params")["limit"], F.col("p.params")["question"]).alias("param"),
    )


PLAN_VALIDATE_SQL = """
WITH p AS (SELECT event_id, event_type, (['news', 'race', 'regulation', 'weather'])[event_id % 4 + 1] AS i,
                  (['get_article', 'list_recent', 'get_next_race', 'ask', 'fly'])[event_id % 5 + 1] AS a FROM events),
v AS (SELECT *, (i = 'news' AND a = 'get_article' AND event_id % 3 = 0) OR (i = 'news' AND a = 'list_recent')
             OR (i = 'race' AND a = 'get_next_race') OR (i = 'regulation' AND a = 'ask') AS ok FROM p)
SELECT event_id, CASE WHEN ok THEN i END AS intent, CASE WHEN ok THEN i || '_tool' END AS tool_name, CASE WHEN ok THEN a END AS action,
       CASE WHEN NOT ok THEN NULL WHEN a = 'get_article' THEN CAST(event_id AS VARCHAR) WHEN a = 'list_recent' THEN '5'
            WHEN a = 'ask' THEN event_type END AS param
FROM v"""


def rewrite_parse(spark, root):
    """Rewriter replies written from events."""
    from lectern.operators import questions

    reply = F.expr(
        """CASE event_id % 4 WHEN 0 THEN concat('{"queries": ["', event_type, ' a", " ', event_type, ' a", 7, "b", "c", "d"]}')
           WHEN 1 THEN '{"queries": "none"}' WHEN 2 THEN concat('no json ', event_type) ELSE concat('{"queries": ["", "', user_id, '"]}') END"""
    )
    return table(spark, root, "events").select("event_id", F.array_join(questions.parse_rewrites(reply), "|").alias("queries"))


REWRITE_PARSE_SQL = """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || ' a|b|c' WHEN 3 THEN CAST(user_id AS VARCHAR) ELSE '' END AS queries FROM events"""


def table_counts(spark, root):
    """Counts of all chunks and articles, and the overall health flag."""
    counts = fx.documents(spark, root).agg(F.count("doc_id").alias("chunks"))
    other = table(spark, root, "pages").select(F.count("page_id")).scalar()
    return counts.select("chunks", other.alias("articles")).withColumn("healthy", (F.col("chunks") > 0) & (F.col("articles") > 0))


TABLE_COUNTS_SQL = "SELECT count(doc_id) AS chunks, (SELECT count(page_id) FROM pages) AS articles, true AS healthy FROM documents"


def health_all_ok(spark, root):
    """Whether all events of a user are free of errors."""
    return table(spark, root, "events").groupBy("user_id").agg(F.bool_and(F.col("event_type") != "error").alias("all_ok"))


HEALTH_SQL = "SELECT user_id, bool_and(event_type <> 'error') AS all_ok FROM events GROUP BY 1"


def _cases(spark, root):
    """Golden cases from labels and documents: the text is the answer, the labels decide what was expected."""
    rows = table(spark, root, "labels").join(fx.documents(spark, root), "doc_id")
    doc = F.col("doc_id")
    return rows.select(
        doc.alias("name"), "lang",
        F.lit("regulation").alias("expected_intent"), F.when(F.col("quality") == 1, "regulation").otherwise("news").alias("intent"),
        F.lit("regulation_tool").alias("expected_tool"),
        F.when((F.col("quality") == 1) | (doc % 2 == 0), "regulation_tool").otherwise("news_tool").alias("tool"),
        F.lit("ask").alias("expected_action"), F.when(doc % 9 != 0, "ask").alias("action"),
        F.when(F.col("toxic") == 1, "insufficient_evidence").when(doc % 3 == 0, "answered").alias("expected_status"),
        F.when(doc % 5 == 0, "partial_evidence").when(F.col("toxic") == 1, "insufficient_evidence").otherwise("answered").alias("status"),
        F.array(F.lit("the"), F.lit("of")).alias("must_include"), F.array(F.lit("thatin"), F.lit("Apache")).alias("must_not_include"),
        F.col("text").alias("answer"), F.when(F.col("toxic") == 1, doc % 2).otherwise(doc % 4).alias("evidence_count"),
        F.col("n_chars").cast("double").alias("latency_ms"),
    )


def case_verdict(spark, root):
    return evaluation.case_verdicts(_cases(spark, root)).select(
        "name", "intent_ok", "tool_ok", "action_ok", "answer_ok", "evidence_ok", F.array_join("failures", "; ").alias("failures")
    )


CASES_SQL = """cases AS (
  SELECT doc_id, lang, text, n_chars, quality = 1 AS intent_ok, quality = 1 OR doc_id % 2 = 0 AS tool_ok, doc_id % 9 <> 0 AS action_ok,
         CASE WHEN toxic = 1 THEN 'insufficient_evidence' WHEN doc_id % 3 = 0 THEN 'answered' END AS want,
         CASE WHEN doc_id % 5 = 0 THEN 'partial_evidence' WHEN toxic = 1 THEN 'insufficient_evidence' ELSE 'answered' END AS got,
         CASE WHEN toxic = 1 THEN doc_id % 2 ELSE doc_id % 4 END AS ev,
         list_filter(['the', 'of'], lambda w: NOT contains(text, w)) AS miss, list_filter(['thatin', 'Apache'], lambda w: contains(text, w)) AS pres
  FROM labels JOIN documents USING (doc_id)
),
judged AS (
  SELECT *, want IS NULL OR want = got AS status_ok,
         CASE WHEN want = 'insufficient_evidence' THEN ev = 0 WHEN tool_ok THEN ev > 0 ELSE true END AS evidence_ok
  FROM cases
),
verdicts AS (SELECT *, status_ok AND len(miss) = 0 AND len(pres) = 0 AS answer_ok FROM judged)"""
CASE_VERDICT_SQL = f"""
WITH {CASES_SQL}
SELECT doc_id AS name, intent_ok, tool_ok, action_ok, answer_ok, evidence_ok, concat_ws('; ',
         CASE WHEN NOT intent_ok THEN 'intent expected=regulation actual=news' END,
         CASE WHEN NOT tool_ok THEN 'tool expected=regulation_tool actual=news_tool' END,
         CASE WHEN NOT action_ok THEN 'action expected=ask actual=None' END,
         CASE WHEN NOT status_ok THEN 'answer_status expected=' || want || ' actual=' || got END,
         CASE WHEN len(miss) > 0 THEN 'missing=' || array_to_string(miss, ',') END,
         CASE WHEN len(pres) > 0 THEN 'forbidden_present=' || array_to_string(pres, ',') END,
         CASE WHEN NOT evidence_ok THEN 'evidence_count=' || ev END) AS failures
FROM verdicts"""


def eval_metrics(spark, root):
    verdicts = evaluation.case_verdicts(_cases(spark, root))
    report = evaluation.evaluation_report(verdicts)
    return report.select("cases", *[F.round(c, 6).alias(c) for c in report.columns if c.endswith(("_rate", "_ms"))], "all_passed")


EVAL_SQL = f"""
WITH {CASES_SQL}
SELECT count(*) AS cases, {', '.join(f"round(avg(CAST({p}_ok AS DOUBLE)), 6) AS {p}_rate" for p in ('intent', 'tool', 'action', 'answer', 'evidence'))},
       round(quantile_cont(CAST(n_chars AS DOUBLE), 0.5), 6) AS p50_latency_ms, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.95), 6) AS p95_latency_ms,
       bool_and(intent_ok AND tool_ok AND action_ok AND answer_ok AND evidence_ok) AS all_passed
FROM verdicts"""


def context_enrich(spark, root):
    """Next and previous event and the newest headlines attached to every request; a third bring their own."""
    now = F.lit(NOW).cast("timestamp")
    events = _order_events(spark, root)
    upcoming = race.next_events(events, now).select("event_id").scalar()
    past = race.previous_events(events, now).select("event_id").scalar()
    headlines = articles.recent(fx.page_articles(spark, root), 3).select(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("published_at").isNull().alias("u"), (-F.unix_timestamp("published_at")).alias("t"), (-F.col("id")).alias("i"), "title", "summary"))),
                                 lambda a: F.when(a["summary"] != "", F.concat_ws(": ", a["title"], a["summary"])).otherwise(a["title"])), " / ")
    ).scalar()
    requests = fx.questions(spark, root).select(
        "query_id", F.when(F.col("query_id") % 3 == 0, -F.col("query_id")).alias("next_event_id")
    )
    return answers.enrich(requests, [("next_event_id", upcoming), ("previous_event_id", past), ("headlines", headlines)])


CONTEXT_ENRICH_SQL = f"""
WITH {ORDER_EVENTS_SQL}, {fx.PAGE_ARTICLES_SQL},
h AS (SELECT * FROM page_articles WHERE NOT is_deleted ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 3)
SELECT item_id AS query_id,
       CASE WHEN item_id % 3 = 0 THEN -item_id ELSE (SELECT event_id FROM e WHERE end_date >= TIMESTAMP '{NOW}' ORDER BY start_date, event_id LIMIT 1) END AS next_event_id,
       (SELECT event_id FROM e WHERE end_date < TIMESTAMP '{NOW}' ORDER BY end_date DESC, event_id LIMIT 1) AS previous_event_id,
       (SELECT string_agg(CASE WHEN summary <> '' THEN title || ': ' || summary ELSE title END, ' / ' ORDER BY published_at DESC NULLS LAST, id DESC) FROM h) AS headlines
FROM benchmark"""


def worklist_fill(spark, root):
    """Vectors missing for some rows are filled by a stand-in model; filled ones are kept."""
    rows = table(spark, root, "embeddings").select(
        "vec_id", F.concat(F.lit("text "), F.col("vec_id")).alias("content"),
        F.when(F.col("vec_id") % 4 != 0, F.col("embedding")).alias("embedding"),
    )
    filled = vectors.embed_missing(rows, lambda: lambda texts: [[float(len(t)), 0.5] for t in texts])
    return filled.select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(F.get("embedding", 0).cast("double"), 5).alias("head"))


WORKLIST_FILL_SQL = """
SELECT vec_id, CAST(CASE WHEN vec_id % 4 = 0 THEN 2 ELSE len(embedding) END AS BIGINT) AS width,
       round(CASE WHEN vec_id % 4 = 0 THEN CAST(length('text ' || vec_id) AS DOUBLE) ELSE CAST(embedding[1] AS DOUBLE) END, 5) AS head
FROM embeddings"""


def evidence_context(spark, root):
    """Evidence text per question."""
    built = answers.evidence_context(sq.stages(spark, root)["retrieved"])
    return built.select("query_id", "evidence_count", F.md5("context").alias("context_md5"))


EVIDENCE_SQL = f"""
WITH {sq.RERANKED_SQL}
SELECT query_id, count(*) AS evidence_count,
       md5(string_agg('[片段 ' || rank || ']' || chr(10) || '文档: ' || document_title || chr(10) || '条款: ' || coalesce(article, '未识别条款') || chr(10)
         || '页码: 第 ' || page || ' 页' || chr(10) || '检索分数: ' || printf('%.2f', final) || chr(10) || '内容:' || chr(10) || content, chr(10) || chr(10) ORDER BY rank)) AS context_md5
FROM reranked GROUP BY 1"""

QUERIES = {
    "next_event": next_event,
    "previous_event": previous_event,
    "calendar_parse": calendar_parse,
    "nested_sessions": nested_sessions,
    "display_time": display_time,
    "standings_parse": standings_parse,
    "standings_topn": standings_topn,
    "alias_lookup": alias_lookup,
    "position_parse": position_parse,
    "standings_by_position": standings_by_position,
    "answer_format": answer_format,
    "recent_turns": recent_turns,
    "session_summary": session_summary,
    "compact_history": compact_history,
    "session_list": session_list,
    "memory_extract": memory_extract,
    "memory_topk": memory_topk,
    "context_render": context_render,
    "context_memory": context_memory,
    "rewrite_gate": rewrite_gate,
    "intent_route": intent_route,
    "race_subroute": race_subroute,
    "guard_flags": guard_flags,
    "query_type": query_type,
    "answer_status": answer_status,
    "rule_answers": rule_answers,
    "json_recover": json_recover,
    "article_id_parse": article_id_parse,
    "plan_validate": plan_validate,
    "rewrite_parse": rewrite_parse,
    "table_counts": table_counts,
    "health_all_ok": health_all_ok,
    "case_verdict": case_verdict,
    "eval_metrics": eval_metrics,
    "context_enrich": context_enrich,
    "worklist_fill": worklist_fill,
    "evidence_context": evidence_context,
}
ORACLES = {
    "next_event": NEXT_SQL,
    "previous_event": PREVIOUS_SQL,
    "calendar_parse": CALENDAR_SQL,
    "nested_sessions": NESTED_SQL,
    "display_time": DISPLAY_SQL,
    "standings_parse": STANDINGS_PARSE_SQL,
    "standings_topn": TOPN_SQL,
    "alias_lookup": ALIAS_SQL,
    "position_parse": POSITION_SQL,
    "standings_by_position": BY_POSITION_SQL,
    "answer_format": ANSWER_SQL,
    "recent_turns": RECENT_TURNS_SQL,
    "session_summary": SESSION_SUMMARY_SQL,
    "compact_history": COMPACT_SQL,
    "session_list": SESSION_LIST_SQL,
    "memory_extract": MEMORY_EXTRACT_SQL,
    "memory_topk": MEMORY_TOPK_SQL,
    "context_render": CONTEXT_SQL,
    "context_memory": CONTEXT_MEMORY_SQL,
    "rewrite_gate": REWRITE_GATE_SQL,
    "intent_route": INTENT_SQL,
    "race_subroute": SUBROUTE_SQL,
    "guard_flags": GUARD_SQL,
    "query_type": QUERY_TYPE_SQL,
    "answer_status": ANSWER_STATUS_SQL,
    "rule_answers": RULE_ANSWERS_SQL,
    "json_recover": JSON_RECOVER_SQL,
    "article_id_parse": ARTICLE_ID_SQL,
    "plan_validate": PLAN_VALIDATE_SQL,
    "rewrite_parse": REWRITE_PARSE_SQL,
    "table_counts": TABLE_COUNTS_SQL,
    "health_all_ok": HEALTH_SQL,
    "case_verdict": CASE_VERDICT_SQL,
    "eval_metrics": EVAL_SQL,
    "context_enrich": CONTEXT_ENRICH_SQL,
    "worklist_fill": WORKLIST_FILL_SQL,
    "evidence_context": EVIDENCE_SQL,
}
