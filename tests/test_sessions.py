"""Streams of turns in any order, expiry and deletion; evidence scores."""

import os
import random

from pyspark.sql import functions as F

from lectern.operators.answers import fragment
from lectern.operators.sessions import compact_history, fit_budget, render_context
from lectern.streaming import ingest, sessions

TURN = "session_id string, ord long, role string, message string, at timestamp"
LIMITS = {"max_turns": 3, "recent": 2, "max_tokens": 0, "summary_tokens": 100}


def run(spark, folder, files, ttl, delay="0 seconds"):
    """Rows of each file as one micro-batch, in order."""
    for number, rows in enumerate(files):
        data = spark.createDataFrame(rows, "session_id string, ord long, role string, message string, second long")
        path = os.path.join(folder, f"{number:03d}.parquet")
        timed = data.withColumn("at", F.timestamp_seconds("second")).drop("second").toPandas()
        timed["at"] = timed["at"].dt.tz_localize("UTC")
        timed.to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))
    stream = spark.readStream.schema(TURN).option("maxFilesPerTrigger", "1").option("pathGlobFilter", "*.parquet").parquet(folder)
    if ttl is not None:
        stream = stream.withWatermark("at", delay)
    out = os.path.join(folder, "out")
    states = sessions.session_states(stream, **LIMITS, ttl_seconds=ttl)
    ingest.run_available(states, ingest.batch_writer(out), "update", os.path.join(folder, "_progress"))
    return spark.read.parquet(out).drop("batch")


def test_turns_in_any_order_and_twice(spark, folder):
    rows = [(f"s{s}", i, ("user", "assistant")[i % 2], f"m{s}.{i}", i) for s in range(6) for i in range(11)]
    shuffled = rows + rows[::3]
    random.Random(5).shuffle(shuffled)
    states = sessions.sessions_now(run(spark, folder, [shuffled[i::4] for i in range(4)], None)).collect()
    assert len(states) == 6
    for row in states:
        own = [r for r in rows if r[0] == row["session_id"]]
        state = ([], [], None, 0)
        for _, _, role, message, _ in own:
            state = sessions.fold_turn(state, role, message, LIMITS)
        assert (row["seen"], row["turn_count"], row["compacted_turns"], row["summary"]) == (11, 11, state[3], state[2])
        assert [tuple(h) for h in row["history"]] == list(zip(state[0], state[1]))


def test_pauses_timers_and_deletions(spark, folder):
    files = [
        [("a", 0, "user", "a0", 100), ("a", 2, "user", "a2", 130), ("b", 1, "user", "b1", 120), ("d", 0, "user", "d0", 110)],
        [("a", 1, "assistant", "a1", 115), ("b", 0, "user", "b0", 118), ("d", 1, "delete", None, 119), ("d", 2, "user", "d2", 121)],
        [("a", 3, "user", "a3", 1000), ("w", 1, "user", "w1", 1005)],
        [("x", 0, "user", "x0", 9000)],
        [("x", 1, "user", "x1", 9001)],
    ]
    states = run(spark, folder, files, 300, "200 seconds")
    found = {(r["session_id"], r["period"]): r for r in sessions.latest_states(states).collect()}
    told = {k: (r["state"], [h["message"] for h in r["history"]]) for k, r in found.items()}
    assert told[("a", 0)] == ("expired", ["a0", "a1", "a2"])
    assert told[("a", 1)] == ("expired", ["a3"])
    assert told[("b", 0)] == ("expired", ["b0", "b1"])
    assert told[("d", 0)] == ("deleted", ["d0"])
    assert told[("d", 1)] == ("expired", ["d2"])
    # What it waited for never came.
    assert told[("w", 0)] == ("expired", ["w1"])
    assert told[("x", 0)] == ("open", ["x0", "x1"])
    assert [r["session_id"] for r in sessions.sessions_now(states).collect()] == ["x"]


def test_scores_round_their_exact_value(spark):
    scores = [45.125, 45.375, 2.675, 0.125, 1234567.005, -0.125, 3.0, None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, score double")
    shown = rows.select("i", fragment(F.col("i"), F.lit("t"), F.lit("a"), F.lit(1), F.col("score"), F.lit("c")).alias("f"))
    for row in shown.collect():
        score = scores[row["i"]]
        assert ("N/A" if score is None else f"{score:.2f}") in row["f"].split("\n")[4]


CUT = [("s", 0, "user", "a" * 50), ("s", 1, "user", "b" * 393), ("s", 2, "user", "c")]
FOLD = {"max_turns": 1, "recent": 1, "max_tokens": 0, "summary_tokens": 100}


def test_a_cut_between_two_lines_leaves_the_break(spark):
    turns = spark.createDataFrame(CUT, "session_id string, ord long, role string, message string")
    assert compact_history(turns, **FOLD).first().summary == "\nUser: " + "b" * 393


def test_streamed_summaries_leave_the_break():
    state = ([], [], None, 0)
    for _, _, role, message in CUT:
        state = sessions.fold_turn(state, role, message, FOLD)
    assert state[2] == "\nUser: " + "b" * 393


def test_contexts_take_summaries_as_they_are(spark):
    rows = spark.createDataFrame([("\nUser: x ", "\t" + "y" * 750)], "summary string, long string")
    context = rows.select(render_context(F.lit("m"), "summary").alias("c"), fit_budget("long", 1).alias("f")).first()
    assert context.c.startswith("Conversation summary:\n\nUser: x \n\nCurrent") and len(context.f) == 200
    cut = spark.createDataFrame([("z" * 9 + " \n\t" + "y" * 197,)], "long string").select(fit_budget("long", 1).alias("f"))
    assert cut.first().f == "\t" + "y" * 197
