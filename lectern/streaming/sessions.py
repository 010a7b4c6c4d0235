"""Conversation state kept per session over a stream of turns."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern import vocab

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Folded turns so far, the period's number and its turns, what is retained of them, and the time of the last turn.
HEAD = (
    "next long, period long, turns long, roles array<string>, messages array<string>, summary string, compacted long, "
    "last_ms long"
)
EARLY = "role string, message string, at_ms long"
#: Role of a row that deletes what its session holds at that point; it has a number like a turn.
DELETE = "delete"
ASCII = re.compile(r"[^\x00-\x7F]")


def estimated_tokens(text: str) -> int:
    ascii_chars = len(ASCII.sub("", text))
    return max(1, ascii_chars // 4 + len(text) - ascii_chars) if text else 0


def fold_turn(
    state: tuple[list[str], list[str], str | None, int], role: str, message: str, limits: dict
) -> tuple[list[str], list[str], str | None, int]:
    """State after one more turn; turns beyond the limits move into the summary."""
    roles, messages, summary, compacted = state
    roles, messages = [*roles, role], [*messages, message]
    excess = 0
    if len(messages) > limits["max_turns"]:
        excess = len(messages) - limits["max_turns"]
    elif 0 < limits["max_tokens"] < estimated_tokens("\n".join(messages)):
        excess = max(len(messages) - max(1, limits["recent"]), 0)
    if excess:
        folded = [
            f"{'User' if r == 'user' else 'Assistant'}: {' '.join(m.split())}"
            for r, m in zip(roles[:excess], messages[:excess])
        ]
        text = "\n".join(filter(None, [summary, *folded]))
        chars = max(limits["summary_tokens"] * 4, 200)
        summary = text if len(text) <= chars else text[-chars:].lstrip(" ")
    return roles[excess:], messages[excess:], summary, compacted + excess


class SessionFold(StatefulProcessor):
    """Folds each session's turns in the order of their numbers, whatever the order in which they arrive.

    A turn that comes before its predecessors waits in a map by number. A pause longer than the time to live, between
    the times of two turns, ends a period: the next turn starts with an empty history. A timer ends a period that nothing
    follows; turns that still wait then are taken in order, since what they waited for is older than the watermark.
    """

    def __init__(self, limits: dict, ttl_ms: int | None):
        self.limits, self.ttl_ms = limits, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.early = handle.getMapState("early", "ord long", EARLY)

    def close(self) -> None:
        pass

    def load(self) -> None:
        head = self.head.get() if self.head.exists() else (0, 0, 0, [], [], None, 0, None)
        self.next, self.period, self.turns, roles, messages, summary, self.compacted, self.last_ms = head
        self.held = (list(roles), list(messages), summary, self.compacted)

    def clear(self) -> None:
        """An empty history under the number of the next period."""
        self.period, self.turns, self.held, self.last_ms = self.period + 1, 0, ([], [], None, 0), None

    def shown(self, key: tuple, state: str) -> Row:
        roles, messages, summary, compacted = self.held
        return Row(
            session_id=key[0],
            period=self.period,
            state=state,
            seen=self.next,
            turn_count=self.turns,
            retained_turns=len(messages),
            compacted_turns=compacted,
            summary=summary,
            history=[Row(role=r, message=m) for r, m in zip(roles, messages)],
        )

    def take(self, key: tuple, turn: tuple) -> Iterator[Row]:
        """Fold one turn; rows of periods that end before or with it."""
        role, message, at_ms = turn
        paused = None not in (self.ttl_ms, self.last_ms, at_ms) and at_ms - self.last_ms > self.ttl_ms
        if paused and self.turns:
            yield self.shown(key, "expired")
            self.clear()
        self.next += 1
        if role == DELETE:
            yield self.shown(key, "deleted")
            self.clear()
            return
        self.held = fold_turn(self.held, role, message, self.limits)
        self.turns += 1
        self.last_ms = self.last_ms if at_ms is None else at_ms

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.load()
        before = self.last_ms
        latest = None
        for row in rows:
            at_ms = row["at_ms"] if self.ttl_ms is not None else None
            latest = max(filter(None, (latest, at_ms)), default=None)
            turn = (row["role"], row["message"], at_ms)
            if row["ord"] != self.next:
                if row["ord"] > self.next and not self.early.containsKey((row["ord"],)):
                    self.early.updateValue((row["ord"],), turn)
                continue
            yield from self.take(key, turn)
            while self.early.containsKey((self.next,)):
                number = (self.next,)
                yield from self.take(key, self.early.getValue(number))
                self.early.removeKey(number)
        yield from self.save(key)
        if self.ttl_ms is not None and (ends := max(filter(None, (before, latest, self.last_ms)), default=None)):
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(ends + self.ttl_ms)

    def save(self, key: tuple) -> Iterator[Row]:
        roles, messages, summary, compacted = self.held
        self.head.update((self.next, self.period, self.turns, roles, messages, summary, compacted, self.last_ms))
        if self.turns:
            yield self.shown(key, "open")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.load()
        for number in sorted(n for (n,) in self.early.keys()):
            self.next = number
            yield from self.take(key, self.early.getValue((number,)))
        self.early.clear()
        if self.turns:
            yield self.shown(key, "expired")
            self.clear()
        yield from self.save(key)


def session_states(
    turns: DataFrame,
    max_turns: int = vocab.MAX_TURNS,
    recent: int = vocab.RECENT_TURNS,
    max_tokens: int = vocab.COMPACTION_TOKENS,
    summary_tokens: int = vocab.SUMMARY_TOKENS,
    ttl_seconds: int | None = vocab.SESSION_TTL_SECONDS,
) -> DataFrame:
    """State rows of the sessions touched in each micro-batch of ``(session_id, ord, role, message)``.

    ``ord`` counts a session's turns from 0 without gaps, those with the role ``delete`` included, which clear the
    session. Turns may come in any order and more than once. With a time to live there is also ``at``, an event time
    with a watermark. ``state`` is open, expired or deleted, ``period`` counts what expiry and deletion have cut, and
    ``seen`` is the number of folded turns, so the row with the largest one is a period's newest. State holds the
    retained turns and the summary, both bounded, and turns that came early; after expiry only its counters stay.
    """
    spark = turns.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    limits = {"max_turns": max_turns, "recent": recent, "max_tokens": max_tokens, "summary_tokens": summary_tokens}
    id_type = dict(turns.dtypes)["session_id"]
    columns = ["session_id", F.col("ord").cast("long").alias("ord"), "role", "message"]
    if ttl_seconds is not None:
        columns += ["at", F.unix_millis("at").alias("at_ms")]
    return (
        turns.select(*columns)
        .groupBy("session_id")
        .transformWithState(
            SessionFold(limits, None if ttl_seconds is None else ttl_seconds * 1000),
            f"session_id {id_type}, period long, state string, seen long, turn_count long, retained_turns long, "
            "compacted_turns long, summary string, history array<struct<role: string, message: string>>",
            "Update",
            "None" if ttl_seconds is None else "EventTime",
        )
    )


def latest_states(states: DataFrame) -> DataFrame:
    """Newest state row of each session and period; an expired or deleted one comes after the open one of its turns."""
    columns = [c for c in states.columns if c not in ("session_id", "period")]
    order = F.struct("seen", F.col("state") != "open")
    newest = states.groupBy("session_id", "period").agg(F.max_by(F.struct(*columns), order).alias("_s"))
    return newest.select("session_id", "period", "_s.*")


def sessions_now(states: DataFrame) -> DataFrame:
    """What each session holds: its newest period if that is open. Expired and deleted sessions have no row."""
    columns = [c for c in states.columns if c != "session_id"]
    newest = latest_states(states).groupBy("session_id").agg(F.max_by(F.struct(*columns), "period").alias("_s"))
    return newest.select("session_id", "_s.*").filter("state = 'open'")
