"""Cheapest repair of the structure of conversations.

A conversation's edits are a path through a graph with four states (start, after system, after user, after assistant):
keep, rerole or delete a row, or insert an empty row. A path's weight is one integer: the cost in its high digits, below
it one octal digit a letter of the audit, first letter highest, in a fixed width that ends in zeros. The smallest
integer is then the cheapest path, and of those the one whose letters come first.

Runs of ``BLOCK`` rows are solved for each state before and after them. Letters of one price over the same rows are
never a prefix of each other, since what one would have more are inserts that cost, so the smallest paths of
neighbouring runs join to the smallest path of both. Runs join in rounds, and a conversation of any length is spread
over tasks.

No gap between rows needs more than one insert: two of them lead back to the state before, but for those from the start
or after system, where leaving out both, or the system row as well, is cheaper.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_batches, ranked_in_order, spread_out
from lectern.session import cut_lineage

BLOCK = 256
#: Runs that join in one round.
JOINED = 32
SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
MISSING = " "

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = str.maketrans("1234", "DIKR")
STATES = 4
#: State after an inserted or renamed row, by the state before it.
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: State after a kept row, by its initial and the state before it.
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
LEGAL = frozenset(("su", "ua", "au"))
ACCEPTED = (0, 3)

Best = tuple[int, str] | None
Map = list[list[Best]]
RUN = "key string, block long, blocks long, first string, last string, illegal long, costs array<long>, digits array<string>"


def solved(rows: list[tuple[str, int]]) -> Map:
    """The cheapest path over rows ``(initial, fault)`` from each state to each state, from the last row back."""
    width = 2 * len(rows)
    high = 3 * width
    mask = (1 << high) - 1

    def ahead(cost: int, letter: int, rest: int | None) -> int | None:
        """The weight of a path with one letter more in front."""
        if rest is None:
            return None
        low = rest & mask
        return rest - low + (cost << high) + (letter << high - 3) + (low >> 3)

    def least(*weights: int | None) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    best: list[list[int | None]] = [[0 if s == o else None for o in range(STATES)] for s in range(STATES)]
    for initial, fault in reversed(rows):
        late = fault == TRUNCATED
        taken = []
        for state in range(STATES):
            ways = [(3, DELETE, state)]
            if fault not in (BLANK, DUPLICATE):
                ways.append((2 + late, REROLE, NEXT[state]))
                if (initial, state) in KEPT:
                    ways.append((0 + late, KEEP, KEPT[initial, state]))
            taken.append([least(*(ahead(c, d, best[to][o]) for c, d, to in ways)) for o in range(STATES)])
        best = [
            [least(taken[s][o], ahead(2, INSERT, taken[NEXT[s]][o])) for o in range(STATES)] for s in range(STATES)
        ]
    return [[None if w is None else (w >> high, digits_of(w & mask, width)) for w in row] for row in best]


def digits_of(low: int, width: int) -> str:
    return f"{low:o}".zfill(width).rstrip("0") if low else ""


def joined(left: Map, right: Map) -> Map:
    """The cheapest paths over two neighbouring runs."""
    width = sum(max((len(b[1]) for row in m for b in row if b), default=0) for m in (left, right))

    def best(start: int, stop: int) -> Best:
        found = None
        for first, second in zip(left[start], (row[stop] for row in right)):
            if first and second:
                digits = first[1] + second[1]
                weight = (first[0] + second[0] << 3 * width) + int(digits.ljust(width, "0") or "0", 8)
                if found is None or weight < found[0]:
                    found = weight, (first[0] + second[0], digits)
        return found and found[1]

    return [[best(s, o) for o in range(STATES)] for s in range(STATES)]


def finished(paths: Map) -> tuple[int, str]:
    """Cost and letters of the cheapest path from the start to an accepted end, with an insert at the end at most."""
    ends = [paths[0][o] for o in ACCEPTED]
    if paths[0][2]:
        ends.append((paths[0][2][0] + 2, paths[0][2][1] + str(INSERT)))
    width = max(len(e[1]) for e in ends if e)
    cost, digits = min((e for e in ends if e), key=lambda e: (e[0] << 3 * width) + int(e[1].ljust(width, "0") or "0", 8))
    return cost, digits.translate(LETTERS)


def run_table(runs: list[tuple[str, int, int, str, str, int, Map]]) -> pa.RecordBatch:
    flat = [[b for row in run[6] for b in row] for run in runs]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in runs], pa.string()),
            pa.array([r[1] for r in runs], pa.int64()),
            pa.array([r[2] for r in runs], pa.int64()),
            pa.array([r[3] for r in runs], pa.string()),
            pa.array([r[4] for r in runs], pa.string()),
            pa.array([r[5] for r in runs], pa.int64()),
            pa.array([[b and b[0] for b in f] for f in flat], pa.list_(pa.int64())),
            pa.array([[b and b[1] for b in f] for f in flat], pa.list_(pa.string())),
        ],
        names=["key", "block", "blocks", "first", "last", "illegal", "costs", "digits"],
    )


def paths_of(costs: list, digits: list) -> Map:
    flat = [None if c is None else (c, d) for c, d in zip(costs, digits)]
    return [flat[STATES * s : STATES * (s + 1)] for s in range(STATES)]


def solve_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ``(key, block, blocks, initial, fault)``, rows of a run one after the other."""
    run: tuple | None = None
    rows: list[tuple[str, int]] = []

    def closed():
        initials = [i for i, _ in rows]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        return (*run, initials[0], initials[-1], illegal, solved(rows))

    for batch in batches:
        done = []
        for key, block, blocks, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, block, blocks) != run:
                if rows:
                    done.append(closed())
                run, rows = (key, block, blocks), []
            rows.append((initial, fault))
        yield run_table(done)
    if rows:
        yield run_table([closed()])


def join_runs(table: pa.Table) -> pa.Table:
    """One run of all runs of the table, in order of their numbers."""
    runs = table.sort_by("block").to_pylist()
    whole = paths_of(runs[0]["costs"], runs[0]["digits"])
    illegal = sum(r["illegal"] for r in runs)
    for before, run in zip(runs, runs[1:]):
        whole = joined(whole, paths_of(run["costs"], run["digits"]))
        illegal += before["last"] + run["first"] not in LEGAL
    first, last = runs[0], runs[-1]
    blocks = -(-first["blocks"] // JOINED)
    batch = run_table([(first["key"], first["block"] // JOINED, blocks, first["first"], last["last"], illegal, whole)])
    return pa.Table.from_batches([batch])


def digest_of(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Columns ``key, turn, role, text, digest``; a missing role or text is one space, a missing id an empty key."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(MISSING))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(MISSING))
    return rows.select(
        F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("key"),
        F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        digest_of(role, text).alias("digest"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Columns ``key, rank, n, turn, initial, fault`` of all turns; a written table without texts."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    marks = rows.select("key", "turn", "role", "digest", last.alias("last"))
    placed = cut_lineage(ranked_in_order(marks, "key", ["turn", "role", "digest"]), "turns")
    firsts = placed.groupBy("key", "digest").agg(F.min("rank").alias("rank")).select("key", "rank", F.lit(True).alias("new"))
    fault = (
        F.when(F.col("last") == "", BLANK)
        .when(F.col("new").isNull(), DUPLICATE)
        .when(~F.col("last").isin(*ENDS), TRUNCATED)
        .otherwise(0)
    )
    # A rank belongs to one row, so no key of this join is hot.
    found = placed.join(firsts, ["key", "rank"], "left").select(
        "key", "rank", "n", "turn", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault")
    )
    return cut_lineage(found, "turn-faults")


def audits(faults: DataFrame, block: int = BLOCK) -> DataFrame:
    """Columns ``key, cost, audit, illegal``: the cheapest repair of each conversation."""
    rows = faults.select(
        "key",
        F.floor(F.col("rank") / block).alias("block"),
        F.ceil(F.col("n") / block).alias("blocks"),
        "initial",
        "fault",
        "rank",
    )
    dealt = spread_out(rows, "key", "block").sortWithinPartitions("key", "block", "rank").drop("rank")
    runs = cut_lineage(map_batches(dealt, solve_runs, RUN), "runs")
    whole = runs.filter("blocks = 1")
    while (runs.agg(F.max("blocks")).first()[0] or 0) > 1:
        groups = runs.filter("blocks > 1").groupBy("key", F.floor(F.col("block") / JOINED))
        runs = cut_lineage(groups.applyInArrow(join_runs, RUN), "joined-runs")
        whole = whole.unionByName(runs.filter("blocks = 1"))

    def work(batches):
        for batch in batches:
            found = [finished(paths_of(r["costs"], r["digits"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([cost for cost, _ in found], pa.int64()),
                    pa.array([audit for _, audit in found], pa.string()),
                    batch.column(1),
                ],
                names=["key", "cost", "audit", "illegal"],
            )

    return map_batches(
        whole.select("key", "illegal", "costs", "digits"), work, "key string, cost long, audit string, illegal long"
    )


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[str, str]], bool]]:
    """Repaired rows ``(key, [(role, text), ...], last)`` of conversations that come one after the other.

    The first row of a conversation is its audit, its turns follow in order. Nothing but the audit is held.
    """
    key, audit, at, state = None, "", 0, 0

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, NEXT[state]
            yield ROLES[state], ""

    for batch in batches:
        for name, role, text, letters in zip(*(c.to_pylist() for c in batch.columns)):
            if letters is not None:
                if key is not None:
                    yield key, list(inserts()), True
                key, audit, at, state = name, letters, 0, 0
                continue
            out = list(inserts())
            edit, at = audit[at], at + 1
            if edit == "K":
                state = KEPT[role[:1], state]
                out.append((role, text))
            elif edit == "R":
                state = NEXT[state]
                out.append((ROLES[state], text))
            yield key, out, False
    if key is not None:
        yield key, list(inserts()), True


def in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Turns of a conversation behind its audit, in one task as a stream."""
    turns_first = rows.select("key", "role", "text", F.lit(None).cast("string").alias("audit"), "turn", "digest", F.lit(1).alias("_b"))
    heads = found.select(
        "key",
        F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"),
        "audit",
        F.lit(None).cast("long").alias("turn"),
        F.lit(None).cast("string").alias("digest"),
        F.lit(0).alias("_b"),
    )
    both = heads.unionByName(turns_first).repartition("key")
    return both.sortWithinPartitions("key", "_b", "turn", "role", "digest").select("key", "role", "text", "audit")


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations, row by row: ``key, place, role, text``."""

    def work(batches):
        place = 0
        for key, out, last in applied(batches):
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * len(out), pa.string()),
                        pa.array(range(place, place + len(out)), pa.int64()),
                        pa.array([role for role, _ in out], pa.string()),
                        pa.array([text for _, text in out], pa.string()),
                    ],
                    names=["key", "place", "role", "text"],
                )
            place = 0 if last else place + len(out)

    return map_batches(in_order(rows, found), work, "key string, place long, role string, text string")


def repaired_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Columns ``key`` and ``repaired_sha256``, of the lines ``role:text`` of each repaired conversation.

    A hash takes its bytes one after the other, so one task reads a conversation through; it holds no more than a batch.
    """

    def work(batches):
        keys, prints = [], []
        own, started = hashlib.sha256(), False
        for key, out, last in applied(batches):
            for role, text in out:
                own.update(f"{chr(10) if started else ''}{role}:{text}".encode())
                started = True
            if last:
                keys.append(key), prints.append(own.hexdigest())
                own, started = hashlib.sha256(), False
            if len(keys) >= 1024:
                yield pa.RecordBatch.from_pydict({"key": keys, "repaired_sha256": prints})
                keys, prints = [], []
        if keys:
            yield pa.RecordBatch.from_pydict({"key": keys, "repaired_sha256": prints})

    return map_batches(in_order(rows, found), work, "key string, repaired_sha256 string")


def repair(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Per conversation ``key`` its faults, the cheapest repair and a hash of the repaired rows.

    Rows come by turn, missing ones first, those of one turn by role and then by a digest of role and text. A row is
    blank without any character but ASCII white space, else a duplicate if role and text came before, else truncated if
    it ends in no sentence mark. Missing roles and texts are one space. Rows without a conversation form one with an
    empty key. Repeated rows are duplicates. Extra columns go. An empty table has no conversations.
    """
    rows = turns(conversations, conv_col, turn_col, role_col, text_col)
    faults = with_faults(rows)
    found = cut_lineage(audits(faults, block), "audits")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = faults.groupBy("key").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"),
        *[
            F.count_if(F.col("fault") == kind).alias(name)
            for kind, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))
        ],
    )
    return counts.join(found, "key").join(repaired_hashes(rows, found), "key")
