"""Shards by balanced label propagation.

Documents that belong together hang on a common hub: those of equal texts, say, are linked through the hash of the
text. A hub of more documents than a shard should give it is cut into several. Every round the hubs find the shard
where most of their documents are, and the others ask to move there. A shard takes no more than its quota, which is
the number of its documents that hang on nothing, and gives as many of those to shards that lost documents. So
sizes stay even after every round, and the cut links only fall.

If hubs are still in several shards after the rounds, as where few documents hang on nothing, all hubs are placed
whole, the largest first: where most of their documents are if there is room, else in the fullest shard that has room.
A hub is cut only if no shard has room for it. That is true of fewer hubs than there are shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ranked, text_of
from lectern.session import cut_lineage

ROUNDS = 4
#: Rows of one block wherever rows are ranked.
BLOCK_ROWS = 20_000
#: Share of a shard that a piece of a larger group may claim; a group that fits a shard is not cut.
HUB_SHARE = 0.5


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``node``, gapless from 0, to a written table: a task's first number follows those of the tasks before."""
    placed = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()), "nodes")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    first, firsts = 0, []
    for number, size in sizes:
        firsts.append((number, first))
        first += size
    starts = rows.sparkSession.createDataFrame(firsts, "_part long, _first long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn("node", F.col("_first") + inside)
        .drop("_at", "_part", "_first")
    )


def counts_of(state: DataFrame, shards: int, condition: Column | bool = True) -> list[int]:
    held = state.filter(F.lit(True) if condition is True else condition).groupBy("shard").count().collect()
    out = [0] * shards
    for row in held:
        out[row["shard"]] = row["count"]
    return out


def looked_up(values: list[int], index: Column) -> Column:
    """Element of a short list of the driver's, by number."""
    return F.get(F.array(*[F.lit(v).cast("bigint") for v in values]), index)


def propagate(state: DataFrame, shards: int, rounds: int, blocks: int) -> DataFrame:
    """Move the documents of ``node, hub, shard`` towards their hubs' shards; counts of shards do not change.

    Documents whose ``hub`` is null hang on nothing.
    """
    sizes = counts_of(state, shards)
    for number in range(rounds):
        tie = F.xxhash64("hub", "shard", F.lit(number))
        votes = state.filter("hub is not null").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        goals = votes.groupBy("hub").agg(F.max(F.struct("n", tie.alias("tie"), "shard")).alias("top"))
        goals = goals.select("hub", F.col("top.shard").alias("goal"))
        asking = cut_lineage(state.join(goals, "hub").filter("goal != shard").select("node", "goal"), "asking")
        if asking.isEmpty():
            break
        free = counts_of(state, shards, F.col("hub").isNull())
        queue = ranked(asking, ["goal"], ["node"], blocks, "place")
        taken = queue.filter(F.col("place") < looked_up(free, F.col("goal")))
        moved = cut_lineage(
            state.join(taken.select("node", "goal"), "node", "left")
            .withColumn("shard", F.coalesce("goal", "shard"))
            .drop("goal"),
            "moved",
        )
        state = evened(moved, sizes, shards, blocks)
    return state


def evened(state: DataFrame, sizes: list[int], shards: int, blocks: int) -> DataFrame:
    """Give documents that hang on nothing from shards above their size to shards below it."""
    now = counts_of(state, shards)
    over = [max(0, n - size) for n, size in zip(now, sizes)]
    if not sum(over):
        return state
    first = [sum(over[:i]) for i in range(shards)]
    open_places = [(shard, size - n) for shard, (n, size) in enumerate(zip(now, sizes)) if n < size]
    ends = [sum(n for _, n in open_places[: i + 1]) for i in range(len(open_places))]
    loose = ranked(state.filter("hub is null").select("node", "shard"), ["shard"], ["node"], blocks, "place")
    leaving = loose.filter(F.col("place") < looked_up(over, F.col("shard")))
    seat = F.col("place") + looked_up(first, F.col("shard"))
    target = F.size(F.filter(F.array(*[F.lit(e).cast("bigint") for e in ends]), lambda e: e <= seat))
    leaving = leaving.select("node", looked_up([s for s, _ in open_places], target).cast("int").alias("goal"))
    return cut_lineage(
        state.join(leaving, "node", "left").withColumn("shard", F.coalesce("goal", "shard")).drop("goal"), "evened"
    )


def plan_of(counts: dict[tuple[int, int], int], room: list[int]) -> tuple[list[tuple], list[tuple]]:
    """Places of hubs, of which ``counts`` says how many of a size want a shard, in shards with ``room`` for rows.

    Returns ``goal, size, first, last, shard`` for the hubs of a goal and size with these numbers that are placed
    whole, and ``goal, size, number, first, last, shard`` for rows of the others.
    """
    room = list(room)
    whole, cut = [], []
    by_size: dict[int, list[tuple[int, int]]] = {}
    for (goal, size), n in counts.items():
        by_size.setdefault(size, []).append((goal, n))
    unplaced = []
    for size in sorted(by_size, reverse=True):
        left = []
        for goal, n in sorted(by_size[size]):
            stay = min(n, room[goal] // size)
            room[goal] -= stay * size
            if stay:
                whole.append((goal, size, 0, stay, goal))
            if stay < n:
                left.append((goal, stay, n))
        for goal, first, n in left:
            while first < n:
                fitting = [shard for shard, r in enumerate(room) if r >= size]
                if not fitting:
                    unplaced += [(goal, size, number) for number in range(first, n)]
                    break
                shard = min(fitting, key=lambda k: (room[k], k))
                some = min(n - first, room[shard] // size)
                whole.append((goal, size, first, first + some, shard))
                room[shard] -= some * size
                first += some
    for goal, size, number in unplaced:
        first = 0
        while first < size:
            shard = max(range(len(room)), key=lambda k: (room[k], -k))
            some = min(size - first, room[shard])
            cut.append((goal, size, number, first, first + some, shard))
            room[shard] -= some
            first += some
    return whole, cut


def settled(state: DataFrame, shards: int, blocks: int) -> DataFrame:
    """Place all hubs anew, each whole where there is room, if any is in several shards."""
    spark = state.sparkSession
    votes = state.filter("hub is not null").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard"))
    hubs = votes.groupBy("hub").agg(top.alias("top"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("parts"))
    hubs = cut_lineage(hubs.select("hub", F.col("top.shard").alias("goal"), "copies", "parts"), "hubs")
    if hubs.filter("parts > 1").isEmpty():
        return state
    sizes = counts_of(state, shards)
    counts = {(r["goal"], r["copies"]): r["count"] for r in hubs.groupBy("goal", "copies").count().collect()}
    whole, cut = plan_of(counts, sizes)
    numbered_hubs = ranked(hubs.select("hub", "goal", "copies"), ["goal", "copies"], ["hub"], blocks, "number")
    numbered_hubs = cut_lineage(numbered_hubs, "numbered-hubs")
    ranges = spark.createDataFrame(whole, "goal int, copies long, first long, last long, target int")
    targets = numbered_hubs.join(ranges, ["goal", "copies"]).filter("number >= first and number < last")
    moved = state.join(targets.select("hub", "target"), "hub", "left")
    if cut:
        pieces = spark.createDataFrame(
            cut, "goal int, copies long, number long, first long, last long, piece int"
        )
        pieces = numbered_hubs.join(pieces, ["goal", "copies", "number"]).select("hub", "first", "last", "piece")
        rows = state.join(pieces.select("hub").distinct(), "hub", "left_semi").select("hub", "node")
        rows = ranked(rows, ["hub"], ["node"], blocks, "place").join(pieces, "hub")
        rows = rows.filter("place >= first and place < last").select("node", "piece")
        moved = moved.join(rows, "node", "left").withColumn("target", F.coalesce("target", "piece"))
    moved = moved.select("node", "hub", F.coalesce("target", "shard").alias("shard"))
    return evened(cut_lineage(moved, "placed"), sizes, shards, blocks)


def shard_documents(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
) -> DataFrame:
    """Deal all rows into shards whose row counts differ by one at most, keeping equal texts together.

    Returns for every row ``doc_id, size, text_crc32, hub, shard, slot``: ``size`` is the bytes of the text plus 16,
    ``hub`` a hash of the text, ``slot`` its number in the shard. A missing text has no bytes and counts as an empty
    one. Rows without an id and repeated rows are dealt like any other. Where equal texts fill more than a shard,
    as many shards hold nothing else.
    """
    text = text_of(text_col)
    rows = numbered(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.substring(F.sha2(text, 256), 1, 32).alias("text_hash"),
        )
    )
    rows = cut_lineage(rows, "numbered")
    total = rows.count()
    blocks = max(1, total // shards // BLOCK_ROWS)
    whole = max(2, total // shards)
    hubs = rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    pieces = F.when(F.col("copies") <= whole, 1).otherwise(F.ceil(F.col("copies") / max(1, int(whole * HUB_SHARE))).cast("int"))
    piece = F.pmod(F.xxhash64("node"), pieces)
    state = cut_lineage(
        rows.join(hubs, "text_hash", "left").select(
            "node",
            F.when(F.col("copies").isNotNull(), F.concat_ws("/", "text_hash", piece)).alias("hub"),
            F.pmod("node", F.lit(shards)).cast("int").alias("shard"),
        ),
        "state",
    )
    state = settled(propagate(state, shards, rounds, blocks), shards, blocks)
    dealt = ranked(state.select("node", "shard"), ["shard"], ["node"], blocks, "slot")
    return rows.join(dealt, "node").select(
        "doc_id", "size", "text_crc32", F.col("text_hash").alias("hub"), "shard", "slot"
    )
