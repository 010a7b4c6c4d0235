"""Best-fit decreasing packing of token sequences.

Pieces of one length are alike to a packer, so the plan needs only how many there are of each length. It is made
on the driver from that histogram, whose size is the capacity and not the corpus: lengths from the longest down, each
into the tightest open sequences that still hold it. A segment tree over remaining capacities finds them, in
logarithmic time. Sequences that were filled alike stay one class, a range of sequence numbers, and a step fills
many of them at once. The result is what best-fit decreasing gives when it takes the pieces one at a time.

Every piece has a rank among those of its length; the plan maps ranks to sequences, in the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import id_and_text, map_batches
from lectern.llm.tokens import encoder
from lectern.session import cut_lineage

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids binary, run int, nth long"


class OpenBins:
    """Classes of open sequences by remaining capacity, under a segment tree of occupied capacities."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.leaves)
        self.classes: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int, full: bool) -> None:
        node = room + self.leaves
        self.tree[node] = full
        while node > 1:
            node >>= 1
            self.tree[node] = self.tree[2 * node] or self.tree[2 * node + 1]

    def add(self, room: int, first: int, count: int) -> None:
        """Open ``count`` sequences from number ``first`` with ``room`` left."""
        if room and count:
            self.classes[room].append((first, count))
            self._mark(room, True)

    def tightest(self, length: int) -> int | None:
        """Smallest remaining capacity of an open sequence that holds ``length``."""
        node = length + self.leaves
        if self.tree[node]:
            return length
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def take(self, room: int) -> tuple[int, int]:
        found = self.classes[room].pop()
        if not self.classes[room]:
            self._mark(room, False)
        return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Returns steps ``(length, rank, each, sequence, offset)``: from ``rank`` on, pieces of ``length`` go ``each``
    to a sequence, from number ``sequence`` on, at ``offset``. A step holds until the next of that length.
    """
    bins, steps, opened = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first = capacity, opened
                each = capacity // length
                count = -(-left // each)
                opened += count
            else:
                first, count = bins.take(room)
                each = room // length
            # A sequence stays the tightest while it holds another piece, so it is filled before the next.
            whole = min(count, left // each)
            steps_at = capacity - room
            if whole:
                steps.append((length, rank, each, first, steps_at))
                bins.add(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if left and whole < count:
                steps.append((length, rank, left, first + whole, steps_at))
                bins.add(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            if whole < count:
                bins.add(room, first + whole, count - whole)
    return steps


def cut_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenised pieces of at most ``capacity`` ids, as a written table.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut. ``run`` is the task that made
    the piece and ``nth`` its number among that task's pieces of the same length. A missing text is an empty one;
    rows without an id are left out; repeated ids stay as often as they come.
    """

    def cut(batches):
        run, seen = TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for doc, raw in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1).to_pylist())):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = raw[at : at + 4 * capacity]
                    nth = seen.get(len(ids), 0)
                    seen[len(ids)] = nth + 1
                    for column, value in zip(columns, (doc, piece, at // 4, len(ids) // 4, ids, nth)):
                        column.append(value)
            doc, piece, start, length, ids, nth = columns
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([run] * len(doc), pa.int32()),
                    pa.array(nth, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids", "run", "nth"],
            )

    return cut_lineage(map_batches(id_and_text(docs, id_col, text_col), cut, PIECES), "pieces")


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that hold ``length``, ``run`` and ``nth``, which go.

    Only per-task counts of each length are summed and joined, so a length that a third of all pieces
    have meets in no task. What reaches the driver is one number a length.
    """
    counts = pieces.groupBy("length", "run").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = np.array(plan(totals, capacity), dtype=np.int64).reshape(-1, 5)
    # Steps sorted by (length, rank) under one key; ranks are below 2**50 and lengths below 2**13 or so.
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    steps = steps[order]
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    joined = pieces.join(firsts, ["length", "run"]).withColumn("_rank", F.col("_first") + F.col("nth"))
    kept = [c for c in pieces.columns if c not in ("run", "nth")]

    def locate(batches):
        lengths, starts = np.unique(steps[:, 0], return_index=True)
        stops = np.append(starts[1:], len(steps))
        for batch in batches:
            length = batch.column(kept.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(len(kept)).to_numpy(zero_copy_only=False)
            found = np.zeros(len(rank), dtype=np.int64)
            for value in np.unique(length):
                here, k = length == value, np.searchsorted(lengths, value)
                span = steps[starts[k] : stops[k], 1]
                found[here] = starts[k] + np.searchsorted(span, rank[here], side="right") - 1
            _, first, each, sequence, offset = steps[found].T
            local = rank - first
            arrays = [batch.column(i) for i in range(len(kept))]
            arrays += [pa.array(sequence + local // each), pa.array(offset + local % each * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", sequence_id long, offset long"
    return map_batches(joined.select(*kept, "_rank"), locate, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, **columns: str) -> DataFrame:
    """Tokenise, cut and place: one row a piece with its ids, sequence and offset. An empty table gives no row."""
    return place_pieces(cut_pieces(docs, tokenizer, end_id, capacity, **columns), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``pieces`` in order of offset, and their ids joined."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.transform("parts", lambda p: F.struct(p["offset"], p["doc_id"], p["piece"])).alias("pieces"),
            F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"])).alias("ids"),
        )
    )
