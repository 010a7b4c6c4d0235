"""Merkle manifest of a dataset whose parents keep hash states.

A node's hash covers its children's digests as hex text, 64 bytes each, which is one SHA-256 block a child. The state
before each child's slot is therefore 32 bytes with nothing pending, and a parent keeps one copied state a slot beside
the digests. Folding a replaced child resumes the state of its slot, takes the replacement and the siblings right of
it, and never reads those to the left.

A tree is cut into blocks of ``SPAN`` leaves, ``LEVELS`` levels high; the nodes above them are the leaves of the next
round's blocks. The blocks are written tables and can be folded at any later time. The steps from a block up to the
root go down with the block, so a fold reads one block, whatever the size of the tree.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_batches, ranked_in_order
from lectern.session import cut_lineage

ARITY = 16
LEVELS = 3
SPAN = ARITY**LEVELS
#: Leaves that one group of a grouped job holds on average; it holds whole blocks.
GROUP_ROWS = 8192

LEVEL_TYPE = "array<struct<digests: binary, states: binary>>"
BLOCK = f"key string, block long, n long, blocks long, digest binary, levels {LEVEL_TYPE}"
PATH_TYPE = "array<struct<state: binary, slot: int, run: binary>>"
PATH = f"key string, idx long, path {PATH_TYPE}"
_PATH_ARROW = pa.list_(pa.struct([("state", pa.binary()), ("slot", pa.int32()), ("run", pa.binary())]))


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**3 <= n else (low, middle - 1)
    return low


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]
#: SHA-256: fractional parts of the square roots of 8 primes and of the cube roots of 64.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], np.uint32)
ROUNDS = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _PRIMES], np.uint32)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """States (8, lanes) after one more block (16, lanes) each."""
    w = list(words)
    a, b, c, d, e, f, g, h = state
    for t, constant in enumerate(ROUNDS):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            near = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))
            far = _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
            w.append(w[t - 16] + near + w[t - 7] + far)
        first = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + constant + w[t]
        second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def hex_words(digests: np.ndarray) -> np.ndarray:
    """Digests (8, lanes) as the blocks (16, lanes) of their hex text."""
    halves = np.stack([digests >> np.uint32(16), digests & np.uint32(0xFFFF)], axis=1).reshape(16, -1)
    spread = ((halves & np.uint32(0xFF00)) << np.uint32(8)) | (halves & np.uint32(0xFF))
    digits = ((spread & np.uint32(0x00F000F0)) << np.uint32(4)) | (spread & np.uint32(0x000F000F))
    letters = ((digits + np.uint32(0x06060606)) >> np.uint32(4)) & np.uint32(0x01010101)
    return digits + np.uint32(0x30303030) + letters * np.uint32(39)


def finish(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests of states that took so many children."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0] = 0x80000000
    last[15] = children * 512
    return compress(state, last)


def unpack(raw: list[bytes]) -> np.ndarray:
    """Packed 32-byte values as (8, lanes)."""
    return np.frombuffer(b"".join(raw), ">u4").astype(np.uint32).reshape(-1, 8).T


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.T).astype(">u4").tobytes()


def parents(digests: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state before each child, and the digest of each run of children."""
    words = hex_words(digests)
    before = np.empty_like(digests)
    state = np.repeat(START[:, None], len(starts), axis=1)
    for slot in range(int(sizes.max(initial=0))):
        runs = np.flatnonzero(sizes > slot)
        before[:, starts[runs] + slot] = state[:, runs]
        state[:, runs] = compress(state[:, runs], words[:, starts[runs] + slot])
    return before, finish(state, sizes)


def resumed(
    values: np.ndarray, states: np.ndarray, slots: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: np.ndarray
) -> np.ndarray:
    """Digests of parents, each with one child replaced by a value; ``words`` holds the runs at ``starts``."""
    state = compress(states, hex_words(values))
    for slot in range(1, ARITY):
        lanes = np.flatnonzero((slot > slots) & (slot < sizes))
        if len(lanes):
            state[:, lanes] = compress(state[:, lanes], words[:, starts[lanes] + slot])
    return finish(state, sizes)


def height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def block_rows(table: pa.Table) -> pa.Table:
    """Blocks of leaves ``(key, idx, n, digest)``; the table holds whole blocks."""
    table = table.sort_by([("key", "ascending"), ("idx", "ascending")])
    keys, idx, ns = table["key"].to_pylist(), table["idx"].to_numpy(), table["n"].to_pylist()
    digests = unpack(table["digest"].to_pylist())
    firsts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1] or idx[i] // SPAN != idx[i - 1] // SPAN]
    high = np.array([min(LEVELS, height(ns[i])) for i in firsts])
    block = np.repeat(np.arange(len(firsts)), np.diff([*firsts, len(keys)]))
    place = idx % SPAN
    levels: list[list[dict]] = [[] for _ in firsts]
    roots: list[bytes] = [b""] * len(firsts)
    for level in range(LEVELS + 1):
        done = high[block] == level
        for at in np.flatnonzero(done):
            roots[block[at]] = pack(digests[:, at : at + 1])
        digests, block, place = digests[:, ~done], block[~done], place[~done]
        if not len(block):
            break
        run = np.flatnonzero(np.diff(block * SPAN + place // ARITY, prepend=-1))
        sizes = np.diff(np.append(run, len(block)))
        states, above = parents(digests, run, sizes)
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        for low, stop in zip(edges, [*edges[1:], len(block)]):
            levels[block[low]].append({"digests": pack(digests[:, low:stop]), "states": pack(states[:, low:stop])})
        digests, block, place = above, block[run], place[run] // ARITY
    return pa.table(
        {
            "key": [keys[i] for i in firsts],
            "block": [int(idx[i]) // SPAN for i in firsts],
            "n": [ns[i] for i in firsts],
            "blocks": [-(-ns[i] // SPAN) for i in firsts],
            "digest": pa.array(roots, pa.binary()),
            "levels": pa.array(levels, pa.list_(pa.struct([("digests", pa.binary()), ("states", pa.binary())]))),
        }
    )


def dealt(rows: DataFrame, block: Column, groups: int) -> DataFrame:
    """Whole blocks over groups of a bounded size on average."""
    return rows.withColumn("part", F.pmod(F.xxhash64("key", block), F.lit(groups)))


def grow(leaves: DataFrame, groups: int) -> list[DataFrame]:
    """Rounds of blocks over ``leaves(key, idx, n, digest)``, each a written table, up to one node a key."""
    rounds = []
    while True:
        grouped = dealt(leaves.select("key", "idx", "n", "digest"), F.floor(F.col("idx") / SPAN), groups)
        blocks = cut_lineage(grouped.groupBy("part").applyInArrow(block_rows, BLOCK), "tree-blocks")
        rounds.append(blocks)
        if (blocks.agg(F.max("blocks")).first()[0] or 0) <= 1:
            return rounds
        leaves = blocks.filter("blocks > 1").select(
            "key", F.col("block").alias("idx"), F.col("blocks").alias("n"), "digest"
        )
        groups = -(-groups // SPAN)


def tops(rounds: list[DataFrame]) -> DataFrame:
    """Columns ``key`` and ``digest`` of what remains of each key."""
    ended = [blocks.filter("blocks = 1").select("key", "digest") for blocks in rounds]
    whole = ended[0]
    for one in ended[1:]:
        whole = whole.unionByName(one)
    return whole


def own_steps(levels: list[dict], place: int) -> list[dict]:
    """Steps of a block's leaf up to the block's node: the state before it, its slot and the digests of its run."""
    steps = []
    for level in levels:
        run = place // ARITY * ARITY
        steps.append(
            {
                "state": level["states"][32 * place : 32 * place + 32],
                "slot": place - run,
                "run": level["digests"][32 * run : 32 * (run + ARITY)],
            }
        )
        place //= ARITY
    return steps


def leaf_paths(blocks: DataFrame) -> DataFrame:
    """Steps to the root of every leaf of ``blocks``, which hold a ``path`` of their own."""

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                count = len(row["levels"][0]["digests"]) // 32 if row["levels"] else 1
                path = row["path"] or []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["key"]] * count, pa.string()),
                        pa.array(range(row["block"] * SPAN, row["block"] * SPAN + count), pa.int64()),
                        pa.array([own_steps(row["levels"], i) + path for i in range(count)], _PATH_ARROW),
                    ],
                    names=["key", "idx", "path"],
                )

    return map_batches(blocks.select("key", "block", "levels", "path"), work, PATH)


def with_paths(rounds: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """The blocks of the first round with their steps up to the root.

    ``above(key, path)`` holds the steps from what remains of a key; without it that is the root.
    """
    lower = None
    for blocks in reversed(rounds):
        last, inner = blocks.filter("blocks = 1"), blocks.filter("blocks > 1")
        if above is None:
            last = last.withColumn("path", F.lit(None).cast(PATH_TYPE))
        else:
            last = last.join(above, "key")
        if lower is not None:
            inner = inner.join(lower.withColumnRenamed("idx", "block"), ["key", "block"])
            last = last.unionByName(inner)
        if blocks is rounds[0]:
            return last
        lower = cut_lineage(leaf_paths(last), "tree-paths")
    raise ValueError("no rounds")


def folds(rows: pa.Table, blocks: pa.Table) -> pa.Table:
    """The root from each row's ``value`` in place of its leaf, and a hash of the leaf's siblings up to the root."""
    held = blocks.to_pylist()
    number = {(b["key"], b["block"]): i for i, b in enumerate(held)}
    idx = rows["idx"].to_numpy()
    lane = np.array([number[key] for key in zip(rows["key"].to_pylist(), (idx // SPAN).tolist())], np.int64)
    values = unpack(rows["value"].to_pylist()).copy()
    place = idx % SPAN
    prints: list[list[bytes]] = [[] for _ in range(len(lane))]

    def step(lanes, states, slots, starts, sizes, digests):
        values[:, lanes] = resumed(values[:, lanes], states, slots, starts, sizes, hex_words(digests))
        text = pack(digests).hex().encode()
        for at, slot, start, size in zip(lanes.tolist(), slots.tolist(), starts.tolist(), sizes.tolist()):
            prints[at] += (text[64 * start : 64 * (start + slot)], text[64 * (start + slot + 1) : 64 * (start + size)])

    for level in range(LEVELS):
        packed = [b["levels"][level] if level < len(b["levels"]) else None for b in held]
        counts = np.array([len(p["digests"]) // 32 if p else 0 for p in packed], np.int64)
        offsets = np.cumsum(counts) - counts
        lanes = np.flatnonzero(counts[lane])
        if not len(lanes):
            break
        states = unpack([p["states"] for p in packed if p])
        digests = unpack([p["digests"] for p in packed if p])
        at, own = place[lanes], lane[lanes]
        run = at // ARITY * ARITY
        sizes = np.minimum(ARITY, counts[own] - run)
        step(lanes, states[:, offsets[own] + at], at - run, offsets[own] + run, sizes, digests)
        place = place // ARITY
    for at in range(max((len(b["path"] or []) for b in held), default=0)):
        steps = [b["path"][at] if at < len(b["path"] or []) else None for b in held]
        counts = np.array([len(s["run"]) // 32 if s else 0 for s in steps], np.int64)
        offsets = np.cumsum(counts) - counts
        there = np.cumsum(counts > 0) - 1
        lanes = np.flatnonzero(counts[lane])
        own = lane[lanes]
        states = unpack([s["state"] for s in steps if s])[:, there[own]]
        slots = np.array([s["slot"] if s else 0 for s in steps], np.int64)[own]
        step(lanes, states, slots, offsets[own], counts[own], unpack([s["run"] for s in steps if s]))
    roots = pack(values).hex()
    out = rows.drop_columns(["part", "idx", "value"])
    out = out.append_column("proof_sha256", pa.array([hashlib.sha256(b"".join(p)).hexdigest() for p in prints]))
    return out.append_column("folded_root", pa.array([roots[64 * i : 64 * i + 64] for i in range(len(prints))]))


@dataclass(frozen=True)
class Manifest:
    """A tree over groups of leaves: every leaf's place, the blocks with their steps to the root, and the tops."""

    leaves: DataFrame
    blocks: DataFrame
    subroots: DataFrame
    root: str | None
    groups: int

    def fold(self, replaced: DataFrame, *carried: str) -> DataFrame:
        """Resume the tree at each row ``(key, idx, value)``; the columns ``carried`` stay beside the results."""
        fields = {f.name: f.dataType.simpleString() for f in replaced.schema.fields}
        schema = ", ".join(f"{name} {fields[name]}" for name in ("key", *carried))
        rows = dealt(replaced.select("key", *carried, "idx", "value"), F.floor(F.col("idx") / SPAN), self.groups)
        blocks = dealt(self.blocks.select("key", "block", "levels", "path"), F.col("block"), self.groups)
        return (
            rows.groupBy("part")
            .cogroup(blocks.groupBy("part"))
            .applyInArrow(folds, f"{schema}, proof_sha256 string, folded_root string")
        )


def counted(*columns: Column) -> Column:
    """Fields one after the other, each with its length in bytes; a missing one is a dash."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.concat(*parts)


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves(key, id, digest, ...)``: a tree a key over the leaves in order of ``id``, then one
    over what remains of the keys in their order.

    Leaves of one key and id come in order of their digests. ``key`` must not be null. An empty table has no root.
    """
    placed = cut_lineage(ranked_in_order(leaves, "key", ["id", "digest"], "n", "idx"), "tree-leaves")
    groups = max(1, -(-placed.count() // GROUP_ROWS))
    rounds = grow(placed, groups)
    subroots = cut_lineage(tops(rounds), "subroots")
    upper = subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest")
    ordered = cut_lineage(ranked_in_order(upper, "key", ["name"], "n", "idx"), "tree-tops")
    over = grow(ordered, max(1, -(-ordered.count() // GROUP_ROWS)))
    top = tops(over).first()
    paths = leaf_paths(with_paths(over)).join(ordered.select("idx", "name"), "idx").select(F.col("name").alias("key"), "path")
    blocks = cut_lineage(with_paths(rounds, cut_lineage(paths, "top-paths")), "tree-manifest")
    return Manifest(placed, blocks, subroots, bytes(top["digest"]).hex() if top else None, groups)


def document_leaves(docs: DataFrame, changed: Column, columns: tuple[str, ...], id_col: str, group_col: str) -> DataFrame:
    """One leaf a row of ``docs``: the hash of its columns with their lengths, and of them with the text ``changed``.

    Every row is a leaf, also one without an id (they come first in their group) and repeated ones. The key is the
    group's name behind a letter, so that rows without a group come first.
    """
    own = [F.col(c) for c in columns]
    other = [changed if c == "text" else F.col(c) for c in columns]
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("")).alias("key"),
        F.col(id_col).cast("long").alias("id"),
        F.unhex(F.sha2(counted(*own), 256)).alias("digest"),
        F.unhex(F.sha2(counted(*other), 256)).alias("value"),
    )
