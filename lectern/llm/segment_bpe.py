"""Byte-level BPE over segment trees.

A word's tree has a leaf for every byte position. The leaf of a live token holds the rank of the merge with its
right neighbour and the position, so the root is the leftmost merge of the lowest rank. A merge changes three
leaves: the merged token's, its left neighbour's, and that of the token that is gone; each update climbs the tree
in logarithmic time. Many words of like length are encoded together, as rows of one array.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lectern.llm.common import id_and_text, map_batches
from lectern.llm.tokens import WHITE_SPACE

_CHUNK = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
NONE = np.int64(1) << 62
#: Cells of the arrays of words that are encoded together.
CELLS = 1 << 20
#: Entries of a worker's memories of chunks and of words (about 200 bytes each); a full memory starts anew.
CACHE_ENTRIES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class SegmentBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str, entries: int = CACHE_ENTRIES):
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.entries = entries
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [
            (self.ranks[token[:cut]] << 32 | self.ranks[token[cut:]], rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in self.ranks and token[cut:] in self.ranks
        ]
        pairs.sort()
        self.pair_keys = np.array([key for key, _ in pairs] + [1 << 62], dtype=np.int64)
        self.pair_ranks = np.array([rank for _, rank in pairs] + [0], dtype=np.int64)

    def merge_keys(self, left, right, position, width: int):
        """Leaf values: rank and position in one number, or NONE where the pair merges into no token."""
        wanted = left << 32 | right
        at = np.searchsorted(self.pair_keys, wanted)
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at] * width + position, NONE)

    def encode_rows(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Token ids of words of 2 to ``width`` bytes; ``width`` is a power of two."""
        count = len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=count)
        ids = np.zeros((count, width), dtype=np.int64)
        filled = np.arange(width) < sizes[:, None]
        ids[filled] = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        alive = filled.copy()
        after = np.broadcast_to(np.arange(1, width + 1), (count, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (count, width)).copy()
        tree = np.full((count, 2 * width), NONE, dtype=np.int64)
        rows, at = np.nonzero(filled[:, 1:])
        tree[rows, width + at] = self.merge_keys(ids[rows, at], ids[rows, at + 1], at, width)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = tree[:, level : 2 * level].reshape(count, -1, 2).min(axis=2)
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], width)
            gone = after[rows, at]
            follows = after[rows, gone]
            ids[rows, at], alive[rows, gone], after[rows, at] = rank, False, follows
            tree[rows, width + at] = tree[rows, width + gone] = NONE
            some = np.flatnonzero(follows < sizes[rows])
            r, p, f = rows[some], at[some], follows[some]
            before[r, f] = p
            tree[r, width + p] = self.merge_keys(rank[some], ids[r, f], p, width)
            front = before[rows, at]
            some = np.flatnonzero(front >= 0)
            r, p = rows[some], front[some]
            tree[r, width + p] = self.merge_keys(ids[r, p], rank[some], p, width)
            touched = np.concatenate([rows, rows, r])
            node = np.concatenate([at, gone, p]) + width
            while node[0] > 1:
                node >>= 1
                tree[touched, node] = np.minimum(tree[touched, 2 * node], tree[touched, 2 * node + 1])
            rows = rows[tree[rows, 1] < NONE]
        flat, ends = ids[alive], np.cumsum(alive.sum(axis=1))
        return np.split(flat, ends[:-1])

    def encode_words(self, words: list[str]) -> None:
        """Remember the ids of words."""
        by_width: dict[int, list[str]] = {}
        for word in words:
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.words[word] = whole.to_bytes(4, "little")
            else:
                by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append(word)
        for width, group in by_width.items():
            step = max(1, CELLS // width)
            for start in range(0, len(group), step):
                part = group[start : start + step]
                for word, ids in zip(part, self.encode_rows([w.encode() for w in part], width)):
                    self.words[word] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        parts = [_CHUNK.findall(text) for text in texts]
        distinct = set(chain.from_iterable(parts))
        missing = distinct.difference(self.chunks)
        if len(self.chunks) + len(missing) > self.entries:
            self.chunks.clear()
            missing = distinct
        if missing:
            split = {c: self.split(c) for c in missing}
            words = set(chain.from_iterable(split.values()))
            fresh = words.difference(self.words)
            if len(self.words) + len(fresh) > self.entries:
                self.words.clear()
                fresh = words
            self.encode_words(list(fresh))
            of = self.words.__getitem__
            for c, pieces in split.items():
                self.chunks[c] = b"".join(map(of, pieces))
        of = self.chunks.__getitem__
        return [b"".join(map(of, pieces)) for pieces in parts]

    def decode(self, raw: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(raw, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> SegmentBpe:
    """The worker's coder for a rank file; it outlives the task."""
    return SegmentBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every whole text.

    A missing or empty text has no ids; rows without an id are left out; repeated ids stay as often as they come.
    """

    def work(batches):
        for batch in batches:
            ids = coder(path, pattern).encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(raw) // 4 for raw in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "n_tokens", "ids"],
            )

    return map_batches(id_and_text(docs, id_col, text_col), work, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``decoded``, the bytes of the ids of :func:`encode`."""

    def work(batches):
        for batch in batches:
            of = coder(path, pattern).decode
            decoded = pa.array([of(raw) for raw in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=["doc_id", "n_tokens", "ids", "decoded"])

    columns = encoded.select("doc_id", "n_tokens", "ids")
    return map_batches(columns, work, "doc_id long, n_tokens long, ids binary, decoded binary")
