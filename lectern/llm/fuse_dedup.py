"""Exact deduplication with static filters over immutable snapshots.

Texts are compared without ASCII white space. The digests of a snapshot go into binary-fuse filters, one a shard of
bounded size. Digests of an incoming batch are grouped among themselves first and screened by the filters; those
that pass meet the snapshot's exact buckets. Wherever rows share a digest, their texts are compared byte by byte, so
no two different texts are ever merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_and_text
from lectern.session import cut_lineage

#: Distinct digests of one filter, and so the rows of one group that builds or asks it.
SHARD_KEYS = 100_000
SPACES = " \t\n\x0b\x0c\r"


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """Hash 64-bit keys under a seed."""
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


class FuseFilter:
    """Binary-fuse filter of arity three with 8-bit fingerprints: no false negatives, false positives 1 in 256."""

    def __init__(self, seed: int, segment: int, windows: int, cells: np.ndarray):
        self.seed, self.segment, self.windows, self.cells = seed, segment, windows, cells

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Three cells of each hash, in three consecutive segments."""
        start = ((h >> np.uint64(32)) * np.uint64(self.windows)) >> np.uint64(32)
        mask = np.uint64(self.segment - 1)
        base = start * np.uint64(self.segment)
        inside = (h & mask, (h >> np.uint64(13)) & mask, mix(h, 0x9E3779B97F4A7C15) & mask)
        return np.stack([base + np.uint64(k * self.segment) + inside[k] for k in range(3)], axis=1).astype(np.int64)

    @staticmethod
    def prints(h: np.ndarray) -> np.ndarray:
        return mix(h, 0xD6E8FEB86659FD93).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Filter of distinct 64-bit keys."""
        n = max(2, len(keys))
        segment = 1 << max(2, int(np.log(n) / np.log(3.33) + 2.25))
        room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        windows = max(1, int(np.ceil(room / segment)) - 2)
        for seed in range(1, 1000):
            made = cls(seed, segment, windows, np.zeros((windows + 2) * segment, dtype=np.uint8))
            if made._fill(mix(keys, seed)):
                return made
        raise ValueError("keys are not distinct")

    def _fill(self, h: np.ndarray) -> bool:
        """Peel cells that one key alone holds, then set them in reverse order."""
        slots, count = self.slots(h), len(h)
        degree = np.bincount(slots.ravel(), minlength=len(self.cells))
        held = np.zeros(len(self.cells), dtype=np.int64)  # xor of the keys of a cell: the key, once it is alone
        np.bitwise_xor.at(held, slots.ravel(), np.repeat(np.arange(count), 3))
        peeled, left = [], count
        single = np.flatnonzero(degree == 1)
        while len(single):
            keys, first = np.unique(held[single], return_index=True)
            peeled.append((keys, single[first]))
            left -= len(keys)
            touched = slots[keys]
            np.subtract.at(degree, touched.ravel(), 1)
            np.bitwise_xor.at(held, touched.ravel(), np.repeat(keys, 3))
            cells = np.unique(touched)
            single = cells[degree[cells] == 1]
        if left:
            return False
        prints = self.prints(h)
        for keys, cell in reversed(peeled):
            self.cells[cell] = 0
            self.cells[cell] = prints[keys] ^ np.bitwise_xor.reduce(self.cells[slots[keys]], axis=1)
        return True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys, self.seed)
        return np.bitwise_xor.reduce(self.cells[self.slots(h)], axis=1) == self.prints(h)


def keys_of(group: pd.DataFrame) -> np.ndarray:
    return group["key"].to_numpy().view(np.uint64)


def keyed(buckets: DataFrame, shards: int) -> DataFrame:
    """Digests with the 64-bit keys of the filters and their shards."""
    key = F.xxhash64("digest")
    return buckets.select("digest", key.alias("key"), F.pmod(key, F.lit(shards)).cast("long").alias("shard"))


def build_filters(buckets: DataFrame, shards: int) -> DataFrame:
    """Filters of a snapshot's distinct digests: ``shard, seed, segment, windows, cells``."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        made = FuseFilter.build(np.unique(keys_of(group)))
        row = [group["shard"].iloc[0], made.seed, made.segment, made.windows, made.cells.tobytes()]
        return pd.DataFrame([row], columns=["shard", "seed", "segment", "windows", "cells"])

    return (
        keyed(buckets, shards)
        .groupBy("shard")
        .applyInPandas(build, "shard long, seed long, segment long, windows long, cells binary")
    )


def screen(buckets: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Distinct digests that the filters may hold; all that they do hold are among them."""

    def ask(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or found.empty:
            return asked[["digest"]].iloc[:0]
        seed, segment, windows, cells = found[["seed", "segment", "windows", "cells"]].iloc[0]
        held = FuseFilter(seed, segment, windows, np.frombuffer(cells, dtype=np.uint8))
        return asked[["digest"]][held.holds(keys_of(asked))]

    return keyed(buckets, shards).groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(ask, "digest string")


def best() -> F.Column:
    """The row that stays: most code points, then the smallest id."""
    return F.min(F.struct(-F.col("n_chars"), F.col("doc_id")))


def bucketed(rows: DataFrame) -> DataFrame:
    """One row a digest: the row that stays and the size of the group."""
    return rows.groupBy("digest").agg(best().alias("stays"), F.count(F.lit(1)).alias("size"))


def merged(rows: DataFrame) -> DataFrame:
    """Groups over snapshot and batch: ``digest, keep_id, size``."""
    old = cut_lineage(bucketed(rows.filter("in_snapshot")), "snapshot")
    new = cut_lineage(bucketed(rows.filter("not in_snapshot")), "batch")
    shards = max(1, -(-old.count() // SHARD_KEYS), -(-new.count() // SHARD_KEYS))
    suspects = screen(new, build_filters(old, shards), shards)
    meet = suspects.join(old, "digest").select("digest", F.col("stays").alias("old"), F.col("size").alias("n_old"))
    both = new.join(meet, "digest", "left").select(
        "digest",
        F.least("stays", F.coalesce("old", "stays")).alias("stays"),
        (F.col("size") + F.coalesce("n_old", F.lit(0))).alias("size"),
    )
    rest = old.join(meet.select("digest"), "digest", "left_anti")
    return rest.unionByName(both).select("digest", F.col("stays.doc_id").alias("keep_id"), "size")


def deduplicate(
    docs: DataFrame,
    in_snapshot: F.Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest_chars: int = 64,
) -> DataFrame:
    """Group equal texts of a snapshot and an incoming batch; ``in_snapshot`` tells the two apart by ``doc_id``.

    Returns for every row ``doc_id, keep_id, group_size, kept, text_sha256``. Missing texts count as empty, and
    empty texts are equal. A repeated id counts as often as it comes, each row in the group of its own text; rows
    without an id are left out. ``digest_chars`` shortens the digest, which a test uses to force collisions.
    """
    clean = id_and_text(docs, id_col, text_col).withColumn("norm", F.translate("text", SPACES, ""))
    sha = F.sha2(F.col("norm"), 256)
    rows = cut_lineage(
        clean.select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            sha.alias("text_sha256"),
            F.substring(sha, 1, digest_chars).alias("digest"),
            F.coalesce(in_snapshot, F.lit(False)).alias("in_snapshot"),
        ),
        "digests",
    )
    groups = cut_lineage(merged(rows), "groups")
    clash = collisions(clean, rows, groups)
    if not clash.isEmpty():
        # Different texts under one digest: those unlike their group's row that stays get longer digests.
        longer = F.concat_ws("-", "digest", "other")
        told = rows.join(clash, ["doc_id", "text_sha256"], "left").withColumn("digest", longer).drop("other")
        rows = cut_lineage(told, "digests")
        groups = cut_lineage(merged(rows), "groups")
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        F.col("size").alias("group_size"),
        (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def collisions(clean: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows whose text differs from that of the row that stays: ``doc_id, text_sha256`` and a digest that tells them apart.

    Rows of one id are known by their whole hash.
    """
    key = ["doc_id", "text_sha256"]
    shared = rows.join(groups.filter("size > 1"), "digest").select(*key, "digest", "keep_id").distinct()
    own = clean.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "norm")
    texts = cut_lineage(own.join(shared, key), "shared-texts")
    stays = texts.filter("doc_id = keep_id").groupBy("digest").agg(F.min("norm").alias("kept_norm"))
    return (
        texts.join(stays, "digest")
        .filter(F.col("norm") != F.col("kept_norm"))
        .select(*key, F.sha2("norm", 512).alias("other"))
        .distinct()
    )
