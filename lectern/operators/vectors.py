"""Exact cosine nearest neighbours."""

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import vocab
from lectern.operators.search import ranked
from lectern.session import cut_lineage

# Vectors that a task compares at once, and probes of one pass over the vectors.
VECTOR_BLOCK = 2_048
PROBE_BLOCK = 4_096
# Tasks of all blocks of probes a core; the vectors are cut no finer than this asks for.
TASKS_PER_CORE = 4
# Similarities are compared at this precision, so equal vectors tie and the id decides.
SIMILARITY_DIGITS = 6


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, probe: Column, limit: int = vocab.VECTOR_CANDIDATES) -> DataFrame:
    """Neighbours of one probe (a literal or a scalar subquery): one pass, ``limit`` rows per task survive.

    A vector without direction (all zeros, or none) is near nothing, and a probe without one has no neighbours.
    """
    return (
        vectors.withColumn("_probe", probe)
        .filter((dot(F.col("embedding"), F.col("embedding")) > 0) & (dot(F.col("_probe"), F.col("_probe")) > 0))
        .select("vec_id", F.round(cosine(F.col("embedding"), F.col("_probe")), SIMILARITY_DIGITS).alias("similarity"))
        .orderBy(F.desc("similarity"), F.asc("vec_id"))
        .limit(limit)
    )


def _unit(rows: Iterable) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have a direction, and which rows those are."""
    stacked = np.stack([np.asarray(row, dtype=np.float64) for row in rows])
    norms = np.linalg.norm(stacked, axis=1)
    kept = np.flatnonzero(norms > 0)
    return stacked[kept] / norms[kept, None], kept


def _block_search(names: dict[str, list], probes: np.ndarray, limit: int, block: int):
    """Search of a partition's vectors for one block of probes; ``limit`` rows a probe leave it, under its names."""
    slack = 10.0**-SIMILARITY_DIGITS

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_scores = np.full((len(probes), limit), -np.inf)
        best_ids = np.full((len(probes), limit), np.iinfo(np.int64).max)
        for batch in batches:
            for start in range(0, len(batch), block):
                part = batch.iloc[start : start + block]
                units, kept = _unit(part["embedding"])
                ids = part["vec_id"].to_numpy()[kept]
                scores = probes @ units.T
                # Only probes for which a vector may reach the worst kept one so far have anything to round and sort.
                reached = scores >= best_scores[:, -1:] - slack
                for row in np.flatnonzero(reached.any(axis=1)):
                    near = np.flatnonzero(reached[row])
                    both = np.append(best_scores[row], np.round(scores[row][near], SIMILARITY_DIGITS))
                    both_ids = np.append(best_ids[row], ids[near])
                    order = np.lexsort((both_ids, -both))[:limit]
                    best_scores[row], best_ids[row] = both[order], both_ids[order]
        at, place = np.nonzero(best_scores > -np.inf)
        if len(at):
            named = {name: [values[i] for i in at] for name, values in names.items()}
            yield pd.DataFrame(named | {"vec_id": best_ids[at, place], "similarity": best_scores[at, place]})

    return search


def nearest_many(
    vectors: DataFrame,
    probes: DataFrame,
    limit: int = vocab.VECTOR_CANDIDATES,
    vector_block: int = VECTOR_BLOCK,
    probe_block: int = PROBE_BLOCK,
    keys: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """Neighbours of every ``(query_id, probe)`` in ``(vec_id, embedding)``; ``keys`` name a probe.

    The vectors stay where they lie: every block of probes, of a bounded size, goes to the tasks and takes one pass
    over them, in matrix products. A task hands on at most ``limit`` rows per probe, and those alone are shuffled.
    Vectors and probes without a direction (zero or null) take no part.
    """
    filled = vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = cut_lineage(probes.filter(F.col("probe").isNotNull()).select(*keys, "probe"), "probes")
    blocks = max(1, -(-asked.count() // probe_block))
    # Every task hands on its best for all its probes, so many blocks are not cut much by vectors as well. One part each
    # would make one task of all blocks, since a union of single parts is a single part.
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    filled = filled.coalesce(max(2, -(-TASKS_PER_CORE * cores // blocks)))
    schema = ", ".join(f"{key} {dict(probes.dtypes)[key]}" for key in keys) + ", vec_id long, similarity double"
    partial = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64(*keys), F.lit(blocks)) == block).collect()
        if rows:
            units, kept = _unit(row["probe"] for row in rows)
            names = {key: [rows[i][key] for i in kept] for key in keys}
            found = filled.mapInPandas(_block_search(names, units, limit, vector_block), schema)
            partial = found if partial is None else partial.unionByName(found)
    if partial is None:
        partial = filled.sparkSession.createDataFrame([], schema)
    return ranked(partial, list(keys), [F.desc("similarity"), F.asc("vec_id")], limit, "vector_rank")


def merge_query_lists(lists: DataFrame, limit: int = vocab.VECTOR_CANDIDATES) -> DataFrame:
    """Join the lists of a question's queries in query order, first occurrence of a chunk kept.

    ``lists`` is ``(query_id, query_no, vector_rank, chunk_id)``. The rank among a question's kept rows
    is by (query, rank), so a full first list leaves no room for the others.
    """
    first = lists.groupBy("query_id", "chunk_id").agg(
        F.min(F.struct("query_no", "vector_rank")).alias("place")
    )
    return ranked(first, "query_id", [F.asc("place")], limit, "vector_rank").select(
        "query_id", "chunk_id", "vector_rank"
    )


def embed_missing(
    chunks: DataFrame, embed, text_col: str = "content", overwrite: bool = False, batch: int = 8
) -> DataFrame:
    """Fill ``embedding`` from ``embed(list of texts) -> list of vectors``; filled rows are kept unless overwriting.

    ``embed`` is a factory called once per worker iterator, so a model is loaded once and not per batch.
    """

    @F.pandas_udf("array<float>")
    def vector_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embed()
        for texts in batches:
            values: list = [None] * len(texts)
            todo = [i for i, t in enumerate(texts) if t is not None]
            for start in range(0, len(todo), batch):
                part = todo[start : start + batch]
                for i, vector in zip(part, model([texts.iloc[j] for j in part]), strict=True):
                    values[i] = vector
            yield pd.Series(values)

    if overwrite:
        return chunks.withColumn("embedding", vector_of(F.col(text_col)))
    needed = F.when(F.col("embedding").isNull(), F.col(text_col))
    return chunks.withColumn("embedding", F.coalesce(F.col("embedding"), vector_of(needed)))
