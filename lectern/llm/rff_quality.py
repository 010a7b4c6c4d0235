"""Quality scores from random Fourier features of document statistics.

Statistics of a whole text are standardised and mapped to random cosines, whose inner products approximate a
Gaussian kernel. Every partition sums its share of the normal equations; the driver solves them once, a system as
wide as the features. Scores are then calibrated by isotonic regression over binned scores of rows that the ridge fit
did not see.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_and_text, map_batches
from lectern.session import cut_lineage

FEATURES = 256
RIDGE = 1e-3
BINS = 400
SEED = 20240
#: Standardised statistics are held within this many deviations.
REACH = 5.0
_END = re.compile(r"[.!?]")
_PUNCT = re.compile(r"[^\w\s]")
_DIGIT = re.compile(r"\d")
_UPPER_WORD = re.compile(r"\b[^\W\d_a-z]{2,}\b")
STATISTICS = 16


def statistics(text: str) -> list[float]:
    """Statistics of a whole text; an empty one has zeros throughout."""
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    n, chars = len(words), len(text)
    distinct = set(words)
    lines = text.split("\n")
    repeats = sum(map(str.__eq__, words, words[1:] + [""]))
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    punct = _PUNCT.findall(text)
    ends = len(_END.findall(text))
    bare = sum(map(str.isalnum, words))
    sizes = list(map(len, words))
    lower = text.lower()
    upper = sum(map(str.__ne__, text, lower)) if len(lower) == chars else chars - len(_UPPER_WORD.sub("", text))
    return [
        float(np.log1p(n)),
        float(np.log1p(chars)),
        sum(sizes) / n,
        float(np.std(sizes)),
        len(distinct) / n,
        len(distinct) / n**0.5,
        repeats / n,
        max(counts.values()) / n,
        len(punct) / chars,
        (len(punct) - ends) / n,
        ends / n,
        len(set(punct)) / (1 + len(punct)) ** 0.5,
        upper / chars,
        bare / n,
        len(_DIGIT.findall(text)) / chars,
        1 - len(set(lines)) / len(lines),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id`` and ``stats`` of every whole text."""

    def work(batches):
        for batch in batches:
            stats = [statistics(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"]
            )

    return map_batches(id_and_text(docs, id_col, text_col), work, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class QualityModel:
    """What scoring needs: scaling, random directions, ridge weights and calibration points."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.scale, -REACH, REACH)
        waves = np.cos(scaled @ self.directions + self.phases) * np.sqrt(2 / self.directions.shape[1])
        return np.hstack([waves, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing means of ordered bins, nearest in weighted squares (pool adjacent violators)."""
    pools: list[list[float]] = []
    for total, count in zip(sums.tolist(), counts.tolist()):
        pools.append([total, count, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, count, width = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + count, pools[-1][2] + width]
    return np.concatenate([[total / count] * width for total, count, width in pools])


def matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """Sum ``part(batch)`` over all batches: in partitions, then in as many tasks as the root of their number."""

    def first(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def again(batches):
        total = np.zeros(size)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    partials = cut_lineage(map_batches(rows, first, "total binary"), "sums")
    groups = max(1, int(partials.count() ** 0.5))
    sums = map_batches(partials.repartition(groups), again, "total binary").collect()
    return np.sum([np.frombuffer(row["total"]) for row in sums], axis=0)


def fit(stats: DataFrame, labels: DataFrame, calibrate: Column, features: int = FEATURES) -> QualityModel | None:
    """Fit on ``labels(doc_id, label)``: rows where ``calibrate`` holds set the calibration, the others the weights.

    Without a row of either kind the other kind serves for both; without any label there is no model.
    """
    rows = cut_lineage(
        stats.join(labels.filter("label is not null").groupBy("doc_id").agg(F.avg("label").alias("label")), "doc_id")
        .select("stats", (F.col("label") >= 0.5).cast("double").alias("label"), calibrate.alias("calibrate")),
        "labelled",
    )
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("calibrate").alias("held"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(STATISTICS)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(STATISTICS)],
    ).first()
    if not moments["n"]:
        return None
    mean = np.array([moments[f"m{i}"] for i in range(STATISTICS)])
    scale = np.array([moments[f"s{i}"] for i in range(STATISTICS)])
    draw = np.random.default_rng(SEED)
    model = QualityModel(
        mean,
        np.where(scale > 1e-9, scale, 1.0),
        draw.normal(0, STATISTICS**-0.5, (STATISTICS, features)),
        draw.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1),
        np.zeros(1),
        np.zeros(1),
    )
    width = features + 1
    split = 0 < moments["held"] < moments["n"]
    learn = rows.filter("not calibrate") if split else rows
    check = rows.filter("calibrate") if split else rows

    def equations(batch):
        z = model.features(matrix(batch, 0))
        y = batch.column(1).to_numpy(zero_copy_only=False)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])

    total = summed(learn.select("stats", "label"), equations, width * width + width + 1)
    gram, target = total[: width * width].reshape(width, width), total[width * width : -1]
    weights = np.linalg.solve(gram + RIDGE * total[-1] * np.eye(width), target)
    fitted = QualityModel(mean, model.scale, model.directions, model.phases, weights, np.zeros(1), np.zeros(1))
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def binned(batch):
        at = np.clip(np.searchsorted(edges, fitted.raw(matrix(batch, 0)), side="right") - 1, 0, BINS - 1)
        y = batch.column(1).to_numpy(zero_copy_only=False)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    found = summed(check.select("stats", "label"), binned, 2 * BINS)
    full = np.flatnonzero(found[:BINS])
    centres = (edges[full] + edges[full + 1]) / 2
    levels = isotonic(found[BINS:][full], found[:BINS][full])
    return QualityModel(mean, model.scale, model.directions, model.phases, weights, centres, levels)


def score(stats: DataFrame, model: QualityModel | None) -> DataFrame:
    """Columns ``doc_id`` and ``score`` (0 to 1, higher: better). Without a model every score is 0.5."""

    def work(batches):
        for batch in batches:
            found = model.score(matrix(batch, 1)) if model and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    return map_batches(stats.select("doc_id", "stats"), work, "doc_id long, score double")


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    learn: Column,
    calibrate: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score every whole text after learning from the labelled rows where ``learn`` holds.

    ``learn`` and ``calibrate`` are conditions on ``doc_id``. A missing text is an empty one, and empty texts are
    scored like any other by their statistics, which are zero. Rows without an id are left out, repeated ids stay
    as often as they come, labels of unknown documents and missing labels count for nothing.
    """
    stats = cut_lineage(with_statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
    return score(stats, fit(stats, known.filter(learn), calibrate))
