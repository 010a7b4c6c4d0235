"""Document probabilities from a subword lattice.

The vocabulary is an existing one; its pieces get unigram log-probabilities from how often the tokenizer uses them in
the training documents. A text is a sequence of words and one end. All ways to spell a word from pieces, single bytes
included, form a lattice over its bytes, and a forward recursion in log space sums over every way. No piece reaches
over the mark at the front of a word, so the probability of a whole text is the product of those of its words and the end.

Texts are read once: chunks of bounded size keep their documents as numbers of words beside a table of their distinct
words. Words meet the corpus once a chunk, not once a document, and each distinct word of the corpus has its lattice
summed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_batches
from lectern.session import cut_lineage

#: Words of a chunk, after which it is closed; it holds whole documents.
CHUNK_WORDS = 3_000_000
MARK = "▁"
SMOOTHING = 0.5
CHUNK = "chunk long, doc_id long, learns boolean, ids binary, word binary, code int, learned long"
SCORED = "doc_id long, learns boolean, n_tokens long, n_known long, base_score double, score double"
#: Marks a string that starts a piece without being one; log-probabilities are not positive.
PREFIX = 1.0


def words_of(text: bytes) -> list[bytes]:
    """Runs without ASCII white space, A to Z in lower case."""
    return text.lower().split()


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Documents ``(doc_id, text, learns)`` as chunks: rows of documents, then rows of distinct words."""
    # Of a task's attempts one is written, so its partition and a count name a chunk.
    name = TaskContext.get().partitionId() << 32
    codes: dict[bytes, int] = {}
    docs: list[tuple[int, bool, bytes]] = []
    learned: list[np.ndarray] = []
    held = 0

    def closed():
        nonlocal held, name
        n, m = len(docs), len(codes)
        counts = np.bincount(np.concatenate([np.zeros(0, np.uint32), *learned]), minlength=m)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([name] * (n + m), pa.int64()),
                pa.array([d[0] for d in docs] + [None] * m, pa.int64()),
                pa.array([d[1] for d in docs] + [None] * m, pa.bool_()),
                pa.array([d[2] for d in docs] + [None] * m, pa.binary()),
                pa.array([None] * n + list(codes), pa.binary()),
                pa.array([None] * n + list(range(m)), pa.int32()),
                pa.array([None] * n + counts.tolist(), pa.int64()),
            ],
            names=["chunk", "doc_id", "learns", "ids", "word", "code", "learned"],
        )
        codes.clear(), docs.clear(), learned.clear()
        held, name = 0, name + 1
        return out

    for batch in batches:
        for doc, text, learns in zip(*(c.to_pylist() for c in batch.columns)):
            words = words_of(text)
            ids = np.fromiter([codes.setdefault(w, len(codes)) for w in words], np.uint32, len(words))
            docs.append((doc, learns, ids.astype("<u4").tobytes()))
            if learns:
                learned.append(ids)
            held += len(words) + 1
            if held >= limit:
                yield closed()
    if docs:
        yield closed()


def pieces_of(path: str) -> list[bytes | None]:
    """What each id of a vocabulary spells; none for ids that stand for no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: list[bytes | None] = []
    for one in range(model.get_piece_size()):
        if model.is_byte(one):
            found.append(bytes([int(model.id_to_piece(one)[1:-1], 16)]))
        elif model.is_control(one) or model.is_unknown(one) or model.is_unused(one):
            found.append(None)
        else:
            found.append(model.id_to_piece(one).encode())
    return found


def piece_counts(words: DataFrame, path: str) -> dict[int, int]:
    """How often the tokenizer uses each piece in words ``(word, count)``; as many numbers as the vocabulary at most."""

    def work(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        totals = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            for ids, count in zip(model.encode(texts, num_threads=1), batch.column(1).to_pylist()):
                for one in ids:
                    totals[one] += count
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used])], names=["piece", "count"])

    used = map_batches(words.select("word", "count"), work, "piece long, count long")
    return {r["piece"]: r["count"] for r in used.groupBy("piece").agg(F.sum("count").alias("count")).collect()}


class Lattice:
    """Unigram log-probabilities of pieces and of the end, and the sum over all ways to spell a word."""

    def __init__(self, pieces: list[bytes | None], counts: dict[int, int], ends: int):
        usable = [i for i, p in enumerate(pieces) if p is not None]
        total = sum(counts.get(i, 0) for i in usable) + ends + SMOOTHING * (len(usable) + 1)
        weights: dict[bytes, float] = {}
        for i in usable:
            weights[pieces[i]] = weights.get(pieces[i], 0.0) + (counts.get(i, 0) + SMOOTHING) / total
        self.table = {p[:k]: PREFIX for p in weights for k in range(1, len(p))}
        self.table |= {p: math.log(w) for p, w in weights.items()}
        self.end = math.log((ends + SMOOTHING) / total)

    def log_probability(self, word: bytes) -> float:
        """Natural log of the summed probability of all ways to spell the word."""
        text = MARK.encode() + word
        size, get, log, exp = len(text), self.table.get, math.log, math.exp
        into: list[list[float]] = [[] for _ in range(size + 1)]
        into[0].append(0.0)
        for at in range(size + 1):
            terms = into[at]
            if len(terms) == 1:
                reached = terms[0]
            else:
                top = max(terms)
                reached = top + log(sum([exp(t - top) for t in terms]))
            into[at] = terms = []
            for stop in range(at + 1, size + 1):
                own = get(text[at:stop])
                if own is None:
                    break
                if own <= 0.0:
                    into[stop].append(reached + own)
        return reached


def word_scores(words: DataFrame, lattice: Lattice) -> DataFrame:
    """Add ``logp``, the natural log of each word's probability."""

    def work(batches):
        for batch in batches:
            found = [lattice.log_probability(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=["word", "count", "logp"])

    return map_batches(words.select("word", "count"), work, "word binary, count long, logp double")


def scores(total: int, distinct: int, ends: int, end_logp: float):
    """A function that scores a chunk's documents by its words."""
    whole = total + SMOOTHING * (distinct + 1)

    def work(docs: pa.Table, words: pa.Table) -> pa.Table:
        codes = words["code"].to_numpy()
        counts, logs = np.zeros(len(codes)), np.zeros(len(codes))
        counts[codes], logs[codes] = words["count"].to_numpy(), words["logp"].to_numpy()
        base = np.log10((counts + SMOOTHING) / whole)
        known, logs = counts > 0, logs / math.log(10)
        end = math.log10((ends + SMOOTHING) / whole)
        ids = [np.frombuffer(raw, "<u4") for raw in docs["ids"].to_pylist()]
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "learns": docs["learns"],
                "n_tokens": pa.array([len(i) + 1 for i in ids], pa.int64()),
                "n_known": pa.array([int(known[i].sum()) + (ends > 0) for i in ids], pa.int64()),
                "base_score": pa.array([float(base[i].sum()) + end for i in ids], pa.float64()),
                "score": pa.array([float(logs[i].sum()) + end_logp / math.log(10) for i in ids], pa.float64()),
            }
        )

    return work


def score_documents(
    docs: DataFrame,
    path: str,
    learns: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """Log10 probabilities of every whole text, after learning from the rows where ``learns`` holds.

    ``learns`` is a condition on the table; where it is null the row teaches nothing. Columns: the id, ``learns``,
    ``n_tokens`` (words and the end), ``n_known`` of them seen in training, ``train_tokens``, ``base_score`` (smoothed
    word counts) and ``score`` (the lattice). A missing text is an empty one, which is an end alone. Rows without an id
    and repeated ids are scored like any other. Without training rows all pieces weigh the same.
    """
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
        F.coalesce(learns, F.lit(False)).alias("learns"),
    )
    held = cut_lineage(map_batches(own, lambda batches: chunks(batches, chunk_words), CHUNK), "chunks")
    texts = held.filter("word is null").select("chunk", "doc_id", "learns", "ids")
    words = held.filter("word is not null").select("chunk", "word", "code", "learned")
    counts = cut_lineage(words.groupBy("word").agg(F.sum("learned").alias("count")), "word-counts")
    seen = counts.agg(F.sum("count").alias("n"), F.count_if(F.col("count") > 0).alias("v")).first()
    ends = texts.filter("learns").count()
    total, distinct = (seen["n"] or 0) + ends, seen["v"] + (ends > 0)
    lattice = Lattice(pieces_of(path), piece_counts(counts.filter("count > 0"), path), ends)
    rows = words.join(word_scores(counts, lattice), "word").select(F.col("chunk").alias("part"), "code", "count", "logp")
    found = (
        texts.groupBy("chunk")
        .cogroup(rows.groupBy("part"))
        .applyInArrow(scores(total, distinct, ends, lattice.end), SCORED)
    )
    return found.withColumn("train_tokens", F.lit(total).cast("long"))
