"""Lattice scores against sums over all segmentations, word counts against plain ones."""

import math
import zlib
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

from lectern.llm import lattice_lm, queries
from lectern.sources.tables import table

SCHEMA = "doc_id long, text string, lang string, word string, chunk int, score long"
PIECES = lattice_lm.pieces_of(queries.PIECE_BPE)


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lower = lower.replace(space, " ")
    return [w for w in lower.split(" ") if w]


class ByHand:
    def __init__(self, rows):
        train = [words_of(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
        self.counts, self.ends = Counter(w for words in train for w in words), len(train)
        self.total = sum(self.counts.values()) + self.ends
        self.distinct = len(self.counts) + (self.ends > 0)
        model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
        used = Counter()
        for word, count in self.counts.items():
            for one in model.encode(word):
                used[one] += count
        usable = [i for i, p in enumerate(PIECES) if p is not None]
        whole = sum(used[i] for i in usable) + self.ends + 0.5 * (len(usable) + 1)
        self.weights = Counter()
        for i in usable:
            self.weights[PIECES[i]] += (used[i] + 0.5) / whole
        self.end = (self.ends + 0.5) / whole
        self.known = {}

    def probability(self, word):
        """Sum over all segmentations, the rest of each taken after its first piece."""
        if word not in self.known:
            text, memory = ("▁" + word).encode(), {}

            def rest(at):
                if at == len(text):
                    return 1.0
                if at not in memory:
                    stops = range(at + 1, min(len(text), at + 48) + 1)
                    memory[at] = sum(self.weights[text[at:to]] * rest(to) for to in stops if text[at:to] in self.weights)
                return memory[at]

            self.known[word] = math.log10(rest(0))
        return self.known[word]

    def row(self, doc, text):
        words = words_of(text)
        base = sum(math.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1))) for c in [*map(self.counts.__getitem__, words), self.ends])
        known = sum(self.counts[w] > 0 for w in words) + (self.ends > 0)
        score = sum(map(self.probability, words)) + math.log10(self.end)
        held = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1
        return (doc, held, len(words) + 1, known, self.total, base, score)


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def check(found, rows):
    hand = ByHand(rows)
    key = lambda r: str(r[:4])
    expected = sorted((hand.row(d, t) for d, t in rows), key=key)
    assert len(found) == len(expected)
    for got, want in zip(sorted((tuple(r[n] for n in NAMES) for r in found), key=key), expected):
        assert got[:5] == want[:5]
        assert got[5:] == pytest.approx(want[5:], rel=1e-9)


def test_given_documents(spark, root):
    rows = [tuple(r) for r in table(spark, root, "documents").select("doc_id", "text").collect()]
    found = queries.queries()["op13_lattice_lm"](spark, root).collect()
    check(found, rows)
    hand = ByHand(rows)
    held = [w for d, t in rows if zlib.crc32(str(d).encode()) % 5 == 1 for w in words_of(t)]
    unseen = {w for w in held if w not in hand.counts and w[::-1] != w}
    # Pieces tell words that training never saw from the same letters backwards.
    assert sum(map(hand.probability, unseen)) > sum(hand.probability(w[::-1]) for w in unseen)


def test_every_segmentation_of_short_words():
    lattice = lattice_lm.Lattice([b"a", b"b", b"ab", b"\xe2\x96\x81", b"\xe2\x96\x81a", b"ba", *(bytes([i]) for i in range(256))], {0: 5, 2: 3, 4: 1}, 2)
    weights = {p: math.exp(w) for p, w in lattice.table.items() if w <= 0}

    def spelled(text):
        if not text:
            yield 1.0
        for stop in range(1, len(text) + 1):
            if text[:stop] in weights:
                yield from (weights[text[:stop]] * w for w in spelled(text[stop:]))

    for word in ("", "a", "ab", "abab", "bab", "zé"):
        assert lattice.log_probability(word.encode()) == pytest.approx(math.log(sum(spelled(("▁" + word).encode()))))
    long = [lattice.log_probability(b"ab" * n) for n in (10_000, 20_000)]
    assert long[1] < long[0] < 0 and long[1] / long[0] == pytest.approx(2.0, rel=1e-3)
    whole = sum(w for w in weights.values()) + math.exp(lattice.end)
    assert whole == pytest.approx(1.0)


def test_odd_rows(spark, folder):
    texts = [
        None, "", " \t\n", "One", "one ONE oNe", "É é İ", "日本語のテキスト 混ぜ　て", " x y\u0085z \x1c", "▁ ▁a a▁b", "x" * 60,
        "🙂🙂 <unk> <s> </s> <0x41>", "same text", "same text", "same text ", "word " * 5000, "\x00 \x01",
    ]
    rows = [*enumerate(texts), (11, "same text"), (11, "other"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "w", 1, 2) for d, t in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    check(queries.queries()["op13_lattice_lm"](spark, folder).collect(), rows)
    learns = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(True))
    small = lattice_lm.score_documents(docs, queries.PIECE_BPE, learns, chunk_words=3)
    check(small.withColumn("held_out", ~F.col("learns")).collect(), rows)


def test_no_rows_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some words", None, None, None, None)], SCHEMA)
    assert lattice_lm.score_documents(docs.limit(0), queries.PIECE_BPE, F.lit(True)).count() == 0
    row = lattice_lm.score_documents(docs, queries.PIECE_BPE, F.lit(None).cast("boolean")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert row["score"] < 0
