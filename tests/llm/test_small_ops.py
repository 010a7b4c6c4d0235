"""Token files, packing, exact dedup, BPE and quality against brute force."""

import hashlib
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lectern.llm import fuse_dedup, packing, queries, rff_quality, segment_bpe, token_files, tokens
from lectern.llm.common import ranked
from lectern.sources.tables import table

SCHEMA = "doc_id long, text string, lang string, start string, length int, score double"
ODD = [
    None, "", " ", "a", "A a\x1cb\x1d", "it's  we'll\n\nDON'T", "x" * 5000, "日本語のテキスト。 混ぜ mix　wide", "é é Å",
    "a b c\u0085d", "1234567 12.5", "ΑΣ ΣΑΣ", "İstanbul ǅ", "🙂🙂 emoji‍join", "<|endoftext|> x", "\t \r\n ",
    "same text", "same text", "same\ttext ", "word " * 3000, "ﬁ ﬂ ½ ²", "'s 't", "a'sb", " lead", "trail  ", " x ",
]


def odd_docs(spark):
    rows = [(i, t, None, "own", 1, None) for i, t in enumerate(ODD)]
    rows += [rows[16], (None, "no id", "en", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def texts(spark, root):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, root, "documents").select("doc_id", "text").collect()}


def test_chunk_encoder_gives_the_whole_texts_ids(word_bpe):
    small = tokens.ChunkEncoder(queries.WORD_BPE, entries=3)
    for text in ODD:
        for encoder in (small, tokens.encoder(queries.WORD_BPE)):
            assert array("I", encoder.encode([text or ""])[0]).tolist() == word_bpe(text), text


@pytest.mark.parametrize("values", [[], [7], [0, 2**32 - 1, 5], list(range(3000)), [1] * 2000 + [49407] * 60 + [3] * 500])
def test_blocks_round_trip(values):
    ids = np.array(values, dtype=np.uint32)
    blocks = token_files.encode_blocks(ids, 64, 0.9)
    parts = [token_files.decode_block(b) for b in blocks]
    assert np.array_equal(np.concatenate([np.zeros(0, np.uint32), *parts]), ids)


def test_token_files(spark, root, word_bpe):
    rows = sorted(queries.queries()["op1_token_files"](spark, root).collect())
    start = 0
    for row, (doc, text) in zip(rows, sorted(texts(spark, root).items()), strict=True):
        ids = np.array([*word_bpe(text), 1], "<u4")
        assert tuple(row) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_of_odd_rows(spark, folder, word_bpe):
    manifest = token_files.write_token_files(odd_docs(spark), queries.WORD_BPE, 1, folder=folder, file_ids=50, block=16)
    rows = sorted(token_files.read_token_files(manifest).collect())
    assert [r["doc_id"] for r in rows] == sorted([*range(len(ODD)), 16])
    start = 0
    for row in rows:
        assert row["start"] == start
        assert array("I", row["ids"]).tolist() == [*word_bpe(ODD[row["doc_id"]]), 1]
        start += row["n_tokens"]
    whole = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rows])
    for one in manifest.collect():
        part = token_files.TokenFile(one["file"])
        for a in range(0, part.n_ids, 7):
            b = min(part.n_ids, a + 23)
            assert np.array_equal(part.ids(a, b), whole[one["start"] + a : one["start"] + b])


def test_empty_tables(spark, folder):
    none = odd_docs(spark).limit(0)
    manifest = token_files.write_token_files(none, queries.WORD_BPE, 1, folder=folder)
    assert token_files.read_token_files(manifest).count() == 0
    assert packing.pack(none, queries.WORD_BPE, 0).count() == 0
    assert fuse_dedup.deduplicate(none, F.lit(True)).count() == 0
    assert segment_bpe.encode(none, queries.BYTE_BPE, public_tokenizers.PATTERN).count() == 0
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert rff_quality.score_documents(none, labels, "quality", F.lit(True), F.lit(False)).count() == 0


def one_by_one(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fit = [(room, i) for i, room in enumerate(rooms) if room >= length]
        if fit:
            rooms[min(fit)[1]] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    draw = np.random.default_rng(seed)
    lengths = (draw.zipf(1.3, 400) % 50 + 1).tolist() if seed % 2 else draw.integers(1, 65, 300).tolist()
    histogram = {n: lengths.count(n) for n in set(lengths)}
    steps = sorted(packing.plan(histogram, 64))
    rooms = {}
    for i, (length, rank, each, first, offset) in enumerate(steps):
        stop = steps[i + 1][1] if i + 1 < len(steps) and steps[i + 1][0] == length else histogram[length]
        for k in range(stop - rank):
            rooms.setdefault(first + k // each, []).append((offset + k % each * length, length))
    for held in rooms.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
    assert sorted(64 - sum(n for _, n in held) for held in rooms.values()) == one_by_one(lengths, 64)


def check_packing(rows, expected, capacity=2048):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, total in expected.items():
        starts = range(0, total, capacity)
        assert sorted(pieces[doc]) == [(i, s, min(capacity, total - s)) for i, s in enumerate(starts)]
    lengths = [r["length"] for r in rows]
    assert len(bins) == len(one_by_one(lengths, capacity))


def test_packing(spark, root, word_bpe):
    rows = queries.queries()["op3_best_fit_packing"](spark, root).collect()
    ids = {doc: [*word_bpe(text), 0] for doc, text in texts(spark, root).items()}
    check_packing(rows, {doc: len(own) for doc, own in ids.items()})
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(own.tobytes())


def test_sequences_of_odd_rows(spark, word_bpe):
    packed = packing.pack(odd_docs(spark).filter("doc_id is null or doc_id != 16"), queries.WORD_BPE, 0, capacity=32)
    rows = packed.collect()
    check_packing(rows, {i: len(word_bpe(t)) + 1 for i, t in enumerate(ODD) if i != 16}, 32)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]


def dedup_by_hand(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc))
    out = []
    for norm, members in groups.items():
        keep = min(members)[1]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(doc, keep, len(members), doc == keep, sha) for _, doc in members]
    return sorted(out)


@pytest.mark.parametrize("old", [-1, 9, 17, 100])
@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_dedup(spark, old, digest_chars):
    docs = odd_docs(spark)
    found = fuse_dedup.deduplicate(docs, F.col("doc_id") <= old, digest_chars=digest_chars).collect()
    expected = dedup_by_hand([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])
    assert sorted(map(tuple, found)) == expected


def test_fuse_filter():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        made = fuse_dedup.FuseFilter.build(keys)
        assert made.holds(keys).all()
        others = draw.integers(2**63, 2**64, 20_000, dtype=np.uint64)
        assert made.holds(others).mean() < 0.01
        assert len(made.cells) < 1.35 * n + 64


def ids_by_tiktoken():
    coder = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=segment_bpe.read_ranks(queries.BYTE_BPE),
        special_tokens={},
    )
    return coder.encode_ordinary


def test_segment_bpe(spark, root):
    encode = ids_by_tiktoken()
    rows = {r["doc_id"]: r for r in queries.queries()["op9_segment_bpe"](spark, root).collect()}
    for doc, text in texts(spark, root).items():
        ids = np.array(encode(text), "<u4")
        row = rows.pop(doc)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert not rows


def test_segment_bpe_of_odd_texts(spark):
    encode = ids_by_tiktoken()
    small = segment_bpe.SegmentBpe(queries.BYTE_BPE, public_tokenizers.PATTERN, entries=2)
    draw = np.random.default_rng(3)
    letters = list("aabcdeèéß日 '\n1.!") + ["the", "ing", "tion", "  ", "\t"]
    made = ["".join(draw.choice(letters, draw.integers(1, 60))) for _ in range(400)]
    for text in [t or "" for t in ODD] + made:
        for coder in (small, segment_bpe.coder(queries.BYTE_BPE, public_tokenizers.PATTERN)):
            raw = coder.encode([text])[0]
            assert array("I", raw).tolist() == encode(text), repr(text)
            assert coder.decode(raw) == text.encode()
    rows = segment_bpe.encode(odd_docs(spark), queries.BYTE_BPE, public_tokenizers.PATTERN).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted([*range(len(ODD)), 16])


def test_quality_on_held_out_rows(spark, root):
    rows = {r["doc_id"]: r for r in queries.queries()["op10_quality"](spark, root).collect()}
    assert set(rows) == set(texts(spark, root))
    for doc, row in rows.items():
        assert row["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.3)
    labels = {r["doc_id"]: r["quality"] for r in table(spark, root, "labels").collect()}
    held = [d for d in labels if rows[d]["held_out"]]
    good = [rows[d]["score"] for d in held if labels[d] == 1]
    bad = [rows[d]["score"] for d in held if labels[d] == 0]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert wins >= 0.95 * len(good) * len(bad)
    assert sum(s >= 0.3 for s in good) >= 0.97 * len(good)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1), (3, 1), (17, 0), (99, 1), (None, 1), (5, None)], "doc_id long, quality int")
    scored = rff_quality.score_documents(odd_docs(spark), labels, "quality", F.lit(True), F.col("doc_id") == 3)
    assert sorted(r["doc_id"] for r in scored.collect()) == sorted([*range(len(ODD)), 16])
    blank = rff_quality.score_documents(odd_docs(spark), labels.limit(0), "quality", F.lit(True), F.lit(False))
    assert {r["score"] for r in blank.collect()} == {0.5}


def test_isotonic():
    assert rff_quality.isotonic(np.array([1.0, 0, 3, 2]), np.array([2.0, 2, 3, 4])).tolist() == [0.25, 0.25, 5 / 7, 5 / 7]


def test_ranks_have_no_gaps(spark):
    rows = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 7))
    found = ranked(rows, ["k"], ["id"], 5).collect()
    by = {}
    for r in found:
        by.setdefault(r["k"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
