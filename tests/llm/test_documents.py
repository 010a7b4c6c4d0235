"""Fingerprints and near-duplicate groups against brute force."""

import hashlib
import itertools
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.test_small_ops import ODD, odd_docs, texts

from lectern.llm import queries, setsketch, shingles, syncmers
from lectern.operators.graph import components

SEED = 42


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def hashed(values):
    seed = SEED
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return signed(seed)


def anchors(text):
    units = [hashed([u]) for u in re.findall(syncmers.UNIT, text)]
    pairs = [hashed([a, b]) for a, b in zip(units, units[1:])]
    inner = syncmers.K - syncmers.S + 1
    out = []
    for i in range(len(units) - syncmers.K + 1):
        own = pairs[i : i + inner]
        if min(own) in (own[0], own[-1]):
            out.append(hashed(units[i : i + syncmers.K]) & 0xFFFFFFFF)
    if not out and units:
        out = [hashed(units) & 0xFFFFFFFF]
    return out


def likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(rows, docs):
    order = sorted(docs, reverse=True)
    for k, doc in enumerate(order):
        text, following = docs[doc], docs[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = rows[doc]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == "-".join(f"{a:X}" for a in anchors(text))
        assert row["edited_fingerprint"] == "-".join(f"{a:X}" for a in anchors(edited))
        assert row["near_edited"] == pytest.approx(likeness(anchors(text), anchors(edited)))
        assert row["near_next"] == pytest.approx(likeness(anchors(text), anchors(following)))


def digest(found):
    return {
        r["doc_id"]: r
        for r in found.select(
            "doc_id",
            "n_chars",
            F.sha2("edited_text", 256).alias("edited_sha256"),
            syncmers.printed("anchors").alias("fingerprint"),
            syncmers.printed("edited_anchors").alias("edited_fingerprint"),
            "near_edited",
            "near_next",
        ).collect()
    }


def test_fingerprints(spark, root):
    rows = {r["doc_id"]: r for r in queries.queries()["op4_syncmers"](spark, root).collect()}
    docs = texts(spark, root)
    assert len(rows) == len(docs)
    check_fingerprints(rows, docs)


@pytest.mark.parametrize("part_bytes", [200, 1 << 20])
def test_fingerprints_of_odd_texts(spark, part_bytes):
    docs = odd_docs(spark).dropDuplicates(["doc_id"])
    rows = digest(syncmers.fingerprints(docs, part_bytes=part_bytes))
    check_fingerprints(rows, {i: t or "" for i, t in enumerate(ODD)})


def test_fingerprints_of_one_none_and_repeated_rows(spark):
    docs = odd_docs(spark)
    check_fingerprints(digest(syncmers.fingerprints(docs.filter("doc_id = 19"))), {19: ODD[19]})
    assert syncmers.fingerprints(docs.limit(0)).count() == 0
    assert syncmers.fingerprints(docs, part_bytes=100).count() == len(ODD) + 1


def test_fingerprints_run_no_python(spark, root):
    plan = queries.queries()["op4_syncmers"](spark, root)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def grams(text, width=4):
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def groups_by_hand(docs, percent=80, words=4):
    sets = {doc: grams(text, words) for doc, text in docs.items()}
    top = {doc: doc for doc in docs}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    held = {}
    for doc in sorted(sets):
        shared = Counter(other for gram in sets[doc] for other in held.get(gram, ()))
        for other, both in shared.items():
            if 100 * both >= percent * (len(sets[doc]) + len(sets[other]) - both):
                a, b = find(doc), find(other)
                top[max(a, b)] = min(a, b)
        for gram in sets[doc]:
            held.setdefault(gram, []).append(doc)
    return {doc: (len(sets[doc]), find(doc)) for doc in docs}


def made_docs():
    draw = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, n = {}, 0
    for size in (6, 20, 60, 300, 900):
        for _ in range(6):
            base = draw.choice(vocabulary, size).tolist()
            for edits in (0, 0, 1, 2, 3, 5, 8, 13):
                own = list(base)
                for at in draw.integers(0, size, edits):
                    own[at] = str(draw.choice(vocabulary))
                docs[n] = " ".join(own)
                n += 1
    # A chain: each text is near its neighbour only.
    base = draw.choice(vocabulary, 200).tolist()
    for step in range(12):
        docs[n] = "\n".join(base[step * 10 : step * 10 + 100]).title()
        n += 1
    # A passage that many texts share, too short to link them.
    passage = draw.choice(vocabulary, 120).tolist()
    for _ in range(60):
        docs[n] = " ".join(passage + draw.choice(vocabulary, 60).tolist())
        n += 1
    for text in ODD:
        docs[n] = text
        n += 1
    return docs


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(setsketch, "BLOCK", block)
    docs = made_docs()
    table = spark.createDataFrame([(d, t, 1) for d, t in docs.items()], "doc_id long, text string, rep int")
    found = setsketch.near_duplicates(table).collect()
    expected = groups_by_hand(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_of_the_table(spark, root):
    rows = queries.queries()["op5_setsketch"](spark, root).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == groups_by_hand(texts(spark, root))


def test_near_duplicates_of_few_and_repeated_rows(spark):
    docs = odd_docs(spark)
    assert setsketch.near_duplicates(docs.limit(0)).count() == 0
    rows = setsketch.near_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted([*range(len(ODD)), 16])
    assert {r["component_id"] for r in rows if r["doc_id"] in (16, 17)} == {16}
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)


@pytest.mark.parametrize("percent", [90, 100])
def test_near_duplicates_above_the_percent_of_the_bands(spark, percent):
    docs = made_docs()
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = setsketch.near_duplicates(table, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == groups_by_hand(docs, percent)


def test_near_duplicates_below_the_percent_of_the_bands(spark):
    docs = odd_docs(spark)
    with pytest.raises(ValueError):
        setsketch.near_duplicates(docs, percent=50)


def test_shingle_sets_of_a_slice():
    array = pa.array(["one two", *[t or "" for t in ODD], "last words of all"])
    whole = shingles.shingle_sets(array, 4)
    assert [len(s) for s in whole[1:-1]] == [len(grams(t)) for t in ODD]
    part = shingles.shingle_sets(array[3:9], 4)
    assert all(np.array_equal(a, b) for a, b in zip(part, whole[3:9]))


@pytest.mark.parametrize("size", [3, 40, 500, 4000])
def test_estimates(size):
    draw = np.random.default_rng(size)
    for share in (0.0, 0.5, 0.8, 0.95):
        both = round(2 * size * share / (1 + share))
        errors, fine = [], []
        for _ in range(8):
            pool = draw.integers(0, 2**63, 2 * size - both).astype(np.uint64)
            a, b = np.sort(pool[:size]), np.sort(pool[size - both :])
            p, q = setsketch.sketches([a, b])
            true = both / (2 * size - both)
            n = np.array([float(size)])
            errors.append(setsketch.likelihood_estimate(p[None], q[None], n, n)[0] - true)
            p, q = setsketch.sketches([a, b], setsketch.FINE_REGISTERS)
            fine.append(setsketch.likelihood_estimate(p[None], q[None], n, n)[0] - true)
        assert abs(np.mean(errors)) < 0.04 and np.max(np.abs(errors)) < setsketch.SLACK + 0.05
        assert np.max(np.abs(fine)) < setsketch.FINE_SLACK + 0.03


def test_sketches_merge():
    draw = np.random.default_rng(2)
    a, b = (np.unique(draw.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(2))
    one, two, both = setsketch.sketches([a, b, np.union1d(a, b)])
    assert np.array_equal(np.maximum(one, two), both)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(200)], [(9, 2), (2, 9), (5, 5), (7, 9), (3, 5)]])
def test_components(spark, edges):
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    top = {n: n for n in itertools.chain(*edges)}
    for _ in range(len(edges)):
        for a, b in edges:
            low = min(top[a], top[b])
            top[a] = top[b] = low
    assert found == top
