"""Midstate manifests against a plain hash tree."""

import hashlib
import zlib

import numpy as np
import pytest
from harness import connect, difference
from pyspark.sql import functions as F

from lectern.llm import midstate, queries
from lectern.llm.common import ranked_in_order
from lectern.sources.tables import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, digest int"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grown(nodes):
    """Levels of a plain tree, from the leaves to what remains."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def siblings(levels, at):
    found = []
    for level in levels[:-1]:
        run = at // 16 * 16
        found += [h for i, h in enumerate(level[run : run + 16], run) if i != at]
        at //= 16
    return found


def replaced(levels, at, value):
    for level in levels[:-1]:
        run = at // 16 * 16
        value = sha([value if i == at else h for i, h in enumerate(level[run : run + 16], run)])
        at //= 16
    return value


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def by_hand(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row["source"], []).append((row, leaf_of(row, row["text"])))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda r: (r[0]["doc_id"] is not None, r[0]["doc_id"] or 0, r[1]))
        trees[name] = grown([leaf for _, leaf in sources[name]])
    top = grown([trees[name][-1][0] for name in names])
    root = top[-1][0]
    out = []
    for place, name in enumerate(names):
        for at, (row, leaf) in enumerate(sources[name]):
            doc, text = row["doc_id"], row["text"]
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            proof = sha(siblings(trees[name], at) + siblings(top, place))
            folded = replaced(top, place, replaced(trees[name], at, leaf_of(row, text)))
            out.append((doc, leaf, trees[name][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def run(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    rows = queries.queries()["op11_midstate_tree"](spark, folder).collect()
    return sorted(map(tuple, rows), key=str)


def test_given_documents(spark, root):
    rows = queries.queries()["op11_midstate_tree"](spark, root).collect()
    expected = by_hand(table(spark, root, "documents").collect())
    assert sorted(map(tuple, rows), key=str) == expected
    assert {r["verified"] for r in rows} == {True, False}


def test_sql_twin(spark, root):
    name = "op11_midstate_tree"
    assert difference(queries.queries()[name](spark, root), connect(root), queries.oracle_sql()[name]) is None


def test_compression_gives_sha256():
    draw = np.random.default_rng(4)
    for n in (1, 2, 16):
        raw = [draw.bytes(32) for _ in range(n)]
        before, digest = midstate.parents(midstate.unpack(raw), np.array([0]), np.array([n]))
        assert midstate.pack(digest).hex() == sha(r.hex() for r in raw)
        assert before.shape == (8, n)


@pytest.mark.parametrize("span_sources", [((None, 1), ("", 2), ("é", 17), ("z", 300)), (("a", 4097), ("b", 4096), ("c", 16))])
def test_sources_of_all_sizes(spark, folder, span_sources):
    rows = []
    for source, count in span_sources:
        rows += [(7 * i % 10007, f"Text {i} É", None if i % 3 else "en", source, i, "own", 1) for i in range(count)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert run(spark, folder, docs) == by_hand(docs.collect())


def test_many_sources(spark, folder):
    rows = [(i, "A" * (i % 5), "en", f"s{i % 5000}", i, None, None) for i in range(5200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert run(spark, folder, docs) == by_hand(docs.collect())


def test_odd_rows(spark, folder):
    rows = [
        (None, "no id", "en", "s", 1, None, None), (None, None, None, None, None, None, None), (5, None, None, None, None, "x", 2),
        (5, "Twice", "en", "s", 3, None, None), (5, "Twice", "en", "s", 3, None, None), (5, "OTHER", "en", "s", 3, None, None),
        (9, "", "", "", 0, None, None), (-3, "LONG " * 50_000, "日本", "s", 9, None, None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert run(spark, folder, docs) == by_hand(docs.collect())


def test_one_row_and_none(spark, folder):
    docs = spark.createDataFrame([(3, "ONE", "en", "s", 3, None, None)], SCHEMA)
    assert run(spark, f"{folder}/one", docs) == by_hand(docs.collect())
    assert run(spark, f"{folder}/none", docs.limit(0)) == []


def test_ranks_in_order(spark):
    rows = spark.range(3000).select((F.col("id") % 3 * (F.col("id") % 7)).cast("string").alias("k"), F.col("id").alias("v"))
    found = {}
    for r in ranked_in_order(rows.repartition(7), "k", ["v"]).collect():
        found.setdefault(r["k"], []).append((r["rank"], r["v"], r["n"]))
    for held in found.values():
        held.sort()
        assert [r for r, _, _ in held] == list(range(len(held)))
        assert [v for _, v, _ in held] == sorted(v for _, v, _ in held)
        assert {n for _, _, n in held} == {len(held)}
