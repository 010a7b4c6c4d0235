"""Repeated ids with different texts, deep and broken pages, groups near the size of a shard, buckets above a block."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_documents import groups_by_hand
from tests.llm.test_stores import check_shards

from lectern.llm import fuse_dedup, packing, queries, setsketch, sharding, warc, wrappers

TEXTS = "doc_id long, text string"


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_groups_of_repeated_ids(spark, digest_chars):
    rows = [(1, "aaa"), (1, "b b b"), (2, "bbb"), (3, "aaa"), (1, "aaa"), (None, "aaa")]
    docs = spark.createDataFrame(rows, TEXTS)
    for old in (0, 1, 5):
        found = fuse_dedup.deduplicate(docs, F.col("doc_id") <= old, digest_chars=digest_chars).collect()
        told = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found)
        assert told == Counter({(1, 1, 3, True): 2, (3, 1, 3, False): 1, (1, 1, 2, True): 1, (2, 1, 2, False): 1})


def test_near_groups_of_repeated_ids(spark):
    draw = np.random.default_rng(2)
    one, two = (" ".join(f"{c}{i}" for i in draw.integers(0, 9999, 80)) for c in "ab")
    rows = [(1, one), (1, two), (3, one + " more"), (4, two + " more"), (None, one), (7, "else")]
    found = setsketch.near_duplicates(spark.createDataFrame(rows, TEXTS), prints=True).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in found) == Counter(
        {(1, 1, True): 2, (3, 1, False): 1, (4, 1, False): 1, (7, 7, True): 1}
    )
    assert len({r["print"] for r in found}) == 5


@pytest.mark.parametrize("kept", [0.85, 0.9])
def test_buckets_of_several_blocks(spark, monkeypatch, kept):
    """Texts that all share most of one base, at either side of the threshold, and pairs among them."""
    monkeypatch.setattr(setsketch, "BLOCK", 16)
    draw = np.random.default_rng(7)
    base = [f"w{i}" for i in range(120)]
    docs = {}
    for n in range(90):
        own = list(base)
        # One run of own words takes as many shingles as it has words, and three.
        width = round((1 - kept) * 120)
        at = int(draw.integers(0, 120 - width))
        own[at : at + width] = [f"x{n}.{k}" for k in range(width)]
        docs[2 * n] = " ".join(own)
        if n % 3 == 0:
            docs[2 * n + 1] = docs[2 * n] + " tail"
    found = setsketch.near_duplicates(spark.createDataFrame(list(docs.items()), TEXTS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == groups_by_hand(docs)


def test_rare_shingles_find_every_similar_pair():
    """The pairs that first meet at some rare shingle hold all similar ones, whatever the order of the shingles."""
    draw = np.random.default_rng(3)
    for percent in (80, 90):
        sets = [np.unique(draw.choice(60, draw.integers(1, 50), replace=False)) for _ in range(60)]
        sets += [np.setdiff1d(s, s[: len(s) // 9]) for s in sets[:30] if len(s) > 2]
        rows = []
        for rep, own in enumerate(sets):
            n = len(own)
            asked, held = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
            rows += [(t, rep, n, n - k, k < held, rep) for k, t in enumerate((own * 37 % 61).argsort()[:asked].tolist())]
            rows[-asked:] = [(int(own[t]), *r) for t, *r in rows[-asked:]]
        met = set()
        for token in range(60):
            own = [r for r in rows if r[0] == token]
            if own:
                group = dict(zip(("token", "rep", "n", "left", "indexed", "component"), map(np.array, zip(*own))))
                met |= {tuple(p[:2]) for pairs in setsketch.rare_pairs(group, percent) for p in pairs.tolist()}
        similar = set()
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    similar.add((a, b))
        assert similar and similar <= met and len(met) < 0.7 * len(sets) ** 2 / 2


def test_archives_of_repeated_ids(spark):
    big = "<p>" + "copy " * 300
    rows = [(1, "http://a.org/", "one"), (1, "http://a.org/", "two"), (2, "http://a.org/", big), (2, "http://b.org/", big + "!"), (5, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = warc.read_archives(warc.captures(warc.merge_runs(warc.write_archives(pages)))).collect()
    told = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in read)
    assert told == [(1, 3, "response", 0), (1, 3, "response", 0), (2, 1503, "revisit", 5), (2, 1504, "response", 0), (5, 1503, "response", 0)]
    assert sorted(r["payload"] for r in read if r["page_id"] == 1) == [b"one", b"two"]


@pytest.mark.parametrize("copies", [24, 30, 36, 40])
def test_groups_that_fit_a_shard_stay_whole(spark, copies):
    texts = {i: "the same" if i < copies else f"text {i}" for i in range(1600)}
    rows = sharding.shard_documents(spark.createDataFrame(list(texts.items()), TEXTS), 40).collect()
    check_shards(rows, texts, 40)
    assert len({r["shard"] for r in rows if r["doc_id"] < copies}) == 1


def test_special_tokens_as_the_library_reads_them(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.WORD_BPE)
    texts = ["hello <|endoftext|> x", "a<|startoftext|>b<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "x <|endoftext|>'s.", "<|endoftext|><|endoftext|>"]
    pieces = packing.cut_pieces(spark.createDataFrame(list(enumerate(texts)), TEXTS), queries.WORD_BPE, 0)
    for row in pieces.collect():
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert ids == [*whole.encode(texts[row["doc_id"]], add_special_tokens=False).ids, 0]


DEEP = [("<div>" * 1200 + "deep text", "deep text"), ("<span>" * 20_000 + "a<b>" * 20_000 + "deep", None)]


def test_deep_and_broken_pages(spark):
    broken = [
        "<a " * 100_000, '<a href="' * 60_000, '<a href="' * 60_001 + ">x", '<a ">" ' * 60_000 + "'", "</script " * 60_000,
        "<script>" + "</script " * 60_000, "<p class='" * 50_001 + ">", "<!--" * 100_000, "<a b" + " " * 500_000 + "c>",
    ]
    rows = [(i, f"http://h{i % 2}.org/", html) for i, html in enumerate([d[0] for d in DEEP] * 4 + broken)]
    began = time.time()
    found = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == len(rows) and found[0] == "deep text"
    assert found[1].endswith("deep")
    assert time.time() - began < 120


def test_unfinished_tags():
    assert wrappers.extract("a < b <i>c</i> <3 d <b", None) == "a < b c <3 d"
    assert wrappers.extract("<p title='x>y'>one</p><p title=\"z>\">two", None) == "one\n\ntwo"
    assert wrappers.extract("<p title='x>one</p><p>two", None) == "one\n\ntwo"


def test_generated_class_names_keep_templates_small():
    draw = np.random.default_rng(1)
    known, sizes = {}, []
    for page in range(300):
        blocks = "".join(f'<div class="c{draw.integers(1 << 40)}">block {page}.{i}</div>' for i in range(30))
        wrappers.grouped([("h", wrappers.folded(wrappers.parse(f"<body><h1>Site</h1>{blocks}"), page))], known)
        sizes.append(len(wrappers.packed(known["h"])))
    assert sizes[-1] < 1.5 * sizes[50]
    template = wrappers.unpacked(wrappers.packed(known["h"]))
    assert wrappers.packed(template) == wrappers.packed(known["h"])
    assert wrappers.extract("<body><h1>Site</h1><div class=c0>own text</div>", template) == "own text"


def test_no_constant_node_is_forgotten(spark):
    """Hundreds of constant blocks of one parent, behind as many that only the first pages have."""
    constant = "".join(f'<div class="k{k}">line {k}</div>' for k in range(400))
    rows = []
    for page in range(30):
        own = "".join(f'<div class="r{page}x{k}">part {page}.{k}</div>' for k in range(40))
        shown = constant if page >= 9 else ""
        rows.append((page, "http://h.org/", f"<body>{own}{shown}<p>End {page}</p></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    found = {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    for page in range(30):
        assert found[page] == "\n\n".join([*(f"part {page}.{k}" for k in range(40)), f"End {page}"])


def test_weights_without_a_table():
    leaf = lambda label: [label, 1, 0, [], []]
    assert wrappers.weight_of(["div", 1, 0, [], [leaf("p"), leaf("ul")]], ["div", 1, 0, [], [leaf("ul")]]) == 2


def test_whole_pages_are_dealt_once(spark):
    pages = spark.createDataFrame([(i, "http://h.org/", "x" * i, 0) for i in range(20)], "page_id long, url string, html string, second long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = warc.judged(pages.withColumn("exact", F.sha2("html", 256)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(page_id" in line]
    assert len(dealt) == 2 and not any("url" in line for line in dealt), plan


@pytest.mark.parametrize("cell", [8, 2048])
def test_pairs_of_rare_shingles_leave_a_task_estimated(spark, monkeypatch, cell):
    """Only pairs near the threshold leave the cells of a shingle that all texts have, however it is cut."""
    monkeypatch.setattr(setsketch, "CELL", cell)
    draw = np.random.default_rng(5)
    texts = {}
    for n in range(60):
        own = [f"w{i}" for i in range(100)]
        for at in draw.integers(0, 100, 2 if n < 20 else 6):
            own[at] = f"x{n}.{at}"
        texts[n] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), TEXTS)
    rare = setsketch.rare_shingles(docs, 4, 80, setsketch.shingle_counts(docs, 4)).withColumn("component", F.col("rep"))
    dealt = setsketch.dealt_shingles(rare, setsketch.fine_sketches(docs, 4))
    assert max(r["count"] for r in dealt.groupBy("token", "low", "high").count().collect()) <= (60 if cell > 60 else 40)
    met = {(r["a"], r["b"]) for r in setsketch.met_by_rare_shingles(dealt, 80).collect()}
    sets = {n: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for n, w in ((n, t.split()) for n, t in texts.items())}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in texts for b in texts if a < b}
    assert {pair for pair, x in like.items() if x >= 0.8} <= met
    assert met and min(like[pair] for pair in met) > 0.65
