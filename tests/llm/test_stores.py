"""Archives, shards, page texts and the pipeline against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import queries, sharding, warc, wrappers
from lectern.sources.tables import table
from tests.llm.test_documents import groups_by_hand, made_docs
from tests.llm.test_small_ops import ODD, check_packing, dedup_by_hand, odd_docs, word_bpe  # noqa: F401

PAGES = "page_id long, url string, html string, digest string, size int"


def odd_pages(spark):
    big, other = "<p>" + "copy " * 300, "x" * 999 + "é"
    rows = [
        (1, "http://www.Example.org/b?x=1#f", big),
        (2, None, big),
        (3, "http://example.org/a", None),
        (4, "", ""),
        (5, "not a url\twith\nmarks", "small"),
        (6, "http://[bad", "small"),
        (7, "https://a.example.org:8443/", other),
        (9, "http://example.org/a", other),
        (9, "http://example.org/a", other),
        (-4, "http://example.org/a", big),
        (None, "http://example.org/none", big),
        *[(100 + i, f"http://example.org/p{i % 7}", f"page {i}\r\n\r\n" * (i % 90)) for i in range(200)],
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


def revisits_by_hand(pages):
    held = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect() if r["page_id"] is not None}
    last = {}
    for page, payload in held.items():
        last[payload] = max(page, last.get(payload, page))
    out = {}
    for page, payload in held.items():
        refers = last[payload] if len(payload) >= 1000 and last[payload] != page else None
        kind = "response" if refers is None else "revisit"
        out[page] = (len(payload), hashlib.sha1(payload).hexdigest(), kind, refers)
    return out, held


@pytest.mark.parametrize(("run_entries", "fan_in", "span"), [(50_000, 64, 20_000), (9, 4, 16), (3, 2, 5)])
def test_archives(spark, monkeypatch, run_entries, fan_in, span):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 4)
    pages = odd_pages(spark)
    runs = warc.write_archives(pages, run_entries=run_entries)
    index = warc.captures(warc.merge_runs(runs, fan_in, span))
    rows = sorted(index.collect(), key=lambda r: (r["range"], r["block"], r["nth"]))
    keys = [(r["url_key"], r["stamp"], r["page_id"]) for r in rows]
    assert keys == sorted(keys)
    read = warc.read_archives(index).collect()
    expected, held = revisits_by_hand(pages)
    assert len(read) == len(expected)
    for r in read:
        own = (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
        assert own == expected[r["page_id"]]
        assert r["payload"] == (held[r["page_id"]] if r["record_type"] == "response" else None)


def test_archives_of_nothing(spark):
    runs = warc.write_archives(odd_pages(spark).limit(0))
    assert warc.read_archives(warc.captures(warc.merge_runs(runs))).count() == 0


def test_archives_of_the_table(spark, root):
    expected, _ = revisits_by_hand(table(spark, root, "pages"))
    rows = queries.queries()["op2_warc"](spark, root).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == expected and len(rows) == len(expected)


def test_loser_tree():
    draw = np.random.default_rng(4)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((int(x), "") for x in draw.integers(0, 50, draw.integers(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(sum(runs, []))


def test_url_keys():
    assert warc.url_key("https://WWW.Example.org:443/A?b=C#d") == "org,example)/a?b=c"
    assert warc.url_key("http://blog.example.org:81") == "org,example,blog:81)/"
    assert warc.url_key(None) == ")/"


def check_shards(rows, texts, shards):
    held = defaultdict(list)
    for r in rows:
        held[r["shard"]].append(r["slot"])
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    counts = [len(held[s]) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in held.values())
    return held


def cut_share(rows, texts):
    """Share of the rows of repeated texts that are not where most of their copies are."""
    groups = defaultdict(Counter)
    for r in rows:
        groups[texts[r["doc_id"]]][r["shard"]] += 1
    groups = [c for c in groups.values() if sum(c.values()) > 1]
    return 1 - sum(max(c.values()) for c in groups) / max(1, sum(sum(c.values()) for c in groups))


def test_shards_of_the_table(spark, root):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, root, "documents").collect()}
    rows = queries.queries()["op6_sharding"](spark, root).collect()
    assert len(rows) == len(texts)
    check_shards(rows, texts, 40)
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def test_shards_keep_copies_together(spark):
    texts = {i: f"text {i}" if i % 3 else f"copy {i % 30}" for i in range(1500)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    rows = sharding.shard_documents(docs, 8).collect()
    check_shards(rows, texts, 8)
    assert cut_share(rows, texts) < 0.02


def test_shards_split_a_hot_group(spark):
    texts = {i: f"text {i}" if i % 3 else "the same" for i in range(1200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sharding.shard_documents(docs, 12).collect()
    check_shards(rows, texts, 12)
    same = Counter(r["shard"] for r in rows if r["doc_id"] % 3 == 0)
    assert sum(n for _, n in same.most_common(7)) >= 0.9 * 400


@pytest.mark.parametrize(
    ("text", "whole"),
    [
        (lambda i: f"pair {i % 1000}", True),
        (lambda i: f"pair {i % 950}" if i < 1900 else f"alone {i}", True),
        (lambda i: "hot" if i < 1000 else f"ten {i % 80}" if i < 1800 else f"alone {i}", True),
        (lambda i: f"three {i % 667}", False),
    ],
)
def test_shards_of_tables_full_of_copies(spark, text, whole):
    texts = {i: text(i) for i in range(2000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = sharding.shard_documents(docs, 20).collect()
    check_shards(rows, texts, 20)
    held = defaultdict(set)
    for r in rows:
        held[texts[r["doc_id"]]].add(r["shard"])
    split = sum(len(shards) > 1 for group, shards in held.items() if group != "hot")
    assert split == 0 if whole else split < 20


def test_plan_of_hubs():
    assert sharding.plan_of({(0, 4): 3, (1, 2): 1}, [5, 5, 6]) == (
        [(0, 4, 0, 1, 0), (0, 4, 1, 2, 1), (0, 4, 2, 3, 2), (1, 2, 0, 1, 2)], []
    )
    assert sharding.plan_of({(0, 4): 1}, [1, 3]) == ([], [(0, 4, 0, 0, 3, 1), (0, 4, 0, 3, 4, 0)])


def test_shards_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = sharding.shard_documents(docs, 5).collect()
    check_shards(rows, {None: "no id"} | {i: t or "" for i, t in enumerate(ODD)}, 5)
    assert len(rows) == docs.count()
    assert sharding.shard_documents(docs.limit(0), 5).count() == 0
    check_shards(sharding.shard_documents(docs.filter("doc_id < 3"), 40).collect(), dict(enumerate(["", "", " "])), 40)


HEAD = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
CASES = {
    HEAD + '<nav><ul><li><a href="/">Menu</a></ul></nav><article><h1>One &amp; two</h1><p>Some <b>bold\n\ttext<p>Next'
    '<div class="ad box">Buy</div><!-- x --> line<br>more</article><section id="comments"><p>First!</section>': (
        "One & two\n\nSome bold text\n\nNext\n\nline more"
    ),
    "<main><p>a&nbsp;b &lt;c&gt; &#233;&#x41; &unknown; &am</main><footer>f</footer>": "a b <c> éA &unknown; &am",
    "<body><article><p>cut in a tag <b": "cut in a tag",
    "<article><p>1 < 2 and <em>3</em>4</p><form><input value='x'><p>no</form><ul><li>x<li>y</ul></article>": (
        "1 < 2 and 34\n\nx\n\ny"
    ),
    '<article><p title="a > b">quoted</p><aside>side</aside><p>after</p><div class="user-comments">c</div></article>': (
        "quoted\n\nafter"
    ),
    "plain words only": "plain words only",
    "<article></article>": "",
    "": "",
}


@pytest.mark.parametrize("source", CASES)
def test_page_texts(source):
    assert wrappers.extract(source, None) == CASES[source]
    own = wrappers.folded(wrappers.parse(source))
    template = [*own[:1], 5, *own[2:]]
    if "<article" in source or "<main" in source:
        assert wrappers.extract(source, template) == CASES[source]


def test_constant_nodes_are_template(spark):
    page = "<body><div class=top>Our Site</div><div class=body><p>{0}</p><p>{0} again</p></div><div class=low>Bye</div></body>"
    rows = [(i, f"http://h.example.org/{i}", page.format(f"words {i}"), "", 0) for i in range(6)]
    rows += [(10, None, None, "", 0), (None, "http://h.example.org/", page.format("no id"), "", 0), rows[0]]
    found = wrappers.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in found) == sorted(
        [(str(i), f"words {i}\n\nwords {i} again") for i in (0, 0, 1, 2, 3, 4, 5)]
        + [("10", ""), ("None", "no id\n\nno id again")]
    )
    assert wrappers.main_text(spark.createDataFrame(rows, PAGES).limit(0)).count() == 0


def test_page_texts_of_the_table(spark, root):
    import html
    import re

    rows = {r["page_id"]: r for r in queries.queries()["op7_wrapper_induction"](spark, root).collect()}
    pages = table(spark, root, "pages").collect()
    assert len(rows) == len(pages)
    for page in pages:
        inner = page["html"].partition("<article>")[2].partition("</article>")[0].partition("<footer")[0]
        parts = re.sub(r"<[^>]*>|<[^<]*$", " ", re.sub(r"</?(?:p|h1)>", "\0", inner)).split("\0")
        expected = "\n\n".join(b for b in (" ".join(html.unescape(p).split()) for p in parts) if b)
        assert rows[page["page_id"]]["text"] == expected
        assert rows[page["page_id"]]["n_chars"] == len(expected)


def test_content_beside_like_elements_that_are_none(spark):
    page = "<body><div id=header>Top {0}</div><div id=content>Words {0}</div><div id=footer>Low {0}</div></body>"
    story = "<body><article><p>One {0}</p>{1}<p>Two {0}</p></article></body>"
    rows = [(i, "http://a.example.org/", page.format(i), "", 0) for i in range(4)]
    marks = ["<p id=share>Share</p>", "<p hidden>Not seen</p>", "<p role=navigation>On</p>", "", ""]
    rows += [(10 + i, "http://b.example.org/", story.format(i, mark), "", 0) for i, mark in enumerate(marks)]
    found = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {i: f"Words {i}" for i in range(4)} | {10 + i: f"One {i}\n\nTwo {i}" for i in range(5)}
    assert wrappers.extract(page.format(1), None) == "Words 1"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<article><p style="overflow:hidden">a</p><p aria-hidden="false">b</p><a href="/hidden-gems">c</a></article>', "a\n\nb\n\nc"),
        ('<p data-hidden>a</p><p data-class="menu">b</p><p title="id=footer">c</p><p HIDDEN>d</p>', "a\n\nb\n\nc"),
        ('<body class="has-sidebar"><p>a</p></body>', "a"),
        ('<body id="footer" class="sidebar"><article class="post comments-open"><p>a</p></article></body>', "a"),
        ('<main class="with-sidebar widget" role="search"><p>a</p></main>', "a"),
        ('<div class="social-policy">a</div><div class="share-price">b</div><div class="social share-bar">c</div>', "a\n\nb"),
        ('<div class="widget"><div id="banner"><main>a</main></div></div>', "a"),
        ('<div class="widget"><article>a</article></div><div class="site-footer">b</div>', "a"),
        ('<article>a<div class="comment-list"><article>b</article></div></article>', "a"),
        ('<div class="related"><article>b</article></div><article>a</article><div id="Left_NavBar">c</div>', "a"),
        ('<nav><div class="menu"><article>b</article></div></nav><div class="ad-300x250">c</div><p>a', "a"),
        ('<p class="a" class="menu">a</p><p id=\'cookie_banner\'>b</p>', "a"),
    ],
)
def test_names_of_no_content(source, text):
    assert wrappers.extract(source, None) == text


def test_constant_text_at_any_depth_is_template(spark):
    plain = (
        "<body><ul class=links><li>About<li>Terms</ul><div>(c) Site <a href=/>Home</a></div><div class=text>Read on"
        "<p>Words {0} <b>bold</b></p><p>More {0}</p></div><p class=by>Written by <i>Author {0}</i></p></body>"
    )
    story = (
        "<article><h1>Story {0}</h1><div class=hint>Read <b>this</b> first<p>Rules</p></div><p>Told by <b>Teller {0}</b></p>"
        "<ul class=tail><li>Report<li>Print</ul></article>"
    )
    copied = "<script>{0}</script><article><h1>Copied</h1><p>The same text</p></article>"
    rows = [(i, "http://a.example.org/", plain.format(i), "", 0) for i in range(4)]
    rows += [(10 + i, "http://b.example.org/", story.format(i), "", 0) for i in range(4)]
    rows += [(20 + i, "http://c.example.org/", copied.format(i), "", 0) for i in range(9)]
    rows += [(30 + i, "http://d.example.org/", story.format(i), "", 0) for i in range(2)]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    found = {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    for i in range(4):
        assert found[i] == f"Words {i}\n\nMore {i}\n\nWritten by Author {i}"
        assert found[10 + i] == f"Story {i}\n\nTold by Teller {i}"
    assert {found[20 + i] for i in range(9)} == {"Copied\n\nThe same text"}
    assert found[31] == "Story 1\n\nRead this first\n\nRules\n\nTold by Teller 1\n\nReport\n\nPrint"


def test_alignment_takes_the_heaviest():
    leaf = lambda label: [label, 1, 0, False, []]
    deep = ["div", 1, 0, False, [leaf("p"), leaf("ul"), leaf("p")]]
    left, right = [leaf("div"), leaf("h1"), deep], [deep, leaf("h1"), leaf("h2")]
    assert wrappers.matching(left, right) == [(2, 0)]
    assert wrappers.weight_of(deep, ["div", 1, 0, False, [leaf("ul"), leaf("p")]]) == 3


def test_pipeline_stages(spark, root, word_bpe):  # noqa: F811
    docs = table(spark, root, "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, root, "labels").collect()}
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], root)
        if name != "pack":
            assert sorted(out.columns) == sorted(docs.columns)
        steps.append(out.cache())
    ids = [{r["doc_id"]: r["text"] or "" for r in s.select("doc_id", "text").collect()} for s in steps[:-1]]
    gone = set(ids[0]) - set(ids[1])
    good = [d for d in labels if labels[d] == 1]
    assert sum(d in gone for d in good) <= 0.03 * len(good)
    assert sum(d in gone for d in labels if labels[d] == 0) >= 0.8 * sum(q == 0 for q in labels.values())
    assert set(ids[2]) == {doc for doc, keep, *_ in dedup_by_hand(ids[1].items()) if doc == keep}
    assert set(ids[3]) == {doc for doc, (_, group) in groups_by_hand(ids[2], words=corpus_pipeline.SHINGLE_WORDS).items() if doc == group}
    rows = steps[-1].collect()
    check_packing(rows, {d: len(word_bpe(t)) + 1 for d, t in ids[3].items()})
    assert queries.queries()["pipeline"](spark, root).count() == len(rows)
    for step in steps[1:]:
        step.unpersist()


def test_pipeline_of_odd_rows(spark, folder):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in made_docs().items()]
    rows += [rows[3], (None, "no id", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for some in (docs, docs.limit(0)):
        out = some
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, folder)
        assert (out.count() > 0) == (some is docs)
    step = corpus_pipeline.exact_dedup(spark, docs, folder)
    kept = {doc for doc, keep, *_ in dedup_by_hand([(r[0], r[1]) for r in rows if r[0] is not None]) if doc == keep}
    assert sorted(r["doc_id"] for r in step.filter("doc_id is not null").collect()) == sorted(kept)
    assert step.filter(F.col("doc_id").isNull()).count() == 2


def test_pipeline_of_repeated_ids(spark, folder):
    """Rows of one id with different texts are documents of their own."""
    draw = np.random.default_rng(8)
    one, two, three = (" ".join(f"{c}{i}" for i in draw.integers(0, 9999, 90)) for c in "abc")
    rows = [(1, one), (1, two), (1, two), (2, three), (3, two + " more"), (3, "Some other text."), (None, one)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, folder)
    left = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert left == Counter([(1, one), (1, two), (2, three), (3, "Some other text."), (None, one)])
