import math
import os

import numpy as np
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import html
from lectern.operators import evaluation, merge, questions, race, retrieval, search, sessions, vectors
from lectern.sources import feed, fetched, files, seed
from lectern.streaming import ingest
from lectern.streaming.sessions import fold_turn

CHUNKS = [
    (1, 1, "Rules Section C", None, "C1.1", "The plank wear limit is one millimetre. Plank skid blocks."),
    (2, 2, "Rules Section B", None, "B2", "An unsafe release in the pit lane brings a penalty by the stewards."),
    (3, 3, "Rules Section B", "Section B", "B3", "Red flag suspension. The required procedure stops all cars."),
    (4, 4, "Rules Section A", None, None, "General principles and governance."),
]
CHUNK_SCHEMA = "chunk_id long, ord long, document_title string, section string, article string, content string"


def brute_keyword_scores(text):
    """The scores computed one chunk at a time."""
    import re

    lowered = text.lower()
    terms = [w.strip(".,?!:;()[]") for w in lowered.split()]
    keywords = list(dict.fromkeys(k for t in terms if len(t) >= 3 for k in vocab.KEYWORD_EXPANSIONS.get(t, [t])))
    phrases = [p for keys, p in vocab.PHRASE_RULES if any(k in lowered for k in keys)]
    named = [f"Section {m.upper()}" for m in re.findall(r"(?<![a-z])section\s*([a-f])(?![a-z])", lowered)]
    preferred = list(dict.fromkeys(named + [s for s, ws in vocab.SECTION_WORDS.items() if any(w in lowered for w in ws)]))
    scores = {}
    for chunk_id, _, title, _, article, content in CHUNKS:
        body = content.lower()
        tokens = re.findall("[a-z0-9]+", body)
        bm25 = 0.0
        for k in keywords:
            df = sum(k in c[5].lower() for c in CHUNKS)
            tf = tokens.count(k)
            if df and tf:
                idf = math.log(1 + (len(CHUNKS) - df + 0.5) / (df + 0.5))
                bm25 += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / 180))
        points = 10 * sum(p in body for p in phrases) + sum(k in body for k in keywords)
        points += 3 * bool(article and any(k in article.lower() for k in keywords))
        points += 8 * sum(s.lower() in title.lower() for s in preferred) if points else 0
        if round(bm25, 4) + points > 0:
            scores[chunk_id] = (round(bm25, 4), points)
    return scores


def test_keyword_scores_against_brute_force(spark):
    corpus = spark.createDataFrame(CHUNKS, CHUNK_SCHEMA)
    asked = ["What is the plank wear limit?", "unsafe release in the pit lane", "red procedure in section A", "nothing"]
    parsed = questions.parse_questions(spark.createDataFrame(list(enumerate(asked)), "query_id long, question string"))
    found = {}
    for r in search.keyword_scores(corpus, parsed).collect():
        found.setdefault(r.query_id, {})[r.chunk_id] = (round(r.bm25, 4), r.heuristic)
    for i, text in enumerate(asked):
        assert found.get(i, {}) == brute_keyword_scores(text)


def test_retrieval_prefers_the_right_section_and_gates_evidence(spark):
    corpus = spark.createDataFrame(CHUNKS, CHUNK_SCHEMA)
    asked = [(1, "plank wear thickness"), (2, "zzz qqq")]
    parsed = questions.parse_questions(spark.createDataFrame(asked, "query_id long, question string"))
    rows = retrieval.retrieve(parsed, corpus, None, None)["retrieved"].orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.strong) for r in rows] == [(1, 1, True)]


def test_fusion_keeps_vector_order_on_ties(spark):
    vector = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, vector_rank int")
    keyword = spark.createDataFrame([(1, 12, 1, 0.0)], "query_id long, chunk_id long, keyword_rank int, score double")
    rows = retrieval.fuse(vector, keyword).orderBy("hybrid_rank").collect()
    assert [r.chunk_id for r in rows] == [10, 12, 11]
    assert rows[0].hybrid == round(100 / 61, 4)


def test_many_blocks_find_the_same_neighbours(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(120, 8)).astype("float32")
    data[60:100] = data[5]  # a third of the rows are copies
    vecs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    probes = vecs.filter("vec_id < 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"))
    unit = data.astype("float64") / np.linalg.norm(data.astype("float64"), axis=1, keepdims=True)
    for blocks in ((1000, 1000), (16, 3)):
        found = vectors.nearest_many(vecs, probes, 5, *blocks).orderBy("query_id", "vector_rank").collect()
        for q in range(7):
            sims = np.round(unit @ unit[q], 6)
            expected = sorted(range(120), key=lambda i: (-sims[i], i))[:5]
            assert [r.vec_id for r in found if r.query_id == q] == expected


def naive_fold(turns, limits):
    state = ([], [], None, 0)
    for role, message in turns:
        state = fold_turn(state, role, message, limits)
    return len(state[1]), state[3], state[2]


def test_block_fold_equals_turn_by_turn(spark):
    rng = np.random.default_rng(11)
    limits = {"max_turns": 6, "recent": 2, "max_tokens": 60, "summary_tokens": 20}
    rows, expected = [], {}
    for session in range(12):
        turns = [
            ("user" if i % 2 == 0 else "assistant", "x" * int(rng.integers(1, 120)) + rng.choice([" y", " 红旗", ""]))
            for i in range(int(rng.integers(1, 90)))
        ]
        rows += [(session, i, role, message) for i, (role, message) in enumerate(turns)]
        expected[session] = naive_fold(turns, limits)
    df = spark.createDataFrame(rows, "session_id long, ord long, role string, message string")
    for block in (3, 8, 1024):
        got = {
            r.session_id: (r.retained_turns, r.compacted_turns, r.summary)
            for r in sessions.compact_history(df, **limits, block=block).collect()
        }
        assert got == expected


def test_memory_ranking_against_all_pairs(spark):
    memories = [(i, i % 2, f"alpha{i % 3} beta{i % 5} common", "preference", 0.6 + 0.2 * (i % 2), i) for i in range(30)]
    df = spark.createDataFrame(memories, "memory_id long, owner_id long, content string, memory_type string, confidence double, updated_at long")
    asked = [(1, 0, "alpha1 beta2"), (2, 1, "nothing shared"), (3, 1, "common alpha0")]
    queries = spark.createDataFrame(asked, "query_id long, owner_id long, message string")
    found = sessions.top_memories(df, queries).orderBy("query_id", "rank").collect()
    for query_id, owner, message in asked:
        terms = set(message.split())
        scored = [(len(terms & set(m[2].split())) + m[4], m[5], -m[0], m[0]) for m in memories if m[1] == owner]
        assert [r.memory_id for r in found if r.query_id == query_id] == [s[3] for s in sorted(scored, reverse=True)[:3]]


def test_memory_ranking_by_blocks_of_queries(spark, monkeypatch):
    """Owners with many and with few queries, ties, nulls and small blocks; memories are not derived again for each block."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(sessions, "QUERY_BLOCK", 150)
    monkeypatch.setattr(sessions, "MANY_QUERIES", 20)
    monkeypatch.setattr(sessions, "COMMON_TERMS", 5)
    monkeypatch.setattr(sessions, "CELLS_AT_ONCE", 700)
    draw = lambda n: " ".join(f"word{i}" for i in np.minimum(rng.zipf(1.3, n), 60))
    owner = lambda i: None if i % 50 == 9 else "busy" if i % 3 else f"owner{i % 40}"
    times = [None if i % 30 == 4 else int(rng.integers(0, 6)) for i in range(700)]
    memories = [
        (f"m{i * 7919 % 700:03}", owner(i), None if i % 60 == 5 else draw(rng.integers(1, 12)), "preference", 0.6 + 0.2 * (i % 2), times[i])
        for i in range(700)
    ]
    queries = [(i, owner(i + 1), None if i % 45 == 7 else draw(8)) for i in range(400)]
    df = spark.createDataFrame(memories, "memory_id string, owner_id string, content string, memory_type string, confidence double, updated_at long")
    asked = spark.createDataFrame(queries, "query_id long, owner_id string, message string")
    stamped = df.withColumn("updated_at", F.timestamp_seconds(F.col("updated_at") + 1_700_000_000))
    for table in (df, stamped):
        best = sessions.top_memories(table, asked)
        assert "regexp_replace" not in best._jdf.queryExecution().optimizedPlan().toString()
        found = {}
        for r in best.orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r.memory_id, round(r.score, 6)))
        for query_id, own, message in queries:
            terms = set((message or "").split())
            scored = [
                (-len(terms & set((m[2] or "").split())) - m[4], -1 if m[5] is None else -2 - m[5], m[0])
                for m in memories
                if own is not None and m[1] == own
            ]
            assert found.get(query_id, []) == [(s[2], round(-s[0], 6)) for s in sorted(scored)[:3]]


ARTICLE = (
    "id long, source_name string, source_article_id string, title string, summary string, content string, "
    "article_url string, author string, published_at timestamp, tags array<string>, raw_payload string, "
    "fetched_at timestamp, is_deleted boolean"
)


def test_upsert_follows_arrival_order(spark):
    stored = spark.createDataFrame([(1, "s", "a", "old", None, None, "u1", None, None, [], None, None, True)], ARTICLE)
    columns = "arrival long, source_name string, source_article_id string, title string, article_url string"
    rows = [
        (1, "s", "a", "by id", "other"),
        (2, "s", "z", "by url", "u1"),
        (3, "s", "n1", "new", "u2"),
        (4, "s", "n1", "same id", "u3"),
        (5, "s", None, "u3 was never stored", "u3"),
        (6, "s", "n9", "matches 5 by url", "u3"),
        (7, "s", "n1", "last of n1", "u4"),
    ]
    incoming = spark.createDataFrame(rows, columns)
    for name, kind in (("summary", "string"), ("content", "string"), ("author", "string"), ("published_at", "timestamp"),
                       ("tags", "array<string>"), ("raw_payload", "string")):
        incoming = incoming.withColumn(name, F.lit(None).cast(kind))
    result = merge.upsert_articles(stored, incoming, F.timestamp_seconds(F.lit(0))).collect()
    got = {(r.source_article_id, r.article_url): (r.title, r.is_deleted) for r in result}
    assert got == {
        ("a", "u1"): ("by url", False),
        ("n1", "u2"): ("last of n1", False),
        (None, "u3"): ("matches 5 by url", False),
    }


def test_article_batches_that_run_again_change_nothing(spark, folder):
    stored = spark.createDataFrame([(1, "s", "a", "old", None, None, "u1", None, None, [], None, None, False)], ARTICLE)
    path = ingest.versions(folder)
    stored.write.parquet(path(0))
    merge_batch = ingest.article_merger(folder, lambda: F.timestamp_seconds(F.lit(0)))
    batch = stored.drop("id", "fetched_at", "is_deleted").withColumn("arrival", F.lit(1).cast("long"))
    batch = batch.withColumn("title", F.lit("new")).unionByName(
        batch.withColumns({"arrival": F.lit(2).cast("long"), "source_article_id": F.lit("b"), "article_url": F.lit("u2")})
    )
    for _ in range(2):
        merge_batch(batch, 0)
        rows = spark.read.parquet(path(1)).orderBy("id").collect()
        assert [(r.id, r.source_article_id, r.title) for r in rows] == [(1, "a", "new"), (3, "b", "old")]


def test_articles_of_one_url_are_told_apart_by_their_address(spark):
    rows = [(i, "s", f"a{i}", "old", None, None, "u", None, None, [], None, None, False) for i in (1, 2)]
    stored = spark.createDataFrame(rows, ARTICLE).withColumn("address", F.concat_ws("#", "article_url", "id"))
    incoming = stored.drop("id", "fetched_at", "is_deleted").withColumns(
        {"source_article_id": F.lit(None).cast("string"), "title": F.concat(F.lit("by "), "address")}
    )
    old = incoming.withColumn("arrival", F.expr("CAST(substring_index(address, '#', -1) AS BIGINT)"))
    new = old.withColumns({"arrival": F.col("arrival") + 2, "address": F.concat(F.lit("new "), "address"), "article_url": F.lit("n")})
    merged = merge.upsert_articles(stored, old.unionByName(new), F.timestamp_seconds(F.lit(0)), "address")
    assert sorted((r.source_article_id or "", r.article_url, r.title) for r in merged.collect()) == [
        ("", "n", "by u#1"), ("", "n", "by u#2"), ("a1", "u", "by u#1"), ("a2", "u", "by u#2")
    ]


def test_backfill_by_id_keeps_one_row_an_article(spark):
    rows = [(i, "s", f"a{i}", "t", None, None, "u", None, None, [], None, None, False) for i in (1, 2)]
    details = spark.createDataFrame(
        [(i, None, f"body {i}", None, []) for i in (1, 2)], "id long, summary string, content string, author string, tags array<string>"
    )
    filled = merge.backfill(spark.createDataFrame(rows, ARTICLE), details, "id")
    assert sorted((r.id, r.content) for r in filled.collect()) == [(1, "body 1"), (2, "body 2")]


def test_streamed_articles_of_one_url_stay_apart(spark, folder):
    stored = spark.createDataFrame([(1, "s", "a", "t", None, None, "u", None, None, [], None, None, False)], ARTICLE)
    stored = stored.withColumn("address", F.lit("u#1"))
    path = ingest.versions(folder)
    stored.write.parquet(path(0))
    merge_batch = ingest.article_merger(folder, lambda: F.timestamp_seconds(F.lit(0)), "address")
    batch = stored.drop("id", "fetched_at", "is_deleted").withColumn("arrival", F.lit(2).cast("long"))
    for number, key in enumerate(("b", "c")):
        merge_batch(batch.withColumns({"source_article_id": F.lit(key), "address": F.lit(f"u#{key}")}), number)
    assert sorted(r.source_article_id for r in spark.read.parquet(path(2)).collect()) == ["a", "b", "c"]


def test_only_references_with_a_semicolon_are_decoded():
    body = "<article><h1>cut &amp;&amp &#38 &ampfoo; &copy;</h1><script>x &amp y</script></article>"
    assert html.page_detail(body)["content"] == "cut &&amp &#38 &ampfoo; ©"
    linked = '<script type="application/ld+json">{"@type": "NewsArticle", "description": "R&D &amp"}</script>'
    assert html.page_detail(linked)["summary"] == "R&D &amp"


PAGE = """<html><head><meta name="description" content=" A  summary "><meta property="article:tag" content="One">
<meta property="article:tag" content="One"><meta property="og:author" content="Ann"></head>
<body><main><h1>Headline of this long page</h1>A summary<p>byline is skipped here too</p><p>First paragraph of the body text.</p>
<p>short</p><script>var x = "</p>";</script><p>Second paragraph &amp; more of the body.</p><p>Related Articles</p><p>Not part of the body at all.</p>
</main></body></html>"""


def test_markup_fallback_trims_the_main_element():
    detail = html.page_detail(PAGE)
    assert detail["summary"] == "A summary" and detail["author"] == "Ann" and detail["tags"] == ["One"]
    assert detail["content"] == "First paragraph of the body text.\n\nSecond paragraph & more of the body."


def test_linked_data_and_state():
    linked = '<script type="application/ld+json">{"@graph": [{"@type": "NewsArticle", "description": "D", "author": {"name": "N"}, "keywords": "a, b|a"}]}</script>'
    state = '<script id="__NEXT_DATA__" type="application/json">{"p": {"body": ["<p>one</p>", 3, "two"], "author": "S"}}</script>'
    both = html.page_detail(linked + state)
    assert both == {"summary": "D", "content": "one\n\ntwo", "author": "N", "tags": ["a", "b"]}
    # Something found in the state keeps the markup from being read.
    assert html.page_detail(state + "<article>Body of the article</article>")["content"] == "one\n\ntwo"
    assert html.page_detail(linked + "<article>Body of the article</article>")["content"] == "Body of the article"
    assert html.page_detail(None) == html.EMPTY


def test_unclosed_tags_end_with_their_parent():
    assert html.page_detail("<article><p>a<p><b>b</article>after")["content"] == "a\n\nb"


def test_seed_calendar_and_standings(spark):
    events = seed.seed_calendar(spark, "current")
    now = F.to_timestamp(F.lit("2026-07-06T00:00:00Z"))
    keyed = events.withColumn("event_id", F.col("round_number"))
    assert race.next_events(keyed, now).first().event_id == 10
    assert race.previous_events(keyed, now).first().event_id == 9
    assert seed.seed_drivers(spark, 2025).count() == 0 and seed.seed_teams(spark, 2026).count() == 3


def test_chinese_numbers(spark):
    values = ["三", "十", "十二", "二十", "四十五", "百"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(race.chinese_number("v").alias("n")).collect()
    assert [r.n for r in rows] == [3, 10, 12, 20, 45, None]


def test_percentile_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "v double").agg(evaluation.interpolated_percentile("v", 0.95).alias("p"))
    assert empty.first().p == 0.0


def test_feed_file(spark, folder):
    path = os.path.join(folder, "feed.xml")
    with open(path, "w") as out:
        out.write(
            "<rss><channel><item><title>T1</title><link>https://x/a/b/</link><pubDate>Mon, 06 Jul 2026 10:00:00 GMT</pubDate></item>"
            "<item><title> </title><link>https://x/c</link></item><item><title>T3</title><link>https://x/d</link></item></channel></rss>"
        )
    rows = feed.latest_items(feed.read_feed(spark, path), "order", 2).collect()
    assert [(r.title, r.source_article_id) for r in rows] == [("T1", "b")]


def test_manifest_round_trip(spark, folder):
    chunk = [("c1", "Doc Section B", "Section B", None, 1, 1, 1, ["Section B"], 1, "text", None)]
    from lectern import schemas

    path = os.path.join(folder, "chunks")
    files.write_manifest(spark.createDataFrame(chunk, schemas.CHUNK), path)
    back = files.read_manifest_lines(spark, path)
    assert [tuple(r) for r in back.collect()] == chunk
    assert files.import_rows(back, "pdf").first().section_code == "Section B"


def test_cases_lack_a_field(spark, folder):
    path = os.path.join(folder, "cases.jsonl")
    with open(path, "w") as out:
        out.write('{"name": "n", "messages": ["m"], "expected_intent": "race", "expected_tool": "race_tool", "expected_action": "x"}\n\n')
    assert files.read_cases(spark, path).first().must_include == []
    with open(path, "w") as out:
        out.write('{"name": "n", "messages": ["m"]}\n')
    try:
        files.read_cases(spark, path).collect()
    except Exception as failure:
        assert "case lacks expected_intent" in str(failure)
    else:
        raise AssertionError("a case without intent was accepted")


def test_fetch_failures_stay_in_their_row(spark):
    rows = fetched.read_fetched(spark, ["/etc/hostname", "/no/such/file"], "linecache:getline").collect()
    assert len(rows) == 2 and all(r.body is None and "TypeError" in r.error for r in rows)
    addresses = spark.createDataFrame([("a",), ("b",)], "url string")
    bodies = fetched.fetch_column(addresses, "url", lambda a: {"a": "<p>x</p>"}[a]).orderBy("url").collect()
    assert [r.body for r in bodies] == ["<p>x</p>", None]


def test_a_chain_of_articles_settles_in_few_rounds(spark):
    """Each row shares its id with the one before and its URL with the one after."""
    stored = spark.createDataFrame([], ARTICLE)
    links = 300
    incoming = spark.createDataFrame(
        [(n, "s", f"a{(n + 1) // 2}", f"u{n // 2}", f"title {n}", None, None, None, None, [], None) for n in range(1, links)],
        "arrival long, source_name string, source_article_id string, article_url string, title string, summary string, "
        "content string, author string, published_at timestamp, tags array<string>, raw_payload string",
    )
    seen, new = set(), []
    for n in range(1, links):
        keys = {("a", (n + 1) // 2), ("u", n // 2)}
        if not keys & seen:
            seen |= keys
            new.append(f"u{n // 2}")
    result = merge.upsert_articles(stored, incoming, F.timestamp_seconds(F.lit(0))).collect()
    assert sorted(r.article_url for r in result) == sorted(new)


def test_vectors_without_direction_are_near_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.9, 0.1]), (4, None), (5, [-1.0, 0.0])]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    probes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, probe array<float>")
    found = vectors.nearest_many(vecs, probes, 3).orderBy("query_id", "vector_rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(1, 1), (1, 3), (1, 5)]
    one = vectors.nearest(vecs, F.array(F.lit(1.0), F.lit(0.0)), 2).collect()
    assert [r.vec_id for r in one] == [1, 3]
    assert vectors.nearest(vecs, F.array(F.lit(0.0), F.lit(0.0)), 2).count() == 0


def test_a_common_keyword_and_a_limit(spark):
    """One keyword in every chunk and every question; short and spaced keywords count too."""
    corpus = spark.createDataFrame(
        [(i, i, f"Rules Section {'ABC'[i % 3]}", None, None, f"common word{i % 7} rb safety car") for i in range(90)],
        CHUNK_SCHEMA,
    )
    asked = spark.createDataFrame(
        [(q, ["common", f"word{q % 7}"] + (["rb", "safety car"] if q == 0 else []), [], []) for q in range(20)],
        "query_id long, keywords array<string>, phrases array<string>, sections array<string>",
    )
    everything = search.keyword_scores(corpus, asked)
    assert everything.count() == 20 * 90
    assert {r.keyword_hits for r in everything.filter("query_id = 0").collect()} == {3, 4}
    order = ["query_id", "keyword_rank", "chunk_id", "score"]
    full = search.keyword_candidates(everything, 5).select(order).orderBy(order).collect()
    cut = search.keyword_candidates(search.keyword_scores(corpus, asked, limit=5), 5).select(order).orderBy(order).collect()
    assert cut == full


def test_bad_numbers_spoil_one_value_only(spark):
    race_json = '{"MRData":{"RaceTable":{"Races":[{"season":"2026","round":"%s","raceName":"R"}]}}}'
    docs = spark.createDataFrame([(1, race_json % "x"), (2, race_json % "7")], "id long, body string")
    assert [r.round_number for r in race.parse_calendar(docs, "body", ["id"]).orderBy("id").collect()] == [None, 7]


def test_pairs_score_as_their_rows_do(spark):
    corpus = spark.createDataFrame([*CHUNKS, (5, 5, None, None, None, None)], CHUNK_SCHEMA)
    asked = [
        (1, ["red flag", "plank"], ["plank", "required", "b3", "release"], ["Section B"]),
        (2, [], ["c1"], ["Section C"]),
        (3, ["absent"], ["absent"], ["Section A"]),
    ]
    parsed = spark.createDataFrame(asked, "query_id long, phrases array<string>, keywords array<string>, sections array<string>")
    pairs = corpus.select("chunk_id", F.lit(0.5).alias("hybrid"), F.col("ord").alias("hybrid_rank")).crossJoin(parsed.select("query_id"))
    found = retrieval.scored_pairs(pairs, corpus, parsed)
    score = retrieval.score_chunk("content", "document_title", "article", F.col("phrases"), F.col("keywords"), F.col("sections"))
    rows = corpus.crossJoin(parsed).select("query_id", "chunk_id", search.phrase_matches("content", F.col("phrases")).alias("p"), score.alias("s"))
    expected = sorted(tuple(r) for r in rows.collect())
    assert sorted((r.query_id, r.chunk_id, r.phrase_matches, r.heuristic) for r in found.collect()) == expected


def test_rows_of_a_question_are_cut_as_a_full_order_cuts_them():
    rng = np.random.default_rng(3)
    best, rows = search.Best(7, 3), []
    for chunk in range(900):
        score, preferred = rng.integers(0, 6, 7).astype(float), rng.random(7) < 0.1
        best.add(900 - chunk, chunk, dict.fromkeys(search.EVIDENCE[1:], score) | {"preferred": preferred})
        rows += [(q, not preferred[q], -score[q], 900 - chunk) for q in range(7) if score[q] > 0]
    question, _, order, *_ = best.taken()
    expected = [(r[0], r[3]) for q in range(7) for r in sorted(r for r in rows if r[0] == q)[:3]]
    assert list(zip(question.tolist(), order.tolist())) == expected


def test_only_pairs_that_may_be_among_the_best_are_scored_in_full(monkeypatch):
    """The best rows are those of all pairs; few pairs are scored in full, also with more questions than a slice."""
    import pandas as pd

    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]
    draw = lambda n: [words[i] for i in np.minimum(rng.zipf(1.4, n), 400) - 1]
    chunks = pd.DataFrame({"chunk_id": range(2000), "ord": rng.permutation(2000)})
    chunks["document_title"] = chunks["lowered_title"] = [f"rules section {'abc'[i % 3]}" for i in range(2000)]
    chunks["section"] = chunks["lowered_section"] = [f"section {'abc'[i % 7 % 3]}" for i in range(2000)]
    chunks["lowered_article"] = [None if i % 2 else f"{words[i % 9]} {words[i % 11]}" for i in range(2000)]
    chunks["lowered"] = [None if i % 100 == 7 else " ".join(draw(rng.integers(5, 80))) for i in range(2000)]
    rules = [([f"{words[0]} {words[1]}"], f"{words[0]} {words[1]}")]
    rows = [
        {"query_id": q, "keywords": list(dict.fromkeys(draw(12))) + ["absent", "wa"][: q % 3], "sections": ["Section B"][: q % 4 == 0],
         "phrases": [rules[0][1]][: q % 2]}
        for q in range(90)
    ]
    monkeypatch.setattr(search, "QUESTION_SLICE", 32)
    block = search.QuestionBlock(rows, rules)
    matches = np.array([sum(k in (text or "") for text in chunks["lowered"]) for k in block.keywords])
    block.matches, block.idf = matches, np.log(1 + (2000 - matches + 0.5) / (matches + 0.5))
    full, scored = [], search.Scored.evidence
    monkeypatch.setattr(search.Scored, "evidence", lambda self, row, question: full.append(len(row)) or scored(self, row, question))
    order = ["query_id", "preferred", "score", "ord"]
    everything = pd.concat(search._scan(block, None)(iter([chunks]))).sort_values(order, ascending=[True, False, False, True])
    full.clear()
    best = pd.concat(search._scan(block, 5)(chunks[i : i + 500] for i in range(0, 2000, 500)))
    best = best.sort_values(order, ascending=[True, False, False, True]).reset_index(drop=True)
    assert best.equals(everything.groupby("query_id").head(5).reset_index(drop=True))
    assert sum(full) < 0.4 * len(everything), (sum(full), len(everything))


def test_a_text_meets_many_candidates_at_once(spark):
    """Candidates of one chunk come to its text in groups; many terms are looked up in an index of its words."""
    long, spaced = "x" * 40 + "yz", "two words"
    text = " ".join(f"word{i}a" for i in range(300)) + f" {long} {spaced}"
    within, terms = retrieval.Within(text), [f"rd{i}" for i in range(900)] + [long, long[5:], "xyz", "xzy", spaced, "o w", "a w"]
    assert [t in within for t in terms] == [t in text for t in terms] and within.runs
    corpus = spark.createDataFrame([(1, 1, None, None, None, text), (2, 2, "T", None, "word1a", None)], CHUNK_SCHEMA)
    asked = [(q, ["rd1"] if q % 2 else None, [f"rd{q}", f"d{q}a", "T"], ["t"]) for q in range(200)]
    parsed = spark.createDataFrame(asked, "query_id long, phrases array<string>, keywords array<string>, sections array<string>")
    pairs = corpus.select("chunk_id", F.lit(0.5).alias("hybrid"), F.col("ord").alias("hybrid_rank")).crossJoin(parsed.select("query_id"))
    found = retrieval.scored_pairs(pairs, corpus, parsed)
    score = retrieval.score_chunk("content", "document_title", "article", F.col("phrases"), F.col("keywords"), F.col("sections"))
    matches = F.coalesce(search.phrase_matches("content", F.col("phrases")), F.lit(0))
    rows = corpus.fillna("", ["content"]).crossJoin(parsed).select("query_id", "chunk_id", matches.alias("p"), score.alias("s"))
    # A null list matches nothing, as an empty one does.
    expected = [(q, c, max(p, 0), s) for q, c, p, s in rows.collect() if q % 2]
    assert sorted((r.query_id, r.chunk_id, r.phrase_matches, r.heuristic) for r in found.filter("query_id % 2 = 1").collect()) == sorted(expected)
    groups = found._jdf.queryExecution().analyzed().toString()
    assert "collect_list" in groups and retrieval.PAIRS_AT_ONCE < 200


def test_probes_keep_the_columns_that_name_them(spark):
    vecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<float>")
    parsed = spark.createDataFrame([("a question", ["x", "y"])], "query_id string, retrieval_queries array<string>")
    probes = spark.createDataFrame([("a question", n, [float(n), 1.0]) for n in range(3)], "query_id string, query_no int, probe array<float>")
    leg = retrieval.vector_leg(parsed, vecs.withColumnRenamed("vec_id", "chunk_id"), probes)
    assert "to_json" not in leg._jdf.queryExecution().analyzed().toString()
    assert [r.chunk_id for r in leg.orderBy("vector_rank").limit(2).collect()] == [0, 1]


def test_many_blocks_of_probes_stay_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TASKS_PER_CORE", 1)
    rows = [(i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(40)]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    probes = spark.createDataFrame(rows, "query_id long, probe array<float>")
    found = vectors.nearest_many(vecs, probes, 2, probe_block=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "hashpartitioning(query_id" in plan
    assert [r.vec_id for r in found.filter("vector_rank = 1").orderBy("query_id").collect()] == list(range(40))


def test_postings_leave_a_task_some_at_a_time():
    import pandas as pd

    tokens = [[f"t{i}" for i in range(n, n + 1000)] for n in range(50)]
    frames = list(search._count_tokens(iter([pd.DataFrame({"chunk_id": range(50), "tokens": tokens})])))
    assert sum(map(len, frames)) == 50_000 and max(map(len, frames)) <= search.ROWS_OUT + 1000


def test_position_is_read_once_a_row(spark):
    """The position asked for is not read from the message again for every entry of the standings."""
    entries = "array(named_struct('position', 2, 'name', 'b'), named_struct('position', 1, 'name', 'a'), null)"
    rows = spark.sql(f"SELECT message, {entries} AS standings FROM VALUES ('the 1st'), ('the 2nd'), ('the 3rd'), ('the 0th'), ('x') t(message)")
    picked = rows.select("message", race.pick_position(F.col("standings"), race.requested_position("message"))["name"].alias("name"))
    assert {r["message"]: r["name"] for r in picked.collect()} == {"the 1st": "a", "the 2nd": "b", "the 3rd": None, "the 0th": None, "x": "a"}
    plan = picked._jdf.queryExecution().analyzed().toString()
    assert plan.count("(st|nd|rd|th)") == 1, plan
