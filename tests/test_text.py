import random
import re

from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import dates
from lectern.functions import text as tx
from lectern.operators import chunking, questions, routing


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first().r


def test_packing_keeps_text_and_cap():
    rng = random.Random(7)
    heading = re.compile(vocab.HEADING_PATTERN)
    for _ in range(200):
        lines = []
        for _ in range(rng.randint(0, 12)):
            words = ["w" * rng.randint(1, 9) for _ in range(rng.randint(1, 14))]
            lines.append((rng.choice(["", f"B{rng.randint(1, 9)}.{rng.randint(1, 9)} "]) + " ".join(words)).strip())
        chunks = chunking.pack_page("\n".join(lines), 40, heading)
        assert "".join("".join(c["content"] for c in chunks).split()) == "".join("".join(lines).split())
        assert [c["chunk_index"] for c in chunks] == list(range(1, len(chunks) + 1))
        assert all(0 < len(c["content"]) <= 40 for c in chunks)


def test_heading_opens_its_chunk():
    chunks = chunking.pack_page("intro\nARTICLE 12 start\nbody\nb3.1 next", 1000, re.compile(vocab.HEADING_PATTERN))
    assert [(c["article"], c["content"]) for c in chunks] == [
        (None, "intro"),
        ("ARTICLE 12", "ARTICLE 12 start\nbody"),
        ("B3.1", "b3.1 next"),
    ]


def test_long_line_is_cut_at_spaces():
    # A window starts at the space it was cut at, so that space counts towards the cap.
    assert list(chunking.split_long_line("aaaa bbbb cccc", 9)) == ["aaaa", "bbbb", "cccc"]
    assert list(chunking.split_long_line("a" * 25, 10)) == ["a" * 10, "a" * 10, "a" * 5]


def test_unicode_whitespace_and_lines(spark):
    assert one(spark, " a　b\x1cc  ", tx.collapse) == "a b c"
    assert one(spark, "a\r\nb \x0bc", tx.lines) == ["a", "b", "c"]


def test_token_estimate(spark):
    assert [one(spark, v, tx.token_estimate) for v in ("", "abc", "abcdefgh", "红旗ab")] == [0, 1, 2, 2]


def test_slices(spark):
    assert one(spark, "", lambda c: tx.fixed_width_slices(c, 4)) == [""]
    assert one(spark, "abcdefghi", lambda c: tx.fixed_width_slices(c, 4)) == ["abcd", "efgh", "i"]


def test_mail_dates(spark):
    def parse(v):
        return one(spark, v, lambda c: F.date_format(dates.parse_mail_date(c), "yyyy-MM-dd HH:mm:ss"))

    assert parse("Mon, 06 Jul 2026 10:00:00 +0200") == "2026-07-06 08:00:00"
    assert parse("6 Jul 2026 10:00 GMT") == "2026-07-06 10:00:00"
    assert parse("Mon, 06 Jul 2026 10:00:00 EST") == "2026-07-06 15:00:00"
    assert parse("soon") is None


def test_synonyms_and_sections(spark):
    normalized = one(spark, "红旗 in sectionb?", questions.normalize_question)
    assert normalized == "红旗 in Section B? red flag"
    assert one(spark, "Section C plank wear", questions.preferred_sections) == ["Section C"]
    assert one(spark, "What about section a release", questions.preferred_sections) == ["Section A", "Section B"]


def test_rewrites_only_for_cjk(spark):
    assert one(spark, "red flag rules", questions.rewrite_question) == []
    rewritten = one(spark, "红旗 怎么办", questions.rewrite_question)
    assert rewritten[0] == f"红旗 怎么办 {vocab.REWRITE_SUFFIX}" and len(rewritten) == 2
    assert len(one(spark, "你好", questions.rewrite_question)) == 3


def test_phrases_and_keywords(spark):
    assert one(spark, "virtual safety car, parc fermé", questions.extract_phrases) == [
        "parc ferme", "safety car", "virtual safety car",
    ]
    assert one(spark, "Plank wear? (plank)", questions.expand_keywords) == ["plank", "wear", "thickness", "skid", "block"]


def test_routing_precedence(spark):
    def route(v, fallback=None):
        return one(spark, v, lambda c: routing.route(c, F.lit(fallback) if fallback else None))

    assert route("which rule applies to a pit stop") == "regulation"
    assert route("pit under the safety car") == "strategy"
    assert route("red flag restart") == "regulation"
    assert route("driver standings") == "race"
    assert route("latest headline") == "news"
    assert route("那呢", "race") == "race"
    assert route("hello there") == "general"
    assert route("?", "news") == "news"


def test_race_actions(spark):
    def action(v):
        return one(spark, v, lambda c: routing.plan(F.lit("race"), c)["action"])

    assert action("team and driver points") == "get_constructor_standings"
    assert action("driver points") == "get_driver_standings"
    assert action("上一站") == "get_previous_race"
    assert action("when is it") == "get_next_race"
    assert action("calendar") == "list_schedule"


def test_query_types(spark):
    def kind(v):
        return tuple(one(spark, v, routing.query_type))

    assert kind("overview of section B") == ("section_overview", "Section B")
    assert kind("第c部分 讲什么") == ("section_overview", "Section C")
    assert kind("FIA overview") == ("document_overview", None)
    assert kind("plank wear limit") == ("fact_lookup", None)
