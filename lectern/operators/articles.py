"""Reads over the article table and insight per article."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as tx


def active(articles: DataFrame) -> DataFrame:
    return articles.filter(~F.col("is_deleted"))


def recent(articles: DataFrame, limit: int = 20) -> DataFrame:
    """Newest articles; undated ones come last."""
    return active(articles).orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(limit)


def by_id(articles: DataFrame, article_id: int | Column) -> DataFrame:
    return active(articles).filter(F.col("id") == article_id)


def backfill_worklist(articles: DataFrame, source: str, limit: int, only_missing: bool = True) -> DataFrame:
    rows = active(articles).filter(F.col("source_name") == source)
    if only_missing:
        rows = rows.filter(F.col("content").isNull())
    return rows.orderBy(F.desc("id")).limit(limit)


def corpus_text(title="title", summary="summary", content="content", tags="tags") -> Column:
    """Lower-cased text of all parts; a missing part still leaves its separator."""
    parts = [F.coalesce(tx.col(c), F.lit("")) for c in (title, summary, content)]
    joined_tags = F.coalesce(F.array_join(tx.col(tags), " "), F.lit(""))
    return F.lower(F.concat_ws(" ", *parts, joined_tags))


def category(
    text: Column | str,
    rules: Sequence[tuple] = vocab.CATEGORY_RULES,
    direct_terms: Sequence[str] = vocab.DIRECT_TERMS,
    direct: tuple[str, str] = vocab.DIRECT_CATEGORY,
    default: tuple[str, str] = vocab.DEFAULT_CATEGORY,
) -> Column:
    """Struct of key, label and votes: a direct term decides, else most keywords, first rule on ties."""

    def labelled(key, label, votes):
        return F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), votes.cast("long").alias("votes"))

    def vote(t: Column) -> Column:
        table = F.array(
            *[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), tx.string_array(words).alias("w")) for k, n, words in rules]
        )
        counted = F.transform(
            table,
            lambda r, i: F.struct(
                F.size(F.filter(r["w"], lambda w: F.contains(t, w))).cast("long").alias("votes"),
                (-i).alias("order"),
                r["k"].alias("key"),
                r["n"].alias("label"),
            ),
        )
        best = F.array_max(F.transform(counted, lambda c: F.struct(c["votes"], c["order"], c["key"], c["label"])))
        return F.when(
            F.exists(tx.string_array(direct_terms), lambda d: F.contains(t, d)), labelled(*direct, F.lit(0))
        ).otherwise(
            tx.let(
                best,
                lambda b: F.when(
                    b["votes"] > 0, F.struct(b["key"].alias("key"), b["label"].alias("label"), b["votes"].alias("votes"))
                ).otherwise(labelled(*default, F.lit(0))),
            )
        )

    return tx.let(text, vote)


def relevance(
    text: Column | str,
    category_key: Column | str,
    direct_terms: Sequence[str] = vocab.DIRECT_TERMS,
    possible_terms: Sequence[str] = vocab.POSSIBLE_TERMS,
    possible_categories: Sequence[str] = vocab.POSSIBLE_CATEGORIES,
    reasons: Mapping[str, str] = vocab.RELEVANCE_REASONS,
) -> Column:
    """Struct of relevance and reason; the reason names the first three terms found."""

    def first_three(found: Column) -> Column:
        return F.array_join(F.slice(found, 1, 3), ", ")

    def judged(level: str, reason: Column) -> Column:
        return F.struct(F.lit(level).alias("relevance"), reason.alias("reason"))

    found = F.struct(tx.hits(text, direct_terms).alias("direct"), tx.hits(text, possible_terms).alias("possible"))
    return tx.let(
        found,
        lambda f: F.when(
            F.size(f["direct"]) > 0, judged("direct", F.concat(F.lit(reasons["direct"]), first_three(f["direct"])))
        )
        .when(
            F.size(f["possible"]) > 0,
            judged("possible", F.concat(F.lit(reasons["possible"]), first_three(f["possible"]))),
        )
        .when(tx.col(category_key).isin(*possible_categories), judged("possible", F.lit(reasons["category"])))
        .otherwise(judged("none", F.lit(reasons["none"]))),
    )


def entities(text: Column | str, aliases: Mapping[str, Sequence[tuple[str, str]]] = vocab.ENTITY_ALIASES) -> Column:
    """Array of (type, name): names whose alias occurs, once each, in alias order within a type."""

    def found(t: Column) -> Column:
        per_type = []
        for kind, pairs in aliases.items():
            table = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(n).alias("name")) for a, n in pairs])
            names = F.array_distinct(
                F.transform(F.filter(table, lambda p: F.contains(t, p["alias"])), lambda p: p["name"])
            )
            per_type.append(_typed(names, kind))
        return F.concat(*per_type)

    return tx.let(text, found)


def _typed(names: Column, kind: str) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(kind).alias("entity_type"), n.alias("name")))


def key_points(title="title", summary="summary", content="content", limit: int = 3) -> Column:
    """First sentences of the first non-empty part, without repeats; the title when there are none."""
    source = tx.first_of(content, summary, title)
    return tx.let(
        F.slice(tx.sentences(source), 1, limit),
        lambda s: F.when(F.size(s) > 0, F.array_distinct(s)).otherwise(F.array(tx.col(title))),
    )


def summary_or_point(points: Column, title="title", summary="summary") -> Column:
    return tx.first_of(summary, F.get(points, 0), title)


def topics(text: Column | str, definitions: Sequence[tuple] = vocab.TOPICS, reason: str = vocab.TOPIC_REASON) -> Column:
    """Array of matched topics with the first three keywords found, in definition order."""

    def matched(t: Column) -> Column:
        table = F.array(
            *[
                F.struct(
                    F.lit(key).alias("topic_key"),
                    F.lit(title).alias("title"),
                    tx.string_array(words).alias("keywords"),
                    tx.string_array(questions).alias("questions"),
                )
                for key, title, words, questions in definitions
            ]
        )
        found = F.transform(
            table,
            lambda d: F.struct(
                d["topic_key"].alias("topic_key"),
                d["title"].alias("title"),
                F.filter(d["keywords"], lambda w: F.contains(t, w)).alias("found"),
                d["questions"].alias("questions"),
            ),
        )
        return F.transform(
            F.filter(found, lambda d: F.size(d["found"]) > 0),
            lambda d: F.struct(
                d["topic_key"].alias("topic_key"),
                d["title"].alias("title"),
                F.concat(F.lit(reason), F.array_join(F.slice(d["found"], 1, 3), ", ")).alias("reason"),
                d["questions"].alias("questions"),
            ),
        )

    return tx.let(text, matched)


def suggested_questions(
    matched: Column, title: Column | str = "title", generic: Sequence[str] = vocab.GENERIC_QUESTIONS, limit: int = 4
) -> Column:
    """Questions of the matched topics without repeats; generic ones about the title when no topic matched."""
    own = F.flatten(F.transform(matched, lambda m: m["questions"]))
    headline = tx.strip(title)
    fallback = F.array(
        *[F.concat(F.lit(g.split("%s")[0]), headline, F.lit(g.split("%s")[1])) for g in generic]
    )
    return F.slice(F.array_distinct(F.when(F.size(own) > 0, own).otherwise(fallback)), 1, limit)


def linked_chunks(asked: DataFrame, found: DataFrame, limit: int = 3, questions_used: int = 3) -> DataFrame:
    """Chunks of each article's first questions in question order, each once, up to ``limit``.

    ``asked`` is ``(article_id, questions)`` and ``found`` ``(question, chunk_id, rank)``.
    """
    from lectern.operators.search import ranked

    listed = asked.select(
        "article_id", F.posexplode(F.slice("questions", 1, questions_used)).alias("question_no", "question")
    )
    first = (
        listed.join(found, "question")
        .groupBy("article_id", "chunk_id")
        .agg(F.min(F.struct("question_no", "rank")).alias("place"))
    )
    return ranked(first, "article_id", [F.asc("place")], limit, "position").select("article_id", "position", "chunk_id")
