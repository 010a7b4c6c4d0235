"""Document fingerprints of closed syncmers, in DataFrame functions alone.

A text is a sequence of units: its words, and single characters of scripts that write no spaces. Of every ``K``
consecutive units, the k-mer is an anchor if, among the hashes of its inner runs of ``S`` units, the smallest is the
first or the last. That depends on nothing outside the k-mer, so equal passages have equal anchors wherever they
stand. A fingerprint is the anchors' hashes in text order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import id_and_text

K = 6
S = 2
UNIT = (
    r"[぀-ヿ㐀-鿿가-힯]|[^\x20\x09-\x0D぀-ヿ㐀-鿿가-힯]+"
)
#: Bytes of text that a task sorts at once, and the most parts that the ids are cut into.
PART_BYTES = 8 << 20
MOST_PARTS = 4096


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the anchors of a text column: 32-bit hashes in text order.

    A text in which no k-mer is an anchor, as one of fewer than ``K`` units, has one anchor of all its units; a text
    without units has none.
    """
    at = lambda array, i: F.get(F.col(array), i)
    inner = K - S + 1
    closed = lambda i: (
        F.least(*[at("_pairs", i + j) for j in range(inner)]) == F.least(at("_pairs", i), at("_pairs", i + inner - 1))
    )
    low = F.lit(0xFFFFFFFF)
    starts = F.when(
        F.size("_units") >= K, F.filter(F.sequence(F.lit(0), F.size("_units") - K), closed)
    ).otherwise(F.array().cast("array<int>"))
    hashes = F.transform("_starts", lambda i: F.xxhash64(*[at("_units", i + j) for j in range(K)]).bitwiseAND(low))
    whole = F.when(F.size("_units") > 0, F.array(F.xxhash64("_units").bitwiseAND(low))).otherwise(
        F.array().cast("array<bigint>")
    )
    words = F.regexp_extract_all(F.col(text), F.lit(UNIT), F.lit(0))
    after = F.slice("_units", 2, F.size("_units"))
    return (
        df.withColumn("_units", F.transform(words, lambda word: F.xxhash64(word)))
        .withColumn("_pairs", F.zip_with("_units", after, lambda a, b: F.xxhash64(a, b)))
        .withColumn("_starts", starts)
        .withColumn(out, F.when(F.size("_starts") > 0, hashes).otherwise(whole))
        .drop("_units", "_pairs", "_starts")
    )


def likeness(a: str, b: str) -> Column:
    """Distinct anchors in both as a share of those in either; two texts without anchors are alike."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def printed(anchors: str) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.hex(x)), "-")


def neighbours(docs: DataFrame, id_col: str, text_col: str, part_bytes: int) -> DataFrame:
    """Documents dealt over tasks by ranges of ids, each part with a copy of the document that follows its last.

    Quantiles of the ids cut the parts. They are ids of the table, and each is the largest of its part, so it is the
    one that follows the part above.
    """
    clean = id_and_text(docs, id_col, text_col)
    total = clean.agg(F.sum(F.octet_length("text") + 64).alias("bytes"), F.max("doc_id").alias("last")).first()
    parts = max(1, min(MOST_PARTS, (total["bytes"] or 0) // part_bytes))
    shares = [i / parts for i in range(1, parts)]
    inner = clean.agg(F.percentile_approx("doc_id", shares, 50 * parts).alias("q")).first()["q"] if shares else []
    bounds = sorted({*(inner or []), *([] if total["last"] is None else [total["last"]])})
    cuts = F.array(*[F.lit(b).cast("bigint") for b in bounds]).cast("array<bigint>")
    own = F.size(F.filter(cuts, lambda b: b < F.col("doc_id")))
    copy = F.array_contains(cuts, F.col("doc_id"))
    target = F.struct(F.col("part"), F.lit(False).alias("copy"))
    follower = F.struct(((F.col("part") + 1) % max(1, len(bounds))).alias("part"), F.lit(True).alias("copy"))
    placed = F.explode(F.when(copy, F.array(target, follower)).otherwise(F.array(target)))
    return (
        clean.withColumn("part", own)
        .withColumn("placed", placed)
        .select("doc_id", "text", F.col("placed.part").alias("part"), F.col("placed.copy").alias("copy"))
        .repartition(max(1, len(bounds)), "part")
    )


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """Fingerprint texts and their edited forms.

    Edited, the last half of a text's code points gives way to as many from the head of the next document in
    descending id order, the first following the last. Returns for every row ``doc_id, n_chars, edited_text, anchors,
    edited_anchors, near_edited, near_next``. A missing text is an empty one, and has no anchors; rows without an id
    are left out; rows with equal ids follow each other in an order that their texts decide.
    """
    order = Window.partitionBy("part").orderBy("copy", F.desc("doc_id"), F.xxhash64("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (
        with_anchors(neighbours(docs, id_col, text_col, part_bytes), "text", "anchors")
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_anchors", F.lead("anchors").over(order))
        .filter("not copy")
        .withColumn("n_chars", F.length("text"))
        .withColumn("near_next", likeness("anchors", "next_anchors"))
        .withColumn(
            "edited_text",
            F.concat(
                F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)
            ),
        )
        .drop("text", "next_text", "next_anchors")
    )
    return with_anchors(rows, "edited_text", "edited_anchors").select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_text",
        "anchors",
        "edited_anchors",
        likeness("anchors", "edited_anchors").alias("near_edited"),
        "near_next",
    )
