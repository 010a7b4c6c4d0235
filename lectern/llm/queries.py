"""The registered queries of the corpus operators, with SQL twins where SQL can say the same."""

from __future__ import annotations

import string
from functools import wraps

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import dialogues, fuse_dedup, lattice_lm, midstate, packing, rff_quality, segment_bpe, setsketch, sharding, syncmers, token_files, warc, wrappers
from lectern.session import ship_package
from lectern.sources.tables import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
FOLDS = 5
PASS_SCORE = 0.3
SHARDS = 40


def fold() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))


def op1_token_files(spark: SparkSession, root: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, root, "documents"), WORD_BPE, end_id=1)
    return token_files.read_token_files(manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op2_warc(spark: SparkSession, root: str) -> DataFrame:
    runs = warc.write_archives(table(spark, root, "pages"))
    index = warc.captures(warc.merge_runs(runs))
    return warc.read_archives(index, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    pieces = packing.cut_pieces(table(spark, root, "documents"), WORD_BPE, end_id=0)
    narrow = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place_pieces(narrow)


def op4_syncmers(spark: SparkSession, root: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, root, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        syncmers.printed("anchors").alias("fingerprint"),
        syncmers.printed("edited_anchors").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op5_setsketch(spark: SparkSession, root: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, root, "documents"))


def op6_sharding(spark: SparkSession, root: str) -> DataFrame:
    """Row counts are the law: they differ by one at most."""
    return sharding.shard_documents(table(spark, root, "documents"), SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_wrapper_induction(spark: SparkSession, root: str) -> DataFrame:
    return wrappers.main_text(table(spark, root, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    """The older half of the documents, by id, is the snapshot; the newer half is the incoming batch."""
    docs = table(spark, root, "documents")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5).alias("m")).first()["m"]
    return fuse_dedup.deduplicate(docs, F.col("doc_id") <= F.lit(middle))


def op9_segment_bpe(spark: SparkSession, root: str) -> DataFrame:
    encoded = segment_bpe.encode(table(spark, root, "documents"), BYTE_BPE, public_tokenizers.PATTERN)
    return segment_bpe.decode(encoded, BYTE_BPE, public_tokenizers.PATTERN).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_quality(spark: SparkSession, root: str) -> DataFrame:
    """One fold is held out, one calibrates, the others set the weights."""
    scored = rff_quality.score_documents(
        table(spark, root, "documents"), table(spark, root, "labels"), "quality", fold() != 0, fold() == 1
    )
    return scored.select(
        "doc_id",
        (fold() == 0).alias("held_out"),
        "score",
        (F.col("score") >= PASS_SCORE).cast("int").alias("predicted"),
    )


def op11_midstate_tree(spark: SparkSession, root: str) -> DataFrame:
    """Documents of fold 0 are tampered with: their texts lose the capitals A to Z."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    leaves = midstate.document_leaves(
        table(spark, root, "documents"),
        F.when(fold() == 0, lower).otherwise(F.col("text")),
        ("doc_id", "source", "lang", "n_chars", "text"),
        "doc_id",
        "source",
    )
    tree = midstate.build(leaves)
    folded = tree.fold(tree.leaves.withColumn("leaf", F.lower(F.hex("digest"))), "id", "leaf")
    subroots = tree.subroots.select("key", F.lower(F.hex("digest")).alias("subroot"))
    return folded.join(subroots, "key").select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        F.lit(tree.root).cast("string").alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == tree.root).alias("verified"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """One row in twenty of each kind is dropped, emptied, cut, repeated or given to the user."""
    space, key, turn = F.lit(dialogues.MISSING), F.col("conv_id").cast("string"), F.col("turn").cast("string")
    kind = F.crc32(F.concat(F.coalesce(key, space), F.lit(":"), F.coalesce(turn, space))) % 20
    text = F.coalesce("text", space)
    copies = F.when(kind == 3, 2).when(kind == 0, 0).otherwise(1)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def op12_dialogue_repair(spark: SparkSession, root: str) -> DataFrame:
    conversations = table(spark, root, "conversations")
    found = dialogues.repair(damaged(conversations))
    names = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return names.join(found, "key", "left").select(
        "conv_id",
        *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_lattice_lm(spark: SparkSession, root: str) -> DataFrame:
    """Fold 1 is held out; a row without an id is not."""
    held_out = F.coalesce(fold() == 1, F.lit(False))
    scored = lattice_lm.score_documents(table(spark, root, "documents"), PIECE_BPE, ~held_out)
    return scored.withColumn("held_out", ~F.col("learns")).drop("learns")


def pipeline(spark: SparkSession, root: str) -> DataFrame:
    return corpus_pipeline.run(spark, root)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_warc": op2_warc,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_syncmers": op4_syncmers,
    "op5_setsketch": op5_setsketch,
    "op6_sharding": op6_sharding,
    "op7_wrapper_induction": op7_wrapper_induction,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_segment_bpe": op9_segment_bpe,
    "op10_quality": op10_quality,
    "op11_midstate_tree": op11_midstate_tree,
    "op12_dialogue_repair": op12_dialogue_repair,
    "op13_lattice_lm": op13_lattice_lm,
    "pipeline": pipeline,
}

ORACLES = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages
        ), r AS (
            SELECT html, max(page_id) AS response FROM p WHERE size >= 1000 GROUP BY html
        )
        SELECT page_id, size AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               nullif(response, page_id) AS refers_to
        FROM p LEFT JOIN r ON p.html = r.html
    """,
    "op5_setsketch": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(
                       regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                       'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                       lambda x: x <> '') AS words
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ')
                   ELSE array_to_string(words[i:i + 3], ' ') END AS shingle, len(words) < 4 AS short
            FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i) WHERE len(words) > 0
        ), n AS (
            SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS inter
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.short = b.short AND a.doc_id <> b.doc_id
            GROUP BY 1, 2
        ), link AS (
            SELECT p, q FROM shared JOIN n x ON x.doc_id = p JOIN n y ON y.doc_id = q
            WHERE 100 * inter >= 80 * (x.size + y.size - inter)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT a, q FROM reach JOIN link ON b = p
        ), c AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM c LEFT JOIN n USING (doc_id)
    """,
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents WHERE doc_id IS NOT NULL
        ), g AS (
            SELECT norm, arg_min(doc_id, (-length(t), doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM d JOIN g USING (norm)
    """,
    "op11_midstate_tree": r"""
        WITH RECURSIVE c AS (
            SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text,
                   list_reduce(
                       list_prepend(4294967295, flatten(list_transform(
                           string_split(doc_id::VARCHAR, ''),
                           lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda a, b: CASE WHEN b < 0 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, b) END
                   ) AS state
            FROM documents
        ), t AS (
            SELECT *, CASE WHEN xor(state, 4294967295) % 5 = 0
                      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-')
                   || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front
            FROM c
        ), h AS (
            SELECT rid, doc_id, coalesce('s' || source, '') AS k,
                   sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(front || coalesce(strlen(other) || ':' || other, '-')) AS changed
            FROM t
        ), p AS (
            SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx,
                   count(*) OVER (PARTITION BY k) AS n
            FROM h
        ), low AS (
            SELECT k, 0 AS lev, idx, n, leaf AS v FROM p
            UNION ALL
            SELECT k, lev + 1, idx // 16, any_value((n + 15) // 16), sha256(string_agg(v, '' ORDER BY idx))
            FROM low WHERE n > 1 GROUP BY k, lev, idx // 16
        ), sub AS (
            SELECT k, v AS subroot, row_number() OVER (ORDER BY encode(k)) - 1 AS idx, count(*) OVER () AS n
            FROM low WHERE n = 1
        ), high AS (
            SELECT 0 AS lev, idx, n, subroot AS v FROM sub
            UNION ALL
            SELECT lev + 1, idx // 16, any_value((n + 15) // 16), sha256(string_agg(v, '' ORDER BY idx))
            FROM high WHERE n > 1 GROUP BY lev, idx // 16
        ), beside AS (
            SELECT p.rid, 0 AS tree, low.lev, low.idx, low.v
            FROM p JOIN low ON low.k = p.k AND low.n > 1 AND low.idx // 16 = p.idx // (16 ** (low.lev + 1))::BIGINT
                 AND low.idx <> p.idx // (16 ** low.lev)::BIGINT
            UNION ALL
            SELECT p.rid, 1, high.lev, high.idx, high.v
            FROM p JOIN sub ON sub.k = p.k
                 JOIN high ON high.n > 1 AND high.idx // 16 = sub.idx // (16 ** (high.lev + 1))::BIGINT
                 AND high.idx <> sub.idx // (16 ** high.lev)::BIGINT
        ), proof AS (
            SELECT rid, sha256(string_agg(v, '' ORDER BY tree, lev, idx)) AS proof_sha256 FROM beside GROUP BY rid
        ), fold_low AS (
            SELECT rid, k, 0 AS lev, idx, n, changed AS v FROM p
            UNION ALL
            SELECT f.rid, f.k, f.lev + 1, f.idx // 16, any_value((f.n + 15) // 16),
                   sha256(string_agg(CASE WHEN low.idx = f.idx THEN f.v ELSE low.v END, '' ORDER BY low.idx))
            FROM fold_low f JOIN low ON low.k = f.k AND low.lev = f.lev AND low.idx // 16 = f.idx // 16
            WHERE f.n > 1 GROUP BY f.rid, f.k, f.lev, f.idx
        ), fold_high AS (
            SELECT f.rid, 0 AS lev, sub.idx, sub.n, f.v FROM fold_low f JOIN sub ON sub.k = f.k WHERE f.n = 1
            UNION ALL
            SELECT f.rid, f.lev + 1, f.idx // 16, any_value((f.n + 15) // 16),
                   sha256(string_agg(CASE WHEN high.idx = f.idx THEN f.v ELSE high.v END, '' ORDER BY high.idx))
            FROM fold_high f JOIN high ON high.lev = f.lev AND high.idx // 16 = f.idx // 16
            WHERE f.n > 1 GROUP BY f.rid, f.lev, f.idx
        )
        SELECT p.doc_id, p.leaf, sub.subroot, top.v AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
               g.v AS folded_root, g.v = top.v AS verified
        FROM p JOIN sub USING (k) JOIN (SELECT v FROM high WHERE n = 1) top ON true
        LEFT JOIN proof ON proof.rid = p.rid JOIN (SELECT rid, v FROM fold_high WHERE n = 1) g ON g.rid = p.rid
    """,
    "op12_dialogue_repair": r"""
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_reduce(
                       list_prepend(4294967295, flatten(list_transform(
                           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                           lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda a, b: CASE WHEN b < 0 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, b) END
                   ) AS state
            FROM conversations
        ), m AS (
            SELECT *, xor(state, 4294967295) % 20 AS kind FROM c
        ), d AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM m
        ), o AS (
            SELECT *, coalesce(conv_id::VARCHAR, '') AS k, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role),
                                      sha256(strlen(role) || ':' || role || text), copy) AS i
            FROM d
        ), f AS (
            SELECT *, left(role, 1) AS ini,
                   CASE WHEN bare = '' THEN 1
                        WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 2
                        WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                   lead(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS following
            FROM o
        ), nxt(s, t, role) AS (
            VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')
        ), moves AS (
            SELECT s, s AS t, '' AS letters, 0 AS price, '' AS line FROM nxt
            UNION ALL
            SELECT s, t, 'I', 2, chr(10) || role || ':' FROM nxt
        ), kept(ini, s, t) AS (
            VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)
        ), edges AS (
            SELECT f.k, f.i, v.s, v.t AS t, v.letters || 'D' AS letters, v.price + 3 AS price, v.line FROM f, moves v
            UNION ALL
            SELECT f.k, f.i, v.s, x.t, v.letters || 'R', v.price + 2 + (f.fault = 3)::INT,
                   v.line || chr(10) || x.role || ':' || f.text
            FROM f, moves v JOIN nxt x ON x.s = v.t WHERE f.fault NOT IN (1, 2)
            UNION ALL
            SELECT f.k, f.i, v.s, y.t, v.letters || 'K', v.price + (f.fault = 3)::INT,
                   v.line || chr(10) || f.role || ':' || f.text
            FROM f, moves v JOIN kept y ON y.s = v.t WHERE f.fault NOT IN (1, 2) AND y.ini = f.ini
        ), paths AS (
            SELECT DISTINCT k, 0 AS i, 0 AS s, 0 AS cost, '' AS audit, '' AS lines FROM f
            UNION ALL
            SELECT k, i, s, b.cost, b.audit, b.lines
            FROM (
                SELECT p.k, e.i, e.t AS s,
                       min({'cost': p.cost + e.price, 'audit': p.audit || e.letters, 'lines': p.lines || e.line}) AS b
                FROM paths p JOIN edges e ON e.k = p.k AND e.i = p.i + 1 AND e.s = p.s GROUP BY p.k, e.i, e.t
            )
        ), ends AS (
            SELECT p.k, min({'cost': p.cost + CASE p.s WHEN 2 THEN 2 ELSE 0 END,
                             'audit': p.audit || CASE p.s WHEN 2 THEN 'I' ELSE '' END,
                             'lines': p.lines || CASE p.s WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}) AS b
            FROM paths p JOIN (SELECT k, max(i) AS n FROM f GROUP BY k) z ON z.k = p.k AND z.n = p.i
            WHERE p.s <> 1 GROUP BY p.k
        ), report AS (
            SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                   count(*) FILTER (fault = 3) AS truncated,
                   count(*) FILTER (following IS NOT NULL AND ini || following NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY k
        )
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
               coalesce(b.audit, '') AS audit, sha256(coalesce(substr(b.lines, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN report ON report.k = coalesce(c.conv_id::VARCHAR, '') LEFT JOIN ends ON ends.k = report.k
    """,
}


def shipped(query):
    @wraps(query)
    def run(spark, root):
        ship_package(spark)
        return query(spark, root)

    return run


def queries() -> dict:
    return {name: shipped(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
