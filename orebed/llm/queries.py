"""Registered queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm.class_lm import score_texts
from orebed.llm.class_lm import train as train_lm
from orebed.llm.conversation_repair import damage, repair
from orebed.llm.decontamination import find_overlaps
from orebed.llm.fingerprints import versions
from orebed.llm.hard_negatives import mine
from orebed.llm.language_id import LanguageModel, predict, train
from orebed.llm.line_dedup import remove_shared_passages
from orebed.llm.near_duplicates import near_duplicates
from orebed.llm.packing import pack
from orebed.llm.pii import KINDS, find_pii
from orebed.llm.pii import train as train_pii
from orebed.llm.quality_gam import at_least
from orebed.llm.quality_gam import score as score_quality
from orebed.llm.quality_gam import train as train_quality
from orebed.llm.sharding import interleave
from orebed.llm.tokens import pieces
from orebed.llm.url_filter import judge_urls
from orebed.llm.url_filter import train as train_urls
from orebed.session import ship_package

CAPACITY = 2048
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of documents in sequences, the ids as their CRC-32."""
    digests = pieces(docs, CAPACITY).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(digests, CAPACITY)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, words = train_lm(docs.where(id_remainder(10) != 0))
    return score_texts(docs, model, words).withColumn("held_out", id_remainder(10) == 0)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, item and shift with an overlap."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.*")


def id_remainder(divisor: int) -> Column:
    """CRC-32 of the doc_id as text, modulo ``divisor``; a NULL counts as empty text."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor


def language_model(docs: DataFrame) -> LanguageModel:
    return train(docs.where(id_remainder(4) != 2))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", (id_remainder(4) == 2).alias("held_out"))
    return predict(rows, language_model(docs)).drop("text")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, train_urls()).select(
        "page_id", "host", "path", "rule", "verdict", "p_unwanted"
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(table(spark, sf_dir, "documents")).select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        F.col("from_edited_near").alias("near_edited"), F.col("from_next_near").alias("near_next"),
        F.size("from_edited").alias("n_edited"),
    )


def _span_text(column: str) -> Column:
    parts = F.transform(
        column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the fixed patterns, ``n_added`` that of further spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, train_pii(docs))

    def count(kind: str) -> Column:
        own = F.filter("base_spans", lambda s: s["kind"] == kind)
        return F.size(own).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(count(kind) for kind in KINDS),
        F.sha2(_span_text("base_spans").cast("binary"), 256).alias("base_sha256"),
        _span_text("spans").alias("spans"),
        (F.size("spans") - F.size("base_spans")).cast("bigint").alias("n_added"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return interleave(rows, ["source"], SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_shared_passages(docs)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("bigint")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", moved.alias("label"), F.col("embedding").alias("vector"),
        (vec_id % 100 == 0).alias("anchor"),
    )
    return mine(rows)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = train_quality(docs, labels.where(id_remainder(4) != 2))
    rows = docs.withColumn("held_out", id_remainder(4) == 2)
    scored = score_quality(rows, model)
    return scored.select("doc_id", "held_out", "score", at_least(0.7).alias("predicted"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damage(rows), rows)


#: All rows against all anchors.
HARD_NEGATIVES_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
        CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id,
    CAST(row_number() OVER (
        PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other
    ) AS INTEGER) AS rank,
    s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""

#: The best edits from the last row to the first, one row a step.
CONVERSATION_SQL = """
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        [ord(c) FOR c IN string_split(
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '),
            ''
        )] AS bytes
    FROM conversations
), hashed AS (
    SELECT *, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, [CAST(b AS BIGINT) FOR b IN bytes]),
        lambda crc, b: list_reduce(
            [xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
            lambda v, bit: xor(v >> 1, 3988292384 * (v & 1))
        )
    )) % 20 AS kind
    FROM raw
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM hashed, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)
    WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (
            PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
        ) AS place,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
    FROM damaged
), repeated AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth
    FROM placed
), judged AS (
    SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
            WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        left(role, 1) AS initial,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS former
    FROM repeated
), counted AS (
    SELECT conv_id, count(*) AS n,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (former IS NOT NULL AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
), best AS (
    SELECT conv_id, n AS place, {'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]} AS s0,
        {'c': 4::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']} AS ss,
        {'c': 2::BIGINT, 'a': 'I', 'r': ['assistant:']} AS su,
        {'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]} AS sa
    FROM counted
    UNION ALL
    SELECT conv_id, place - 1,
        least(e0, {'c': eu.c + 2, 'a': 'I' || eu.a, 'r': ['user:'] || eu.r},
            {'c': ea.c + 4, 'a': 'II' || ea.a, 'r': ['user:', 'assistant:'] || ea.r}),
        least(es, {'c': eu.c + 2, 'a': 'I' || eu.a, 'r': ['user:'] || eu.r},
            {'c': ea.c + 4, 'a': 'II' || ea.a, 'r': ['user:', 'assistant:'] || ea.r}),
        least(eu, {'c': ea.c + 2, 'a': 'I' || ea.a, 'r': ['assistant:'] || ea.r}),
        least(ea, {'c': eu.c + 2, 'a': 'I' || eu.a, 'r': ['user:'] || eu.r})
    FROM (
        SELECT conv_id, place, least(d0, rerole_u, keep_s, keep_u) AS e0,
            least(ds, rerole_u, keep_u) AS es, least(du, rerole_a, keep_a) AS eu,
            least(da, rerole_u, keep_u) AS ea
        FROM (
            SELECT b.conv_id, b.place,
                {'c': s0.c + 3, 'a': 'D' || s0.a, 'r': s0.r} AS d0,
                {'c': ss.c + 3, 'a': 'D' || ss.a, 'r': ss.r} AS ds,
                {'c': su.c + 3, 'a': 'D' || su.a, 'r': su.r} AS du,
                {'c': sa.c + 3, 'a': 'D' || sa.a, 'r': sa.r} AS da,
                CASE WHEN stays THEN {'c': su.c + 2 + cut, 'a': 'R' || su.a, 'r': ['user:' || text] || su.r} END AS rerole_u,
                CASE WHEN stays THEN {'c': sa.c + 2 + cut, 'a': 'R' || sa.a, 'r': ['assistant:' || text] || sa.r} END AS rerole_a,
                CASE WHEN stays AND initial = 's' THEN {'c': ss.c + cut, 'a': 'K' || ss.a, 'r': [role || ':' || text] || ss.r} END AS keep_s,
                CASE WHEN stays AND initial = 'u' THEN {'c': su.c + cut, 'a': 'K' || su.a, 'r': [role || ':' || text] || su.r} END AS keep_u,
                CASE WHEN stays AND initial = 'a' THEN {'c': sa.c + cut, 'a': 'K' || sa.a, 'r': [role || ':' || text] || sa.r} END AS keep_a
            FROM best b JOIN (
                SELECT *, fault NOT IN ('blank', 'duplicate') AS stays,
                    CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut
                FROM judged
            ) j ON b.conv_id IS NOT DISTINCT FROM j.conv_id AND b.place = j.place
        )
    )
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
    coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit,
    sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counted c ON i.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON i.conv_id IS NOT DISTINCT FROM b.conv_id AND b.place = 0
"""

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_url_filter": op6_url_filter,
    "op7_fingerprints": op7_fingerprints,
    "op8_pii": op8_pii,
    "op9_sharding": op9_sharding,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_quality": op12_quality,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE = {
    "op11_hard_negatives": HARD_NEGATIVES_SQL, "op13_conversation_repair": CONVERSATION_SQL,
}
