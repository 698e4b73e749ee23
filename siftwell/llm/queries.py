"""The queries of this package, ``(spark, sf_dir) -> DataFrame``, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import chat, decontam, jaccard, kdshard, langid, lm, mixing, quality, secrets, warc
from siftwell.session import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", lm.held_out())
    model = lm.train_model(docs.where(~F.col("held_out")))
    return lm.score(docs, model, ["doc_id", "held_out"])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshard.kd_shards(table(spark, sf_dir, "documents"), shards=40)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "ordinal", secrets.redact(F.col("candidate")).alias("masked"), F.sha2("candidate", 256).alias("digest"), "score", "is_secret")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(decontam.row_key().alias("key"), "doc_id", "text")
    found = decontam.hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "n_windows", "coverage", "changed_slots")


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_sharding": op5_sharding,
    "op6_secret_scan": op6_secret_scan,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
    "op10_decontamination": op10_decontamination,
}

ORACLES = {
    "op7_chat_formatting": """
        WITH talks AS (
            SELECT *, CASE WHEN conv_id IS NULL THEN 'n' || row_number() OVER () ELSE 'c' || conv_id END AS talk FROM conversations
        ), turns AS (
            SELECT talk, conv_id, turn, role, text,
                   row_number() OVER w AS pos,
                   count(*) OVER (PARTITION BY talk) AS n_turns
            FROM talks
            WINDOW w AS (PARTITION BY talk ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
        ), prefixes AS (
            SELECT conv_id, pos, n_turns,
                   string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '')
                       OVER (PARTITION BY talk ORDER BY pos) AS rendered
            FROM turns
        ), whole AS (
            SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies, rendered
            FROM prefixes WHERE pos = n_turns GROUP BY n_turns, rendered
        )
        SELECT conv_id, n_turns, copies, rendered FROM whole
        WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.pos < p.n_turns AND p.pos = whole.n_turns AND p.rendered = whole.rendered)
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest,
                   count(*) OVER (PARTITION BY coalesce(html, '')) AS n
            FROM pages
        ), b AS (
            SELECT *, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits,
                   n > 1 AND page_id IS DISTINCT FROM newest AS revisit
            FROM p
        )
        SELECT page_id,
               CAST(strlen(body) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                   16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
                   + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
                   + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN revisit THEN newest END AS refers_to
        FROM b
    """,
}
