"""Registered queries of the corpus operators, with production parameters, and their SQL where SQL can say the same."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthcheck.llm import (
    chat, decontaminate, digest_sql, exact_dedup, hard_negatives, html_text, language, merkle, mixing, near_dedup, pii, quality, token_files, toxicity,
)
from hearthcheck.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER_FILE = public_tokenizers.path("byte_bpe_50k.json")
PROBE = "</s>[INST] ok [/INST]"


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@query(
    "op1_exact_dedup",
    r"""
    WITH t AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
    )
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query("op2_language")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", fold() == 0)
    model = language.train(docs.where(~F.col("held_out")))
    return language.predict(docs, model)


@query("op4_token_files")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    written = token_files.write_ids(table(spark, folder, "documents"), TOKENIZER_FILE)
    return token_files.read_documents(spark, written)


@query("op5_mixing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op6_chat",
    rf"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{PROBE}'
      UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
    ), o AS (
      SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
    ), e AS (
      SELECT *, length(text) + len(regexp_extract_all(text, '<~*\|')) AS body,
             length(role) + len(regexp_extract_all(role, '<~*\|')) AS head FROM o
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(body + CASE WHEN before IS NOT DISTINCT FROM role THEN {len(chat.PART)}
                           ELSE head + {len(chat.TURN + chat.BODY + chat.END)} END) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE).alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


@query("op3_personal_data")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(pii.find_spans(table(spark, folder, "documents")))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op9_near_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, folder, "documents"))


@query("op8_decontamination")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_html_text")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query("op11_quality")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels")))


@query("op12_hard_negatives", digest_sql.hard_negatives())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(hard_negatives.candidates(vectors.withColumn("label", moved)), F.col("vec_id") % 100 == 0)


@query("op13_merkle", digest_sql.merkle())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    claim = F.when(chosen, low).otherwise(F.col("text"))
    return merkle.proofs(merkle.build(table(spark, folder, "documents"), claim))
