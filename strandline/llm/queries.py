"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from . import balltree, chat, langid, mixing, neardup, nndescent, packing, suffixes, tokens, warc
from .shared import save


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.classes(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return nndescent.nearest(table(spark, sf_dir, "embeddings"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(table(spark, sf_dir, "documents")).drop("loss_tokens")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("uri")


def op6_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return tokens.length_histogram(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs)
    out = langid.with_language(docs.select("doc_id", "text"), model)
    return save(out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return balltree.top_k(save(balltree.quantised(table(spark, sf_dir, "embeddings"))))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffixes.removal(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.WEIGHTS, seed=mixing.SEED)


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_nearest": op2_nearest,
    "op3_chat": op3_chat,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_lengths": op6_lengths,
    "op7_language": op7_language,
    "op8_top_k": op8_top_k,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_mixing": op10_mixing,
}

#: Base32 of a SHA-1 in plain SQL: five bits at a time from the hex digits.
_B32 = "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INTEGER), 1)), 'string_agg', '')"

ORACLE_SQL = {
    "op3_chat": chat.ORACLE,
    "op5_warc": f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
  d AS (SELECT h, max(page_id) AS response FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < response THEN response END AS refers_to
FROM p JOIN d USING (h)""",
    "op10_mixing": mixing.oracle(),
}
