"""One query for each operator over its whole table, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, line_dedup, minhash, secrets, sentencepieces, sharding, telephony, token_counts, toxicity
from .util import read_table

SHARDS = 40
TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
PROBE = "\\### Assistant: </turn> ok"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), most=512)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=2, threshold=0.8)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return chat.read_back(chat.format_turns(rows.union(probe)))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, the two best scores, CRC-32 of the ids, and whether decoding gives the text back."""
    return sentencepieces.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(read_table(spark, sf_dir, "documents"), shards=SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.media_digests(telephony.store_media(read_table(spark, sf_dir, "documents")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_shared", "n_live", "most_repos", "live_spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_line_dedup, op3_token_counts, op4_minhash, op5_toxicity, op6_chat_formatting, op7_sentencepiece, op8_sharding, op9_telephony, op10_secrets)
}
ORACLES: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE, "op4_minhash": minhash.ORACLE, "op6_chat_formatting": chat.ORACLE}
