"""Queries of the operators that work on tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfolio.llm.fingerprints import fingerprints
from tallyfolio.llm.packing import pack_documents
from tallyfolio.llm.pieces import round_trip_column
from tallyfolio.llm.pitman_yor import pitman_yor_scores
from tallyfolio.llm.registry import query, table


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of ``documents`` in sequences of 2048 ids of the vocabulary ``byte_bpe_50k``."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op9_pitman_yor")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    scores = pitman_yor_scores(table(spark, sf_dir, "documents"), learned)
    return scores.select("doc_id", (~learned).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = round_trip_column(docs, path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


@query("op4_lz_fingerprint")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
