"""Registered queries of the numbered operators."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from salesloom.llm import (bpe, chat_format, collocations, exact_dedup, html_extract, jaccard_join, language_id, line_dedup, packing, quality_rules,
                           sharding, toxicity, whitening)

WORD_BPE = os.environ.get("SALESLOOM_WORD_BPE", public_tokenizers.path("word_bpe_49k.json"))
BYTE_BPE = os.environ.get("SALESLOOM_BYTE_BPE", public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), WORD_BPE)


def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extracted(table(spark, folder, "pages"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), BYTE_BPE)


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One batch, all documents, against an index of its own."""
    index = exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    out = exact_dedup.deduplicate(table(spark, folder, "documents"), index)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = language_id.identified(docs.select("doc_id", "text"), language_id.fit(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = quality_rules.judged(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    out = toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "nearest",
                      "cosines", "nearest_labels")


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, folder, "documents").select("doc_id", "text"))


def op9_jaccard_groups(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"))


def op11_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = chat_format.with_probe(table(spark, folder, "conversations"))
    return chat_format.read_back(chat_format.formatted(turns))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mined(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_main_text, op3_best_fit_packing, op4_exact_dedup, op5_language,
                                   op6_quality_rules, op7_toxicity, op8_line_dedup, op9_jaccard_groups, op10_sharding, op11_chat_format, op12_collocations,
                                   op13_whitening)}
