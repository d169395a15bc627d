"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licenses, lm, media, mixing, packing, pii, quality, simhash, token_counts
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex_digits().alias("fingerprint"), "component_id")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), "n_unknown")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(turns))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(mixing.sizes_of(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.read_back(media.store(table(spark, sf_dir, "documents")))
    clips = F.transform("clips", lambda c: F.format_string("%d+%d@%.2f-%.2f", c.first, c.frames, c.start_s, c.end_s))
    return out.select(F.col("id").alias("doc_id"), *media.READ.names[1:7], F.array_join(clips, ",").alias("feature"))


def _of_kind(kind: str):
    return lambda s: s.startswith(f"{kind}:")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op1_simhash": op1_simhash, "op2_licenses": op2_licenses, "op3_quality": op3_quality, "op4_chat": op4_chat, "op5_tokens": op5_tokens, "op6_packing": op6_packing, "op7_mixing": op7_mixing, "op8_media": op8_media, "op9_pii": op9_pii, "op10_lm": op10_lm}
_SAID = "</s>[INST] ok [/INST]"
ORACLE: dict[str, str] = {
    "op2_licenses": licenses.oracle(),
    "op3_quality": quality.oracle(),
    "op7_mixing": mixing.oracle(),
    "op4_chat": chat.oracle(f"(SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')))"),
}
