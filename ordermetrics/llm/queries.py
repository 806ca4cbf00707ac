"""The operators over the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermetrics.llm import (
    chat, cleaning, decontaminate, langid, lines, packing, pq, setsketch, shards, toxicity, variants, warc, whitening)
from ordermetrics.llm.common import held_out, table, utf8, vocabulary
from ordermetrics.session import written


def op1_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return pq.near_vectors(table(spark, folder, "embeddings"), threshold=0.9)


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.drop_recurring_lines(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(utf8("text"), 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


def op4_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = setsketch.near_duplicates(table(spark, folder, "documents"), numerator=85, denominator=100, width=3)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = chat.with_control_texts(spark, folder)
    return chat.digests(written(chat.format_conversations(rows, vocabulary("byte_bpe_50k.json")), "formatted"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), window=2048, end_id=1, with_ids=False)


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.train_on_open(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = shards.shard(table(spark, folder, "documents"), 8)
    return placed.select(
        "doc_id", shards.size_of().alias("size"), F.crc32(utf8("text")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write_archives(warc.marked(table(spark, folder, "pages")))
    return warc.read_records(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = cleaning.cleaned(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed", "lost_chars", F.sha2(utf8("text"), 256).alias("text_sha256"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"), components=8)


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = variants.word_counts(table(spark, folder, "documents"), min_length=5, min_count=3, damage_every=97)
    return variants.grouped(words, ratio=2).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_embedding_dedup, op2_decontamination, op3_line_dedup, op4_minhash_dedup, op5_chat_format,
        op6_packing, op7_language_id, op8_toxicity, op9_sharding, op10_warc, op11_quality_rules,
        op12_whitening, op13_spelling_variants)}
