"""Corpus preparation: five stages over ``documents``, each stored before the next reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermetrics.llm import decontaminate, langid, lines, packing, setsketch
from ordermetrics.llm.common import vocabulary
from ordermetrics.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language the model of these very documents tells; the others go."""
    return langid.known_language(docs, langid.train_on_open(docs)).select(*COLUMNS)


def recurring_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Recurring lines go from the texts; a document that loses all it had goes too."""
    cleaned = lines.drop_recurring_lines(docs, long_words=50, plain_numbers=True)
    left = cleaned.where((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", "[\n\t\r]", " ")) != ""))
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays: five words a shingle, 0.8 or more alike."""
    return setsketch.drop_near_duplicates(docs, numerator=80, denominator=100, width=5).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of training sequences of at most 2048 ids, with their ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), window=2048, end_id=1)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language), ("line_dedup", recurring_lines), ("near_dedup", near_copies),
    ("decontamination", benchmark_passages), ("packing", packed)]

# Language identification learns a model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in turn; returns what the last one does."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
