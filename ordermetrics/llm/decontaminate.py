"""Benchmark decontamination by winnowed word k-grams.

Every window of ``window`` words keeps the least hash of its word k-grams. A span of
``window`` words that a document shares with an item has the same least hash on both
sides, so the join of these fingerprints misses no shared span. Hits are extended to
the whole windows by comparing their words. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermetrics.llm.common import ascii_lower, text_key
from ordermetrics.session import written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 4  # words hashed together; window - GRAM + 1 of them lie in a window


def _words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``w``: the words of ``text``; none for null."""
    df = df.withColumn("w", F.split(ascii_lower(text), SEPARATORS))
    first, last = F.col("w")[0] == "", F.element_at("w", -1) == ""
    inner = F.slice("w", F.when(first, 2).otherwise(1), F.greatest(F.size("w") - first.cast("int") - last.cast("int"), F.lit(0)))
    return df.withColumn("w", F.when(F.col("w").isNull(), F.array().cast("array<string>")).otherwise(inner))


def _shifted(h: str, by: int) -> Column:
    return F.slice(h, by + 1, F.greatest(F.size(h) - by, F.lit(0)))


def _trim(h: str, less: int) -> Column:
    return F.slice(h, 1, F.greatest(F.size(h) - less, F.lit(0)))


def _fingerprints(df: DataFrame, window: int) -> DataFrame:
    """Adds ``least``: for every window start the least k-gram hash of the window."""
    pair = lambda x, y: F.xxhash64(x, y)
    lower = lambda x, y: F.least(x, y)
    df = df.withColumn("least", F.when(F.size("w") >= window, F.transform("w", lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")))
    for by in (1, 2):  # two words, then four
        df = df.withColumn("least", F.zip_with(_trim("least", by), _shifted("least", by), pair))
    span, grams = 1, window - GRAM + 1
    while span < grams:
        by = min(span, grams - span)
        df = df.withColumn("least", F.zip_with(_trim("least", by), _shifted("least", by), lower))
        span += by
    return df


def _phrase(start: Column, length: int) -> Column:
    return F.array_join(F.slice("w", start, length), " ")


def _spans(starts: Column, length: int) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(length).alias("words"), _phrase(s, length).alias("phrase")))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(phrase, words, print, item): every window of each item, an item of fewer words being one.

    ``print`` is the fingerprint of a full window; a shorter one has null and ``word``,
    the word of least hash, instead.
    """
    items = _fingerprints(_words(items), window).where(F.size("w") > 0)
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    full = items.where(F.size("w") >= window).select(
        item, "w", F.posexplode_outer("least").alias("at", "print")).select(
        _phrase(F.col("at") + 1, window).alias("phrase"), F.lit(window).alias("words"), "print", F.lit(None).cast("string").alias("word"), "item")
    short = items.where(F.size("w") < window).select(
        F.array_join("w", " ").alias("phrase"), F.size("w").alias("words"), F.lit(None).cast("bigint").alias("print"),
        F.array_min(F.transform("w", lambda x: F.struct(F.xxhash64(x), x.alias("word"))))["word"].alias("word"), item)
    return full.union(short).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` (doc_id, text) with n_words, n_hit, n_items, items (sorted), contaminated.

    A word of a document is hit if it lies inside any occurrence of an item window.
    Null or word-free texts have no words and no hits; repeated rows each get their row;
    an item without words never occurs, a null item_id counts as the empty id; without
    items nothing is hit. Other columns of ``docs`` are left out.

    Fingerprints are stored once per document; how the join with the items' runs is
    decided by the measured size of the stored item table. Only texts of documents
    with a matching fingerprint are cut into phrases.
    """
    windows = written(item_windows(items, window), "item-windows")
    prints = written(windows.where("print is not null").select("print").distinct(), "item-prints")
    short = sorted(r.words for r in windows.where(F.col("words") < window).select("words").distinct().collect())

    docs = docs.select("doc_id", "text")
    narrow = _fingerprints(_words(docs.withColumn("t", text_key())).select("doc_id", "t", "w"), window)
    seen = [F.array_distinct("least").alias("prints")] + ([F.array_distinct("w").alias("keys")] if short else [])
    stored = written(narrow.select("doc_id", "t", F.size("w").alias("n_words"), *seen), "fingerprints")
    found = stored.select("doc_id", "t", F.explode("prints").alias("print")).join(prints, "print", "left_semi")
    found = found.groupBy("doc_id", "t").agg(F.collect_set("print").alias("prints"))
    if short:
        words = windows.where("word is not null").select("word").distinct()
        by_word = stored.select("doc_id", "t", F.explode("keys").alias("word")).join(words, "word", "left_semi").select("doc_id", "t").distinct()
        found = found.withColumn("word", F.lit(False)).union(
            by_word.select("doc_id", "t", F.array().cast("array<bigint>"), F.lit(True)))
        found = found.groupBy("doc_id", "t").agg(F.flatten(F.collect_list("prints")).alias("prints"), F.max("word").alias("word"))
    found = written(found, "suspects").withColumnsRenamed({"doc_id": "id", "t": "k"})

    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("k"))
    suspects = docs.withColumn("t", text_key()).join(found, same).dropDuplicates(["doc_id", "t"])
    suspects = _fingerprints(_words(suspects), window)
    numbers = lambda length: F.when(F.size("w") >= length, F.sequence(F.lit(1), F.size("w") - (length - 1))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(numbers(window), lambda s: F.array_contains("prints", F.get("least", s - 1)))
    spans = _spans(starts, window)
    if short:
        none = F.array().cast("array<struct<start:int,words:int,phrase:string>>")
        spans = F.concat(spans, *[F.when(F.col("word"), _spans(numbers(n), n)).otherwise(none) for n in short])
    # outer: the filter that Spark derives for a plain explode would repeat the whole chain of expressions
    spans = suspects.select("doc_id", "t", F.explode_outer(spans).alias("s")).select("doc_id", "t", "s.*")
    matched = spans.join(windows.select("phrase", "words", "item"), ["phrase", "words"])
    hits = matched.groupBy("doc_id", "t").agg(
        F.collect_set(F.struct("start", "words")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["words"] - 1))))
    hits = hits.select(F.col("doc_id").alias("id"), F.col("t").alias("k"), F.size(covered).cast("long").alias("n_hit"), "items")
    out = stored.select("doc_id", "t", "n_words").join(hits, same, "left")
    return out.select(
        "doc_id", "t", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; all columns stay."""
    bad = contamination(docs, items, window).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (text_key() == bad["_t"]), "left_anti")
