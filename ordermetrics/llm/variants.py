"""Spelling variants: words one letter apart, by a bit-sliced position index.

For each (position, letter) the index has a bit set over the words of a group: those with
that letter at that place. A word's letters are read once; three bit sets are carried along,
of words met without an error, with one letter replaced (the same positions) and with one
letter more (positions shifted by one), so one machine word moves 64 candidates.

Groups keep this near the size of the vocabulary. Two words one edit apart, the
shorter of m letters, share their first m // 2 letters or else their last m - m // 2 (the edit lies
in one half). Words meet by these two keys, for m their length and one less; a pair that shares the
first half is counted there and nowhere else. Small keys are put together; a key with more words
than a block holds is dealt into blocks, and each two blocks meet in a group of their own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermetrics.session import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

BLOCK = 1024  # words a block holds, fewer where they are long
LETTERS = 1 << 18  # letters a block holds
LONGEST = 64  # lengths from here on share their count of groups


def planted(doc_id: str, word: str, every: int) -> str:
    """One in ``every`` (document, word) loses a letter, chosen by checksum."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, damage_every: int | None = None) -> DataFrame:
    """(word, n): lower-cased letter runs of at least ``min_length`` letters that occur ``min_count`` times or more.

    Only A-Z are lower-cased. With ``damage_every``, words are first damaged by :func:`planted`;
    a null doc_id reads as the empty text there. Null texts have no words. Counts are summed in each task before
    they are shuffled, so a word with a third of all occurrences costs one row a task.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        read = 0
        for batch in batches:
            for doc_id, text in zip(batch["d"], batch["text"], strict=True):
                if not text:
                    continue
                for word, k in Counter(RUN.findall(text.translate(_ascii_lower))).items():
                    if damage_every:
                        word = planted(doc_id, word, damage_every)
                    if len(word) >= min_length:
                        total[word] += k
                read += len(text)
                if len(total) > 300_000 or read > 1 << 25:
                    yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                    total, read = Counter(), 0
        yield pd.DataFrame({"word": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), "text")
    found = rows.mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= min_count)


# groups ----------------------------------------------------------------------------------


def _room(m):
    """Words of about m letters that a block holds."""
    return F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.lit(LETTERS) / m))).cast("long")


def _groups(words: DataFrame) -> DataFrame:
    """(word, n, block) with the group (half, m, page, i, j) each is compared in."""
    length = F.char_length("word")
    classes = words.select("word", "n", length.alias("len"), F.explode(F.array(length, length - 1)).alias("m"))
    h = F.floor(F.col("m") / 2).cast("int")
    rest = F.col("m") - h
    keyed = classes.withColumn("key", F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.substring(F.col("word"), F.lit(1), h).alias("part")),
        F.struct(F.lit(1).alias("half"), F.substring(F.col("word"), F.col("len") - rest + 1, rest).alias("part"))))).select(
        "word", "n", "m", "key.half", "key.part")
    sizes = keyed.groupBy("half", "m", "part").count().withColumnRenamed("count", "size")
    hot = sizes.where(F.col("size") > _room(F.col("m")))
    # how many groups each length gets; at most LONGEST + 1 rows reach the driver
    held = classes.groupBy(F.least(F.col("m"), F.lit(LONGEST)).alias("m")).agg(F.sum(1 / _room(F.col("m"))).alias("blocks")).collect()
    pages = {r["m"]: int(2 * r["blocks"]) + 1 for r in held}
    per_length = F.array(*[F.lit(pages.get(m, 1)) for m in range(LONGEST + 1)])
    joined = keyed.join(hot, ["half", "m", "part"], "left")
    blocks = F.ceil(F.col("size") / _room(F.col("m"))).cast("int")
    where = joined.select(
        "word", "n", "half", "m", "size",
        F.when(F.col("size").isNull(), F.pmod(F.xxhash64("part"), F.element_at(per_length, F.least(F.col("m"), F.lit(LONGEST)) + 1))).otherwise(
            F.xxhash64("part")).alias("page"),
        F.when(F.col("size").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("word"), blocks).cast("int")).alias("block"),
        F.when(F.col("size").isNull(), F.lit(0)).otherwise(blocks - 1).alias("last"))
    met = where.select("*", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    cold = F.col("size").isNull()
    return met.select(
        "word", "n", "block", "half", "m", "page", F.when(cold, -1).otherwise(F.least("block", "other")).alias("i"),
        F.when(cold, -1).otherwise(F.greatest("block", "other")).alias("j"))


# index -----------------------------------------------------------------------------------


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, the first column in the lowest bit."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    wide = -(-flags.shape[-1] // 64) * 8
    out = np.zeros((*packed.shape[:-1], wide), np.uint8)
    out[..., : packed.shape[-1]] = packed
    return out.view("<u8")


def _flags(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=-1, count=n, bitorder="little").view(bool)


class PositionIndex:
    """Bit sets over words, one for each letter that occurs at each position."""

    def __init__(self, words: np.ndarray, width: int):
        self.codes = np.ascontiguousarray(words.astype(f"<U{width}")).view("<u4").reshape(len(words), width)
        self.places = []
        for at in range(width):
            letters, which = np.unique(self.codes[:, at], return_inverse=True)
            sets = _bits(which.reshape(1, -1) == np.arange(len(letters) + 1).reshape(-1, 1))  # the last row is empty
            self.places.append((letters, sets))

    def having(self, at: int, wanted: np.ndarray) -> np.ndarray:
        """For each wanted letter the words with it at this position."""
        letters, sets = self.places[at]
        row = np.searchsorted(letters, wanted)
        there = letters[np.minimum(row, len(letters) - 1)] == wanted
        return sets[np.where(there, row, len(letters))]


def links(words: np.ndarray, m: int, half: int, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, same, longer): of the words of m letters (their places) the words one replaced letter away and one longer.

    ``words`` have m or m + 1 letters. With ``half`` 0 only pairs that share the first m // 2
    letters count, with 1 only pairs that don't. With ``block`` only pairs of different blocks do.
    """
    index = PositionIndex(words, m + 1)
    long = index.codes[:, m] != 0
    rows = np.flatnonzero(~long)
    clean = np.broadcast_to(_bits(np.ones((1, len(words)), bool)), (len(rows), -(-len(words) // 64))).copy()
    replaced, shifted, shared = np.zeros_like(clean), np.zeros_like(clean), clean
    for at in range(m):
        letters = index.codes[rows, at]
        here = index.having(at, letters)
        shifted = (shifted | clean) & index.having(at + 1, letters)
        replaced = (replaced & here) | (clean & ~here)
        clean = clean & here
        if at + 1 == m // 2:
            shared = clean
    allowed = shared if half == 0 else ~shared
    if block is not None:
        allowed = allowed & _bits(block[rows].reshape(-1, 1) != block.reshape(1, -1))
    return rows, replaced & _bits(~long) & allowed, (shifted | clean) & _bits(long) & allowed


def _compared(group: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, best_n, best): what this group adds for each of its words."""
    group = group.sort_values(["n", "word"], ascending=[False, True], kind="stable")
    words, n = group["word"].to_numpy(str), group["n"].to_numpy()
    m, half = int(group["m"].iloc[0]), int(group["half"].iloc[0])
    block = group["block"].to_numpy() if group["i"].iloc[0] != group["j"].iloc[0] else None
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    if len(words) > 1 and (np.char.str_len(words) == m).any():
        rows, same, longer = links(words, m, half, block)
        # words stand in the order of preference, so the first set bit is the best
        both = _flags(same | longer, len(words))
        near[rows] += both.sum(axis=1)
        best[rows] = np.where(both.any(axis=1), both.argmax(axis=1), len(words))
        back = _flags(longer, len(words))
        near += back.sum(axis=0)
        best = np.minimum(best, np.where(back.any(axis=0), rows[back.argmax(axis=0)], len(words)))
    found = near > 0
    return pd.DataFrame({"word": words[found], "n_near": near[found], "best_n": n[best[found]], "best": words[best[found]]})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of words (word, n) with a word one edit away; best is the most frequent such, the least of equals."""
    parts = _groups(words).groupBy("half", "m", "page", "i", "j").applyInPandas(_compared, "word string, n_near long, best_n long, best string")
    # the least of (-n, word)
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("b"), "best")).alias("least")).select(
        "word", "n_near", (-F.col("least.b")).alias("best_n"), "least.best")


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root): where following ``steps`` (word, form) ends. Each round doubles the steps taken."""
    now = written(steps.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def grouped(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary (word, n) of distinct words of two letters or more.

    ``form`` is the near word of largest n (the least of equals) if it is at least ``ratio``
    times as frequent, else null; ``root`` is where the forms end, the word itself without one.
    Counts rise along forms, so they never meet again. No words give no rows.
    """
    words = written(words.select("word", "n"), "words")
    near = near_words(words)
    joined = words.join(near, "word", "left")
    enough = F.col("best_n") >= ratio * F.col("n")
    forms = written(joined.select(
        "word", F.when(enough, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(forms.where(F.col("form").isNotNull()))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
