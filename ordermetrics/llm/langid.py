"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded sample of labelled rows (``per_language`` a language, least
hashes of doc_id first) and are summed by Spark. The log-probability matrix of
``BUCKETS`` rows and a column a language is broadcast; batches are scored as sparse
rows, by gathering and segment sums in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermetrics.llm.common import bounded_sample, freed, held_out
from ordermetrics.session import written

BITS = 15
BUCKETS = 1 << BITS
ORDERS = 3
PIECE = 1 << 18  # characters scored at once; longer texts go in pieces that overlap by two
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, float32
    prior: np.ndarray


def _letters() -> np.ndarray:
    """For code points below 65536: the lower-case letter, or 0."""
    out = np.zeros(1 << 16, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _codes(text: str, letters: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = raw >= len(letters)
    out = letters[np.where(high, 0, raw)]
    if high.any():
        for c in np.unique(raw[high]):
            if chr(c).isalpha():
                out[raw == c] = c
    return out


def _grams(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: (order, bucket of the gram that ends at each place from order - 1 on, whether it counts).

    A gram counts if its last character is a letter, or it ends a word.
    """
    seeds = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
    mixed = codes * seeds[0]
    mixed ^= mixed >> np.uint32(15)
    total = mixed
    for order in range(1, ORDERS + 1):
        if order > 1:
            total = total[:-1] * seeds[1] + mixed[order - 1 :]
        if not len(total):
            return
        h = (total + np.uint32(order)) * seeds[2]
        letter = codes[order - 1 :] != 0
        if order > 1:
            letter = letter | (codes[order - 2 : -1] != 0)
        yield order, (h >> np.uint32(32 - BITS)).astype(np.int64), letter


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Groups of (row, piece, characters known from the piece before) of about PIECE characters."""
    rows, parts, known, held = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text), PIECE):
            back = min(at, ORDERS - 1)
            rows.append(row)
            parts.append(text[at - back : at + PIECE])
            known.append(back)
            held += len(parts[-1])
            if held >= PIECE:
                yield rows, parts, known
                rows, parts, known, held = [], [], [], 0
    if rows:
        yield rows, parts, known


def _each_order(rows: list[int], parts: list[str], known: list[int], letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each counted gram, its bucket) for each order."""
    codes = _codes("".join(parts), letters)
    ends = np.cumsum([len(p) for p in parts])
    starts = np.concatenate([[0], ends[:-1]])
    part = np.repeat(np.arange(len(parts)), ends - starts)
    place = np.arange(len(codes)) - starts[part]
    fresh = np.array(known)[part]
    owner = np.array(rows)[part]
    for order, bucket, counts in _grams(codes):
        keep = counts & (place[order - 1 :] >= np.maximum(fresh[order - 1 :], order - 1))
        yield owner[order - 1 :][keep], bucket[keep]


def train(docs: DataFrame, per_language: int = 2000, smoothing: float = 0.5) -> Model:
    """Learns from text and lang of ``docs``; rows with a null text or lang teach nothing."""
    ids = bounded_sample(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), "lang", per_language)
    ids = written(ids.select("doc_id").distinct(), "language-sample")
    sample = docs.join(ids, "doc_id", "left_semi").where(F.col("lang").isNotNull()).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, held = _letters(), {}
        for batch in batches:
            for lang, group in batch.dropna().groupby("lang"):
                table = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for piece in _pieces(list(group["text"])):
                    for _, bucket in _each_order(*piece, letters):
                        table += np.bincount(bucket, minlength=BUCKETS)
        for lang, table in held.items():
            used = np.flatnonzero(table)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": table[used]})

    counted = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    table = np.zeros((BUCKETS, len(languages)))
    table[counted["bucket"], counted["lang"].map({x: i for i, x in enumerate(languages)})] = counted["n"]
    table += smoothing
    weights = np.log(table / table.sum(0)) if languages else table
    return Model(languages, weights.astype(np.float32), np.full(len(languages), -np.log(max(1, len(languages)))))


def score_texts(texts: list[str | None], model: Model, letters: np.ndarray) -> pd.DataFrame:
    """lang_pred and score (posterior) of each text; und and 0 for null or letterless ones. grams counts what was
    scored, fit is its mean log-probability in the predicted language."""
    total, grams = np.tile(model.prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
    for rows, parts, known in _pieces([t or "" for t in texts]):
        for owner, bucket in _each_order(rows, parts, known, letters):
            if len(owner):
                cuts = np.flatnonzero(np.diff(owner, prepend=-1))
                total[owner[cuts]] += np.add.reduceat(model.weights[bucket], cuts, axis=0, dtype=np.float64)
                grams[owner[cuts]] += np.diff(cuts, append=len(owner))
    if not model.languages:
        return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "grams": grams, "fit": 0.0})
    best, seen = total.argmax(1), grams > 0
    top = total.max(1, keepdims=True)
    score = 1 / np.exp(total - top).sum(1)
    names = np.array(model.languages, dtype=object)[best]
    names[~seen] = UNKNOWN
    fit = (top[:, 0] - model.prior[best]) / np.maximum(grams, 1)
    return pd.DataFrame({"lang_pred": names, "score": np.where(seen, score, 0.0), "grams": grams, "fit": fit})


def least_fit(model: Model) -> dict[str, float]:
    """The mean log-probability below which a text doesn't read like a language.

    In text of the language it is the sum of p log p over the buckets; letters the model never met fall into buckets at random, where it
    is the plain mean of log p. The bound lies half-way.
    """
    logs = model.weights.astype(np.float64)
    own, random = (np.exp(logs) * logs).sum(0), logs.mean(0)
    return dict(zip(model.languages, ((own + random) / 2).tolist(), strict=True))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the struct ``_p`` of what :func:`score_texts` tells."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of 4 bytes a language

    @F.pandas_udf("lang_pred string, score double, grams long, fit double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = _letters()
        for batch in batches:
            yield score_texts(list(batch), shared.value, letters)
            freed()

    return docs.withColumn("_p", predict("text"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, from the whole text alone.

    Null, empty and letterless texts are ``und`` with score 0; so is every text if the
    model learned no language. Columns lang_pred and score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    return _scored(docs, model).select(*docs.columns, "_p.lang_pred", "_p.score")


def train_on_open(docs: DataFrame, **settings) -> Model:
    """A model of the rows that aren't held out."""
    return train(docs.where(~held_out()), **settings)


def known_language(docs: DataFrame, model: Model, least: float = 0.5, least_grams: int = 30) -> DataFrame:
    """The documents whose language the model tells with a posterior of ``least`` and that read like it; columns stay.

    A posterior only compares the learned languages and is near 1 for any text, so a text of ``least_grams`` grams or more
    also needs the mean log-probability of :func:`least_fit`; shorter ones vary too much for it. A model that
    learned no language rejects nothing.
    """
    if not model.languages:
        return docs
    bound = F.create_map(*[x for name, value in least_fit(model).items() for x in (F.lit(name), F.lit(value))])
    known = (F.col("_p.lang_pred") != UNKNOWN) & (F.col("_p.score") >= least)
    reads = (F.col("_p.grams") < least_grams) | (F.col("_p.fit") >= F.element_at(bound, F.col("_p.lang_pred")))
    return _scored(docs, model).where(known & reads).select(*docs.columns)
