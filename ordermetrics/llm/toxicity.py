"""Toxicity scores from a small convolutional text classifier, trained and run in numpy.

A word is the sum of hashed embeddings, of the word and of its first four and six bytes.
Filters of widths 1 to 3 pass over the words, the maximum over the text of each filter
goes into a logistic output. A threshold for each language, found on rows that training
doesn't see, is moved to ``CUT``; the language is told from the words themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermetrics.llm.common import bounded_sample, held_out
from ordermetrics.session import written

WORDS, STEMS = 1 << 18, 1 << 16  # embedding rows; row 0 is the empty place
PREFIXES = (4, 6)
SIZE, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
LANGUAGE_BUCKETS = 1 << 14
PIECE = 1 << 15  # words scored at once
CUT = 0.3
_PLAIN = bytes(i if 48 <= i < 58 or 97 <= i < 123 or i >= 128 else i + 32 if 65 <= i < 91 else 32 for i in range(256))


@dataclass
class Model:
    words: np.ndarray
    stems: np.ndarray
    kernels: np.ndarray  # SIZE x (sum of WIDTHS * FILTERS)
    bias: np.ndarray
    out: np.ndarray
    base: float
    languages: list[str]
    language_weights: np.ndarray  # LANGUAGE_BUCKETS x languages
    cuts: np.ndarray  # logit at the threshold: languages, then all


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the text its row of the word table, and its rows of the stem table, a column a prefix."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    n = len(words)
    whole = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    stems = np.empty((n, len(PREFIXES)), np.uint32)
    for i, size in enumerate(PREFIXES):
        stems[:, i] = np.fromiter(map(zlib.crc32, [w[:size] for w in words]), np.uint32, n) + np.uint32(size)
    return 1 + whole % np.uint32(WORDS - 1), 1 + stems % np.uint32(STEMS - 1)


def _columns(width: int) -> slice:
    before = sum(w for w in WIDTHS if w < width) * FILTERS
    return slice(before, before + width * FILTERS)


def convolve(model: Model, words: np.ndarray, stems: np.ndarray) -> list[np.ndarray]:
    """For each width the filters at every place; the text ends in max(WIDTHS) - 1 empty places."""
    places = model.words[words]
    for i in range(len(PREFIXES)):
        places = places + model.stems[stems[:, i]]
    steps = places @ model.kernels
    out = []
    for width in WIDTHS:
        own = steps[:, _columns(width)].reshape(len(steps), width, FILTERS)
        total = own[:, 0].copy()
        for j in range(1, width):
            total[:-j] += own[j:, j]
        out.append(total)
    return out


# training -----------------------------------------------------------------------------


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, most_words: int) -> pd.DataFrame:
    """Bounded: ``per_class`` labelled rows of each class by least hash, those of more than ``most_words`` words left out."""
    labels = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = written(bounded_sample(labels, "toxic", per_class), "toxicity-sample")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t) for t in batch["text"]]
            rows = batch[["toxic", "lang"]].assign(words=[w.tobytes() for w, _ in found], stems=[s.tobytes() for _, s in found], fold=[zlib.crc32(f"fold {i}".encode()) % 5 for i in batch["doc_id"]], place=batch["doc_id"].astype(str))
            yield rows[[0 < len(w) <= most_words for w, _ in found]]

    rows = docs.select("doc_id", "text", "lang").join(chosen, "doc_id").mapInPandas(encode, "toxic int, lang string, words binary, stems binary, fold int, place string").toPandas()
    rows = rows.sort_values(["place", "words"], kind="stable").reset_index(drop=True)
    rows["words"] = [np.frombuffer(x, np.uint32).astype(np.int64) for x in rows["words"]]
    rows["stems"] = [np.frombuffer(x, np.uint32).astype(np.int64).reshape(-1, len(PREFIXES)) for x in rows["stems"]]
    return rows


def _document_odds(ids: list[np.ndarray], labels: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the class by table row, and which rows ``least`` documents have."""
    seen = np.zeros((2, size))
    for own, label in zip(ids, labels, strict=True):
        seen[label, np.unique(own)] += 1
    n = np.bincount(labels, minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    return odds, seen.sum(0) >= least


def fit(rows: pd.DataFrame, epochs: int = 4, rate: float = 0.02, least: int = 3, batch: int = 32) -> Model:
    """Adam on the logistic loss, classes weighted alike; gradients reach the places of the maxima."""
    draw = np.random.default_rng(11)
    label = rows["toxic"].to_numpy(np.int64)
    pad = np.zeros(max(WIDTHS) - 1, np.int64)
    flat = np.zeros((len(pad), len(PREFIXES)), np.int64)
    texts = [(np.concatenate([w, pad]), np.concatenate([s, flat])) for w, s in zip(rows["words"], rows["stems"], strict=True)]
    tables = []
    for name, size in (("words", WORDS), ("stems", STEMS)):
        odds, known = _document_odds(list(rows[name]), label, size, least)
        table = np.zeros((size, SIZE), np.float32)
        # a start from the class odds; rows of hardly any document stay empty, so unknown words say nothing
        table[:, 0] = np.clip(odds, -3, 3) / 3
        table[:, 1:] = draw.normal(0, 0.02, (size, SIZE - 1))
        table[~known] = 0
        table[0] = 0
        tables.append((table, known))
    width = sum(WIDTHS) * FILTERS
    kernels = draw.normal(0, 0.1, (SIZE, width)).astype(np.float32)
    kernels[0] += 0.4
    bias = np.full(len(WIDTHS) * FILTERS, -0.4, np.float32)
    out = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
    model = Model(tables[0][0], tables[1][0], kernels, bias, out, -2.0, [], np.zeros((0, 0)), np.zeros(1))
    weight = len(label) / (2 * np.maximum(1, np.bincount(label, minlength=2)))
    params = {"words": model.words, "stems": model.stems, "kernels": kernels, "bias": bias, "out": out}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    base_state, step = [0.0, 0.0], 0
    for _ in range(epochs):
        for chunk in np.array_split(draw.permutation(len(label)), max(1, len(label) // batch)):
            grads = {"kernels": np.zeros_like(kernels), "bias": np.zeros_like(bias), "out": np.zeros_like(out)}
            touched: dict[str, list] = {"words": [], "stems": []}
            base_grad = 0.0
            for k in chunk:
                words, stems = texts[k]
                maps = convolve(model, words, stems)
                at = [m[: len(words) - len(pad)].argmax(0) for m in maps]
                raw = np.concatenate([m[a, np.arange(FILTERS)] for m, a in zip(maps, at, strict=True)]) + bias
                pooled = np.maximum(raw, 0)
                p = 1 / (1 + np.exp(-np.clip(pooled @ out + model.base, -30, 30)))
                error = (p - label[k]) * weight[label[k]] / len(chunk)
                grads["out"] += error * pooled
                base_grad += error
                back = error * out * (raw > 0)
                grads["bias"] += back
                for i, width in enumerate(WIDTHS):
                    columns = _columns(width)
                    for f in np.flatnonzero(back[i * FILTERS : (i + 1) * FILTERS]):
                        g = back[i * FILTERS + f]
                        for j in range(width):
                            place, column = at[i][f] + j, columns.start + j * FILTERS + f
                            x = model.words[words[place]] + model.stems[stems[place]].sum(0)
                            grads["kernels"][:, column] += g * x
                            touched["words"].append((words[place], g * kernels[:, column]))
                            touched["stems"] += [(row, g * kernels[:, column]) for row in stems[place]]
            step += 1
            for name, grad in grads.items():
                grad += 1e-4 * params[name]
                _adam(params[name], grad, first[name], second[name], rate, step)
            for (name, parts), (_, known) in zip(touched.items(), tables, strict=True):
                if parts:
                    ids = np.array([i for i, _ in parts])
                    grown = np.array([g for _, g in parts])[known[ids] & (ids > 0)]
                    ids, back_to = np.unique(ids[known[ids] & (ids > 0)], return_inverse=True)
                    if len(ids):
                        grad = np.zeros((len(ids), SIZE), np.float32)
                        np.add.at(grad, back_to, grown)
                        part, a, b = params[name][ids], first[name][ids], second[name][ids]
                        _adam(part, grad, a, b, rate / 2, step)
                        params[name][ids], first[name][ids], second[name][ids] = part, a, b
            base_state[0] = 0.9 * base_state[0] + 0.1 * base_grad
            base_state[1] = 0.999 * base_state[1] + 0.001 * base_grad**2
            model.base -= rate * base_state[0] / (1 - 0.9**step) / (np.sqrt(base_state[1] / (1 - 0.999**step)) + 1e-8)
    return model


def _adam(value: np.ndarray, grad: np.ndarray, first: np.ndarray, second: np.ndarray, rate: float, step: int) -> None:
    first *= 0.9
    first += 0.1 * grad
    second *= 0.999
    second += 0.001 * grad * grad
    value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)


def _best_cut(logits: np.ndarray, label: np.ndarray) -> float:
    """The logit halfway below the positives' edge that gives the best F1."""
    order = np.argsort(-logits, kind="stable")
    value, hit = logits[order], np.cumsum(label[order])
    f1 = 2 * hit / (np.arange(1, len(value) + 1) + label.sum())
    f1[:-1][value[:-1] == value[1:]] = -1  # no cut between ties
    k = int(f1.argmax())
    return float((value[k] + value[min(k + 1, len(value) - 1)]) / 2)


def _languages(model: Model, rows: pd.DataFrame) -> None:
    rows = rows[rows["lang"].notna()]
    model.languages = sorted(rows["lang"].unique())
    counts = np.full((LANGUAGE_BUCKETS, len(model.languages)), 0.5)
    for lang, words in zip(rows["lang"], rows["words"], strict=True):
        counts[:, model.languages.index(lang)] += np.bincount(words % LANGUAGE_BUCKETS, minlength=LANGUAGE_BUCKETS)
    model.language_weights = np.log(counts / counts.sum(0)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, most_words: int = 4000, least_positives: int = 20) -> Model | None:
    """A model of the rows that aren't held out; None if they don't have both classes.

    Four fifths train, the rest sets the thresholds: one for all, and one for each
    language with ``least_positives`` rows of both classes there.
    """
    rows = _sample(docs, labels, per_class, most_words)
    if rows["toxic"].nunique() < 2:
        return None
    learn = rows[rows["fold"] != 0]
    if learn["toxic"].nunique() < 2:
        learn = rows
    model = fit(learn.reset_index(drop=True))
    _languages(model, learn)
    judge = rows[rows["fold"] == 0]
    if judge["toxic"].nunique() < 2:
        judge = rows
    logits, spoken = _logits(model, list(zip(judge["words"], judge["stems"], strict=True)))
    label = judge["toxic"].to_numpy(np.int64)
    every = _best_cut(logits, label)
    model.cuts = np.full(len(model.languages) + 1, every)
    for i in range(len(model.languages)):
        own = spoken == i
        if min(label[own].sum(), (1 - label[own]).sum()) >= least_positives:
            model.cuts[i] = _best_cut(logits[own], label[own])
    return model


# scoring ------------------------------------------------------------------------------


def _logits(model: Model, texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Logit and language index (-1: none) of each text, its words in pieces that overlap by the widest filter."""
    gap = max(WIDTHS) - 1
    pooled = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    spoken = np.zeros((len(texts), len(model.languages)))
    rows, words, stems, held = [], [], [], 0
    pad, flat = np.zeros(gap, np.int64), np.zeros((gap, len(PREFIXES)), np.int64)

    def pool() -> None:
        sizes = np.array([len(w) for w in words])
        starts = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
        sizes = np.minimum(sizes, PIECE)  # places beyond are the next piece's own
        all_words = np.concatenate([x for w in words for x in (w, pad)])
        maps = convolve(model, all_words, np.concatenate([x for s in stems for x in (s, flat)]))
        edges = np.stack([starts, starts + sizes], 1).ravel()  # own places, then the others
        edges = edges[edges < len(all_words)]
        best = np.concatenate([np.maximum.reduceat(m, edges, axis=0)[::2] for m in maps], axis=1)
        np.maximum.at(pooled, rows, best)
        if model.languages:
            np.add.at(spoken, rows, np.add.reduceat(model.language_weights[all_words % LANGUAGE_BUCKETS], edges, axis=0)[::2])

    for row, (w, s) in enumerate(texts):
        for at in range(0, len(w), PIECE):
            rows.append(row)
            words.append(w[at : at + PIECE + gap])
            stems.append(s[at : at + PIECE + gap])
            held += len(words[-1])
            if held >= PIECE:
                pool()
                rows, words, stems, held = [], [], [], 0
    if rows:
        pool()
    any_words = np.array([len(w) > 0 for w, _ in texts], bool)
    hidden = np.where(any_words[:, None], np.maximum(pooled + model.bias, 0), 0)
    return hidden @ model.out + model.base, np.where(any_words & bool(model.languages), spoken.argmax(1) if model.languages else -1, -1)


def score_texts(texts: list[str | None], model: Model | None) -> np.ndarray:
    """0 to 1; CUT is the threshold of the text's language. 0 without a model."""
    if model is None:
        return np.zeros(len(texts))
    logits, spoken = _logits(model, [features(t) for t in texts])
    return 1 / (1 + np.exp(-np.clip(logits - model.cuts[spoken] + np.log(CUT / (1 - CUT)), -40, 40)))


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with score and predicted (score >= CUT), from the whole text alone.

    Null and empty texts score as texts without any known word. Without a model every
    score is 0. Columns score and predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 11 MB, whatever the input

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = list(batch)
            yield pd.Series(np.concatenate([score_texts(texts[i : i + 256], shared.value) for i in range(0, len(texts), 256)] or [np.zeros(0)]))

    return docs.drop("score", "predicted").withColumn("score", predict("text")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
