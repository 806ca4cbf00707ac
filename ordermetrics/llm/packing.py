"""Order-preserving packing of documents into windows of tokens.

The documents of a partition, in their order, make one stream of ids. Dynamic programming
chooses the cuts: windows of at most ``window`` ids that end at a document (free), a
sentence, or inside a long sentence (penalties in tokens), so that padding plus penalties
is least. Padding is linear in the window's start, so a monotone queue of starts gives
each cut its best predecessor in constant time.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from ordermetrics.llm.common import freed

STREAM = 1 << 19  # ids a task holds before it fixes cuts
REMEMBERED = 300_000  # words met since the last change after which the others are forgotten
HELD_BYTES = 1 << 25  # of words and ids remembered; more than that forgets as well
LONG = 64  # bytes of a word that is remembered for longer
MARKS = ".,;:!?%#&*$()[]{}-+=/@~^_"
TOGETHER = 1 << 21  # characters of texts that are encoded together, more if one text has more
INSIDE = 128  # a sentence may be cut after so many ids
SENTENCE_ENDS = (".", "!", "?", "…", "。")


class Encoder:
    """Ids of texts.

    The tokenizer's words never span white space, so each stretch between blanks is
    encoded once and remembered. A stretch of letters with marks behind is its letters
    and those marks, which the tokenizer parts as well; letters not seen yet are encoded
    many at once, and the ids that end a word tell them apart. Words and ids stand in arrays, some
    40 bytes a word, as a worker holds them beside all its later tasks. When the words met since the
    last change are many, the others are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.sentence = self.final.copy()
        for token, number in vocabulary.items():
            self.final[number] = token.endswith("</w>")
            self.sentence[number] = self.final[number] and token.removesuffix("</w>")[-1:] in SENTENCE_ENDS
        self._hold(pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _hold(self, words: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Remembers just ``words``, whose ids stand in ``flat`` one word behind the other."""
        self.words, self.flat, self.sizes = words, flat, sizes
        self.starts, self.met = np.cumsum(sizes) - sizes, np.zeros(len(words), bool)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text in turn. Texts go together, so that a word is looked up once for all of them."""
        group: list[str] = []
        size = 0
        for text in texts:
            if group and size + len(text) > TOGETHER:
                yield from self._encoded(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        if group:
            yield from self._encoded(group)

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = pc.split_pattern(pa.array([self._lower(t).replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        places, index = self._places(coded.dictionary), coded.indices.to_numpy()
        lengths = self.sizes[places][index]
        ends = np.cumsum(lengths)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[places][index] - (ends - lengths), lengths)]
        self._forget()
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield ids[a:b]

    @staticmethod
    def _lower(text: str) -> str:
        """The text composed and in lower case, in the tokenizer's order, so that fewer words differ.

        Left as it is where its case depends on what stands around, or tells special tokens,
        or where lower case lets marks compose that the tokenizer would leave apart.
        """
        if "<|" in text:
            return text
        if text.isascii():
            return text.lower()
        composed = unicodedata.normalize("NFC", text)
        low = composed.lower()
        return text if "Σ" in composed or "İ" in composed or not unicodedata.is_normalized("NFC", low) else low

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each of these distinct words stands among those remembered, which it joins if it is new."""
        # the words without marks behind are asked for in the same pass, as it reads all that is remembered
        bodies = pc.utf8_rtrim(words, MARKS)
        found = pc.index_in(pa.concat_arrays([words, bodies]), value_set=self.words)
        found, found_bodies = found[: len(words)], found[len(words) :]
        places, new = found.fill_null(0).to_numpy(), found.is_null().to_numpy(zero_copy_only=False)
        if new.any():
            places = np.where(new, len(self.words) + np.cumsum(new) - 1, places)
            self._learn(*(x.filter(found.is_null()).to_pylist() for x in (words, bodies, found_bodies)))
        self.met[places] = True
        return places

    def _forget(self) -> None:
        """When the words met since the last change are enough, or take too much, the others go, and so do long ones."""
        freed()
        if np.count_nonzero(self.met) <= REMEMBERED and self.words.nbytes + self.flat.nbytes <= HELD_BYTES:
            return
        keep = self.met & (pc.binary_length(self.words).to_numpy() <= LONG)
        self._hold(self.words.filter(pa.array(keep)), self.flat[np.repeat(keep, self.sizes)], self.sizes[keep])

    def _learn(self, words: list[str], bodies: list[str], places: list[int | None]) -> None:
        """Remembers ``words``, in their order, and behind them their bodies (the words without the marks behind), unless these have a place."""
        parted, whole, letters, known = [], set(), set(), {}
        for word, body, place in zip(words, bodies, places, strict=True):
            # letters still when composed and lower-cased, as the tokenizer sees them
            if body.isalpha() and (body.isascii() or unicodedata.normalize("NFC", body).lower().isalpha()):
                if place is None:
                    letters.add(body)
                else:
                    known[body] = self.flat[self.starts[place] : self.starts[place] + self.sizes[place]].tobytes()
                if body != word:
                    parted.append((word, body))
                    whole.add(word[len(body) :])
            else:
                whole.add(word)
        other = list(whole)
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[word] = np.array(found.ids, "<u4").tobytes()
        new = list(letters)
        for at in range(0, len(new), 4096):
            known.update(self._letters(new[at : at + 4096]))
        for word, body in parted:
            known[word] = known[body] + known[word[len(body) :]]
        added = words + list(letters.difference(words))
        raw = [known[w] for w in added]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        met = np.concatenate([self.met, np.ones(len(added), bool)])
        self._hold(
            pa.concat_arrays([self.words, pa.array(added, pa.large_string())]),
            np.concatenate([self.flat, np.frombuffer(b"".join(raw), "<u4")]), np.concatenate([self.sizes, sizes]))
        self.met = met

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """The ids of ``words``, each of letters alone, encoded at once."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * np.flatnonzero(self.final[ids]) + 4).tolist() if len(ids) else []
        if len(ends) != len(words):  # a letter that the tokenizer doesn't count as one
            return {w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words}
        raw = ids.tobytes()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *ends], ends, strict=False)}


def encoder_of(path: str) -> Encoder:
    """The encoder of this Python worker, which its later tasks find again with the words it knows.

    Functions that travel by value bring their own globals for each task, so it is held beside the worker's modules.
    """
    held = sys.modules.setdefault("ordermetrics_packing_worker", ModuleType("ordermetrics_packing_worker")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def cuts(places: np.ndarray, penalty: np.ndarray, window: int, last: bool) -> list[int]:
    """Ends of windows over a stream that starts at 0; ``places`` ascend, at most ``window`` apart.

    Costs ``window`` less its length plus the penalty of its end for each window. ``last``:
    the stream ends at its last place, with no padding counted there; otherwise the
    cheapest cut among those in the last window ends it.
    """
    place, price = [0, *places.tolist()], [0.0, *penalty.tolist()]
    cost, back = [0.0] * len(place), [0] * len(place)
    queue = deque([0])  # starts by place, their cost plus place ascending
    worth = [0.0] * len(place)
    for j in range(1, len(place)):
        here = place[j]
        while here - place[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        back[j] = i
        cost[j] = worth[i] + window - here + price[j]
        mine = worth[j] = cost[j] + here
        while queue and worth[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    near = [j for j in range(len(place) - 1, -1, -1) if place[-1] - place[j] <= window and (j or len(place) == 1)]
    end = len(place) - 1
    if last:
        i = min((j for j in [*near, 0] if place[-1] - place[j] <= window and j != end), key=lambda j: cost[j])
        back[end] = i
    elif near:
        end = min(near, key=lambda j: worth[j])  # cost for the same number of ids
    out = []
    while end:
        out.append(place[end])
        end = back[end]
    return out[::-1]


class Stream:
    """The documents of a task, cut into windows as they come."""

    def __init__(self, window: int, ends: np.ndarray, sentence: float, inside: float, with_ids: bool):
        self.window, self.ends, self.sentence, self.inside, self.with_ids = window, ends, sentence, inside, with_ids
        self.docs: list[tuple[object, int, np.ndarray]] = []  # doc_id, ids before those held, ids held
        self.totals: list[int] = []
        self.held, self.number = 0, 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, ids))
        self.totals.append(len(ids))
        self.held += len(ids)

    def _places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.concatenate([x[2] for x in self.docs])
        price = np.full(len(ids) + 1, -1.0)
        price[1:][self.ends[np.minimum(ids, len(self.ends) - 1)]] = self.sentence
        price[np.cumsum([len(x[2]) for x in self.docs])] = 0.0
        price[0] = 0.0
        known = np.flatnonzero(price >= 0)
        gaps = np.diff(known)
        wide = np.flatnonzero(gaps > INSIDE)
        step = min(INSIDE, self.window)
        inner = [np.arange(known[i] + step, known[i + 1], step) for i in wide]
        if inner:
            price[np.concatenate(inner)] = self.inside
        places = np.flatnonzero(price >= 0)[1:]
        return ids, places, price[places]

    def flush(self, last: bool) -> Iterator[tuple]:
        """Pieces of the windows whose cuts are fixed; without ``last`` the two final ones wait."""
        if not self.held:
            return
        ids, places, price = self._places()
        ends = cuts(places, price, self.window, last)
        if last:
            start = ends[-2] if len(ends) > 1 else 0
            left, ends = ends[-1] - start, ends[:-1]
            while left:  # the end of the stream goes in lengths that need no padding
                part = 1 << (left.bit_length() - 1)
                start, left = start + part, left - part
                ends.append(start)
        else:
            ends = ends[:-2]
        yield from self._pieces(ids, ends)

    def _pieces(self, ids: np.ndarray, ends: list[int]) -> Iterator[tuple]:
        base = TaskContext.get().partitionId() << 33
        at = start = 0  # document, ids before it in the stream
        for begin, end in zip([0, *ends], ends, strict=False):
            offset = 0
            while begin < end:
                doc_id, done, own = self.docs[at]
                take = min(end, start + len(own)) - begin
                piece = ids[begin : begin + take]
                row = (doc_id, done + begin - start, take, zlib.crc32(piece.tobytes()), self.totals[at], base + self.number, offset)
                yield (*row, piece) if self.with_ids else row
                begin, offset = begin + take, offset + take
                if begin == start + len(own):
                    at, start = at + 1, start + len(own)
            self.number += 1
        fixed = ends[-1] if ends else 0
        self.docs, self.totals = self.docs[at:], self.totals[at:]
        if self.docs and fixed > start:
            doc_id, done, own = self.docs[0]
            self.docs[0] = (doc_id, done + fixed - start, own[fixed - start :])
        self.held -= fixed


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, sentence: float = 8.0, inside: float = 48.0, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids.

    Each document is its ids and ``end_id``; null and empty texts are the end id alone.
    ``tokenizer`` is the path of a vocabulary file on every executor. Order is that of the
    input's partitions, which need no shuffle; sequences don't span partitions, and what
    is left at a partition's end goes in lengths of powers of two. Other columns and
    repeated doc_ids don't matter; without rows there is no piece.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer)
        stream = Stream(window, encoder.sentence, sentence, inside, with_ids)
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].astype(object), encoder.encode([t or "" for t in batch["text"]]), strict=True):
                stream.add(None if pd.isna(doc_id) else doc_id, np.append(ids, np.uint32(end_id)))
                if stream.held >= STREAM:
                    yield pd.DataFrame(list(stream.flush(False)), columns=names)
        yield pd.DataFrame(list(stream.flush(True)), columns=names)
        freed()

    return docs.select("doc_id", "text").mapInPandas(run, schema)
