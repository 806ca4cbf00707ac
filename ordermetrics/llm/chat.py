"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its
assistant texts meet the token spans by binary search. Control strings inside texts get
a backslash after their first character, which reading back takes out again.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from ordermetrics.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
SEGMENT = 1 << 20  # characters of a conversation rendered and encoded at once


@dataclass
class Template:
    """``OPEN role \\n text CLOSE \\n`` a turn."""

    controls: tuple[str, ...] = CONTROLS
    _inside: re.Pattern = field(init=False, repr=False)
    _escaped: re.Pattern = field(init=False, repr=False)

    def __post_init__(self) -> None:
        # with these two, matches never overlap and escaping can be undone
        firsts = {c[0] for c in self.controls}
        if any(x in firsts or x == "\\" for c in self.controls for x in c[1:]):
            raise ValueError("a control string may hold first characters of control strings only at its start")
        if any(a != b and b[1:].startswith(a[1:]) and a[0] == b[0] for a in self.controls for b in self.controls):
            raise ValueError("no control string may start with another")
        forms = [(re.escape(c[0]), re.escape(c[1:])) for c in self.controls]
        self._inside = re.compile("|".join(rf"(?:(?<={a})(?=\\*{b}))" for a, b in forms))
        self._escaped = re.compile("|".join(rf"(?:(?<={a})\\(?=\\*{b}))" for a, b in forms))

    def escape(self, text: str) -> str:
        return self._inside.sub(r"\\", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub("", text)

    def role(self, role: str) -> str:
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def plain_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role))

    def render(self, turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
        """The text and, ascending, the spans of the texts of role ``learn``."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{OPEN}{self.role(role)}\n", self.escape(text)
            if role == learn:
                spans.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, f"{CLOSE}\n"]
            at += len(head) + len(body) + len(CLOSE) + 1
        return "".join(parts), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns (role, text) of a rendered text."""
        out, at = [], 0
        while at < len(formatted):
            line, close = formatted.index("\n", at), formatted.index(CLOSE, at)
            out.append((self.plain_role(formatted[at + len(OPEN) : line]), self.unescape(formatted[line + 1 : close])))
            at = close + len(CLOSE) + 1
        return out


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask, start, end) a token: whether it meets a span, and the part of it that lies inside.

    Both are sorted. A span's first token is the first that ends after the span starts, its
    last the last that starts before the span ends; control strings stand between spans
    and are tokens of their own, so a token meets one span at most.
    """
    mask = np.zeros(len(offsets), bool)
    start, end = np.zeros(len(offsets), np.int64), np.zeros(len(offsets), np.int64)
    if not len(offsets) or not len(spans):
        return mask, start, end
    first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
    stop = np.searchsorted(offsets[:, 0], spans[:, 1], "left")
    for (low, high), a, b in zip(spans, first, stop, strict=True):
        if a < b:
            mask[a:b] = True
            start[a:b] = np.maximum(offsets[a:b, 0], low)
            end[a:b] = np.minimum(offsets[a:b, 1], high)
    return mask, start, end


def _chat_tokenizer(path: str, controls: tuple[str, ...]) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in controls])
    return tokenizer


SCHEMA = (
    "conv_id {kind}, part long, n_turns long, formatted string, ids array<int>, loss_mask array<boolean>, token_start array<int>, token_end array<int>")


def format_conversations(rows: DataFrame, tokenizer: str, template: Template | None = None, learn: str = "assistant") -> DataFrame:
    """One row a conversation: formatted, ids, loss_mask and, a token, the code points (start, end) that count.

    Rows are ordered by turn (nulls first), then role and text. Null role and text are
    empty; null conv_ids are one conversation; repeated rows are turns of their own. A
    conversation of more than ``SEGMENT`` characters comes as several rows, part counting
    them from 0 and cut between turns, so that none is held whole; control strings are
    tokens of their own, so the ids are those of the whole. ``tokenizer`` is the path of a
    byte-level vocabulary file on every executor.
    """
    template = template or Template()
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _chat_tokenizer(tokenizer, template.controls)
        current, part, held, turns = object(), 0, 0, []
        done: list[tuple[object, int, list[tuple[str, str]]]] = []

        def encoded() -> pd.DataFrame:
            rendered = [template.render(t, learn) for _, _, t in done]
            out = []
            for (conv_id, number, own), (text, spans), found in zip(done, rendered, encoder.encode_batch([t for t, _ in rendered], add_special_tokens=False), strict=True):
                mask, start, end = token_mask(np.array(found.offsets, np.int64).reshape(-1, 2), np.array(spans, np.int64).reshape(-1, 2))
                out.append((conv_id, number, len(own), text, found.ids, mask, start, end))
            done.clear()
            return pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.format(kind=kind).split(", ")])

        size = 0
        for batch in batches:
            for conv_id, role, text in zip(batch["conv_id"].astype(object), batch["role"], batch["text"], strict=True):
                conv_id = None if pd.isna(conv_id) else conv_id
                if turns and (conv_id != current or held >= SEGMENT):
                    done.append((current, part, turns))
                    part, size, held, turns = (part + 1 if conv_id == current else 0), size + held, 0, []
                    if size >= SEGMENT or len(done) >= 200:
                        yield encoded()
                        size = 0
                if conv_id != current:
                    current, part = conv_id, 0
                turns.append((role or "", text or ""))
                held += len(turns[-1][0]) + len(turns[-1][1])
        if turns:
            done.append((current, part, turns))
        if done:
            yield encoded()

    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInPandas(run, SCHEMA.format(kind=kind))


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What the output holds, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The parts of a conversation pass in order through one task, a part at a time; only
    hash states are kept. ``formatted`` may be stored and read in any order before.
    """
    template = template or Template()
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def learned(text: str, mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[str]:
        """The text under the mask; code points that several tokens share come once."""
        start, end = np.asarray(start)[np.asarray(mask, bool)], np.asarray(end)[np.asarray(mask, bool)]
        if not len(start):
            return
        new = np.flatnonzero(np.concatenate([[True], start[1:] > np.maximum.accumulate(end)[:-1]]))
        tops = np.maximum.reduceat(end, new)
        for low, high in zip(start[new], tops, strict=True):
            yield template.unescape(text[low:high])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, out = object(), None, []

        def close() -> None:
            if state:
                out.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv_id, text, mask, start, end in zip(batch["conv_id"].astype(object), batch["formatted"], batch["loss_mask"], batch["token_start"], batch["token_end"], strict=True):
                conv_id = None if pd.isna(conv_id) else conv_id
                if conv_id != current:
                    close()
                    current, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in template.parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for said in learned(text, mask, start, end):
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])
            out.clear()
        close()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    ordered = formatted.select("conv_id", "part", "formatted", "loss_mask", "token_start", "token_end").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInPandas(run, schema)


def with_control_texts(spark, folder: str) -> DataFrame:
    """The conversations and one more, whose texts hold control strings."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return rows.unionByName(extra)
