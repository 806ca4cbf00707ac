"""Line-first cleaning: each line of a text is judged by itself, then what is left of the text.

A line with a word fails by the first of these rules that holds:

* navigation: it has a word of separators alone, and such words are a quarter of its words or more;
* punctuation: symbols of markup and code exceed a tenth of its word characters;
* boilerplate: it has at most ``notice_words`` words and holds a phrase of legal or site notices;
* punctuation: it has at least ``sentence_words`` words, no end mark, and is not the last line
  with a word, which may be cut off.

Failing lines are taken out. A document is kept unless the base rules fail it or more than
``most_lost`` percent of its word characters stood in failing lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»•·/\\<–—:-"
END_MARKS = ".!?…:;\"'”’»)]}。！？；：」』"
NOTICES = (
    "all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados",
    "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "enable javascript",
    "lorem ipsum", "licensed under", "released under", "copyright ©", "©",
)


@dataclass(frozen=True)
class Rules:
    notice_words: int = 30
    sentence_words: int = 5
    most_lost: int = 50
    least_words: int = 50
    most_repeated: int = 50


RESULT = (
    "text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_removed long, lost_chars long, base_failed boolean, kept boolean")
COLUMNS = [part.split()[0] for part in RESULT.split(", ")]

_word = re.compile(WORD)
_symbol = re.compile("[" + re.escape(SYMBOLS) + "]")
_notice = re.compile("|".join(re.escape(x) for x in NOTICES))
_ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_fails(words: list[str], chars: int, last: bool, rules: Rules) -> bool:
    """Whether a line of these words, ``chars`` characters in all, goes."""
    separators = sum(not w.strip(SEPARATORS) for w in words)
    if separators and 4 * separators >= len(words):
        return True
    if 10 * sum(len(_symbol.findall(w)) for w in words) > chars:
        return True
    if len(words) <= rules.notice_words and _notice.search(" ".join(words).translate(_ascii_lower)):
        return True
    return not last and len(words) >= rules.sentence_words and words[-1][-1] not in END_MARKS


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words inside windows of ``width`` that occur twice or more; exact, without hashing."""
    if len(words) <= width:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    windows = ids[: len(ids) - width + 1]
    for i in range(1, width):
        # a window's number is dense again before the next word is added, so it always fits
        windows = windows * len(numbers) + ids[i : len(ids) - width + 1 + i]
        _, windows, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[windows] > 1
    hit = np.zeros(len(ids), bool)
    for i in range(width):
        hit[i : len(ids) - width + 1 + i] |= again
    return int(hit.sum())


def judge(text: str | None, rules: Rules) -> tuple:
    """The values of ``RESULT`` for one text."""
    if text is None:
        return None, 0, 0, 0, 0, 0, 0, 0, 0, True, False
    lines = text.split("\n")
    split = [_word.findall(line) for line in lines]
    words = [w for line in split for w in line]
    sizes = [sum(map(len, line)) for line in split]
    last = max((i for i, line in enumerate(split) if line), default=-1)
    failing = {i for i, line in enumerate(split) if line and line_fails(line, sizes[i], i == last, rules)}
    with_word = [line for line, found in zip(lines, split, strict=True) if found]
    chars, lost, repeated = sum(sizes), sum(sizes[i] for i in failing), repeated_words(words)
    base = len(words) < rules.least_words or 100 * repeated > rules.most_repeated * len(words)
    return (
        "\n".join(line for i, line in enumerate(lines) if i not in failing) if failing else text,
        len(words), chars, len(_symbol.findall(text)), len(with_word) - len(set(with_word)), repeated,
        len(lines), len(failing), lost, base, not base and 100 * lost <= rules.most_lost * chars)


def cleaned(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with failing lines taken out of ``text`` and the columns of ``RESULT`` added.

    One row per input row, repeated rows and null doc_ids included; each row is judged
    alone, so nothing is shuffled. A null text stays null, counts no words and fails the
    base rules, as does an empty one. ``text`` is replaced where it stands; other columns
    pass through, but for those named in ``RESULT``, which are replaced.
    """

    @F.pandas_udf(RESULT)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([judge(t, rules) for t in texts], columns=COLUMNS)

    added = COLUMNS[1:]
    docs = docs.drop(*added)
    name = "_judged"
    while name in docs.columns:
        name += "_"
    found = docs.select("*", judged("text").alias(name))
    kept = [F.col(f"{name}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*kept, *[F.col(f"{name}.{c}").alias(c) for c in added])
