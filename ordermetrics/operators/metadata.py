"""Child text rows gathered per parent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_values(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """All values per key as a sorted array (repeats kept, nulls left out).

    Values are counted per (key, value) first, so a parent with very many
    children sends each distinct value once per map task instead of every row.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    pair = F.struct(F.col(value).alias("v"), F.col("__n").cast("int").alias("n"))
    grouped = counted.groupBy(key).agg(F.array_sort(F.collect_list(pair)).alias("__pairs"))
    repeated = F.flatten(F.transform("__pairs", lambda p: F.array_repeat(p["v"], p["n"])))
    return grouped.select(key, repeated.alias(name))


def joined_values(df: DataFrame, key: str, value: str, name: str, separator: str = ", ") -> DataFrame:
    """All values per key as one text, in value order."""
    return array_values(df, key, value, "__values").select(key, F.array_join("__values", separator).alias(name))


def phrase_flags(df: DataFrame, key: str, value: str, flags: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per key, whether any child text has one of the phrases (case-blind).

    The same answer as searching the joined text for phrases that hold no
    separator, without building that text: the or is computed map-side.
    """

    def any_of(phrases: Sequence[str]):
        low = F.lower(F.col(value))
        return reduce(lambda a, b: a | b, [low.contains(p.lower()) for p in phrases])

    return df.groupBy(key).agg(
        *[F.coalesce(F.bool_or(any_of(phrases)), F.lit(False)).alias(name) for name, phrases in flags.items()]
    )


def condition_flags(df: DataFrame, key: str, flags: Mapping[str, Column]) -> DataFrame:
    """Per key, whether any child row meets each condition."""
    return df.groupBy(key).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()])


def phrase_digest(df: DataFrame, key: str, value: str, name: str, phrases: Sequence[str],
                  versioned: str, versions: Sequence[str]) -> DataFrame:
    """A short text per key that answers phrase searches like the joined text.

    It lists the ``phrases`` (LIKE patterns without a separator) any child has,
    and ``'<versioned> <v>'`` for each version where the joined, value-ordered
    text would match ``%<versioned> %<v>%``. There the phrase may stand in one
    child and the version in a later one, which the least child with the
    phrase and the greatest with the version decide. All parts are combined
    map-side in one aggregation, so no child's whole text is shuffled but the least
    and greatest ones.
    """
    low, start = F.lower(F.col(value)), f"{versioned} "
    starts = low.contains(start)
    parts = {f"p{i}": F.bool_or(low.like(f"%{p}%")) for i, p in enumerate(phrases)}
    parts["first"] = F.min(F.when(starts, F.col(value)))
    for i, v in enumerate(versions):
        parts[f"in{i}"] = F.bool_or(low.like(f"%{start}%{v}%"))
        # both in the wrong order: with a second such child, alike or not, one of each stands in order
        parts[f"twice{i}"] = F.count_if(starts & low.contains(v)) > 1
        parts[f"last{i}"] = F.max(F.when(low.contains(v), F.col(value)))
    grouped = df.where(F.col(value).isNotNull()).groupBy(key).agg(*[c.alias(f"__{n}") for n, c in parts.items()])
    words = [F.when(F.col(f"__p{i}"), F.lit(p)) for i, p in enumerate(phrases)]
    for i, v in enumerate(versions):
        spans = F.col("__first") < F.col(f"__last{i}")
        words.append(F.when(F.col(f"__in{i}") | F.col(f"__twice{i}") | spans, F.lit(f"{versioned} {v}")))
    return grouped.select(key, F.concat_ws(", ", *words).alias(name))
