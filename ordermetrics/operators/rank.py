"""Row choice and numbering within a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"


def _rank_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # row_number = 1 becomes a WindowGroupLimit: each map task keeps one row per
    # key before the shuffle, so a hot key never reaches one task as a whole.
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) == 1).drop(_RANK)


def latest_per_key(df: DataFrame, keys: Sequence[str], by: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest ``by`` per key (nulls first, as in SQL DESC)."""
    return _rank_one(df, keys, [F.col(c).desc_nulls_first() for c in by] + [F.col(c).asc() for c in tie])


def first_per_key(df: DataFrame, keys: Sequence[str], by: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The row with the least ``by`` per key (nulls last, as a data-frame sort)."""
    return _rank_one(df, keys, [F.col(c).asc_nulls_last() for c in by] + [F.col(c).asc() for c in tie])


def last_loaded_per_key(df: DataFrame, keys: Sequence[str], load_order: str) -> DataFrame:
    """The most recently loaded row per key."""
    return _rank_one(df, keys, [F.col(load_order).desc_nulls_last()])


def sorted_by(df: DataFrame, *columns: str, ascending: bool | Sequence[bool] = True) -> DataFrame:
    """Sort chosen by the caller; missing values last in either direction."""
    ways = [ascending] * len(columns) if isinstance(ascending, bool) else list(ascending)
    return df.orderBy(
        *[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in zip(columns, ways, strict=True)]
    )


def top_groups(df: DataFrame, group: str, measure: Column, n: int, name: str = "measure") -> DataFrame:
    """The ``n`` groups with the greatest measure; equal measures in group order."""
    return df.groupBy(group).agg(measure.alias(name)).orderBy(F.col(name).desc_nulls_last(), F.col(group)).limit(n)


def frequency(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """How often each value occurs, most frequent first; nulls are left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(F.col(name).desc(), F.col(column))


def append_rows(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
