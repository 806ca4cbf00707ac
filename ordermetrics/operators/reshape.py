"""Long to wide and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_to_wide(df: DataFrame, index: str, column: str, value: str, values: Sequence[str]) -> DataFrame:
    """One column per category. ``values`` is given, so no job runs to find it."""
    return df.groupBy(index).pivot(column, list(values)).agg(F.first(value, ignorenulls=True))


def wide_to_long(df: DataFrame, index: str, columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot([index], list(columns), name, value)


def transposed(df: DataFrame, index: str, columns: Sequence[str], values: Sequence[str], name: str = "metric") -> DataFrame:
    """Metrics become rows and the values of ``index`` become columns."""
    text = df.select(F.col(index).cast("string").alias(index), *[F.col(c).cast("double") for c in columns])
    long = wide_to_long(text, index, columns, name)
    return long.groupBy(name).pivot(index, list(values)).agg(F.first("value", ignorenulls=True))
