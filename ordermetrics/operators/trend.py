"""Running totals, running shares and straight-line projection.

These work on frames already aggregated to one row per day, period or value,
so the window of a group holds as many rows as the calendar has entries.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def so_far(groups: Sequence[str], order: str):
    return Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_total(df: DataFrame, order: str, totals: Mapping[str, str], groups: Sequence[str] = ()) -> DataFrame:
    """Add running sums: ``totals`` maps new column to summed column."""
    window = so_far(groups, order)
    return df.withColumns({name: F.sum(source).over(window) for name, source in totals.items()})


def running_share(df: DataFrame, order: str, count: str, total: Column, name: str, groups: Sequence[str] = ()) -> DataFrame:
    """Running sum as percent of a fixed total."""
    share = F.try_divide(F.sum(count).over(so_far(groups, order)).cast("double"), total.cast("double"))
    return df.withColumn(name, share * F.lit(100.0))


def straight_line(df: DataFrame, x: str, y: str, name: str, groups: Sequence[str] = ()) -> DataFrame:
    """Least-squares fit of y on x over rows with y, predicted for every row and
    rounded; null when fewer than two points exist."""
    whole = Window.partitionBy(*groups)
    at, value = F.col(x).cast("double"), F.col(y).cast("double")
    slope = F.regr_slope(value, at).over(whole)
    intercept = F.regr_intercept(value, at).over(whole)
    enough = F.count(value).over(whole) >= 2
    return df.withColumn(name, F.when(enough, F.bround(slope * at + intercept, 0)))
