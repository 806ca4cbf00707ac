"""Row filters (half-open ranges, sentinels, null-aware lists, trailing windows)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "all"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def moment(value: Column | str | date | datetime) -> Column:
    """A literal point in time without zone; Columns pass through."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def in_days(ts: Column | str, start, end) -> Column:
    """``start <= ts < end + 1 day``: both calendar days are whole."""
    ts = as_column(ts)
    return (ts >= moment(start)) & (ts < moment(end) + F.expr("INTERVAL 1 DAY"))


def after_until(ts: Column | str, start, end) -> Column:
    """``start < ts <= end``: the left end is open."""
    ts = as_column(ts)
    return (ts > moment(start)) & (ts <= moment(end))


def between_midnights(ts: Column | str, start, end) -> Column:
    """SQL BETWEEN on dates: a time later than midnight on ``end`` falls outside."""
    return as_column(ts).between(moment(start), moment(end))


def matches_unless_all(column: Column | str, wanted) -> Column:
    """Equality, or everything when ``wanted`` is the 'all' sentinel (any case)."""
    if isinstance(wanted, str) and wanted.lower() == ALL:
        return F.lit(True)
    return as_column(column) == F.lit(wanted)


def every(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filter_choices(df: DataFrame, choices: Mapping[str, object]) -> DataFrame:
    """Apply one :func:`matches_unless_all` per selector; 'all' adds no filter."""
    return df.where(every(matches_unless_all(c, v) for c, v in choices.items()))


def where_optional(df: DataFrame, predicate: Column | None) -> DataFrame:
    """An extra predicate a caller may add to a stored query."""
    return df if predicate is None else df.where(predicate)


def in_list(column: Column | str, values: Iterable) -> Column:
    return as_column(column).isin(list(values))


def not_in_keep_null(column: Column | str, values: Iterable) -> Column:
    """Negated membership that keeps null values (data-frame convention)."""
    return ~F.coalesce(in_list(column, values), F.lit(False))


def not_in_drop_null(column: Column | str, values: Iterable) -> Column:
    """Negated membership that drops null values (SQL NOT IN)."""
    return ~in_list(column, values)


def null_or_false(flag: Column | str) -> Column:
    return ~F.coalesce(as_column(flag), F.lit(False))


def reached(stage_id: Column | str) -> Column:
    """A stage counts as reached when its id is present."""
    return as_column(stage_id).isNotNull()


def trailing(ts: Column | str, as_of, interval: str) -> Column:
    """At or after ``as_of - interval``; e.g. ``'30 DAYS'``."""
    return as_column(ts) >= moment(as_of) - F.expr(f"INTERVAL {interval}")


def within_last(ts: Column | str, as_of, interval: str) -> Column:
    """Strictly before ``as_of`` and no older than ``interval``."""
    return (as_column(ts) < moment(as_of)) & trailing(ts, as_of, interval)


def in_year_of(ts: Column | str, as_of) -> Column:
    """In the calendar year of ``as_of``; bounds are literals so the scan can skip row groups."""
    start = F.trunc(F.to_date(moment(as_of)), "year").cast("timestamp_ntz")
    ts = as_column(ts)
    return (ts >= start) & (ts < start + F.expr("INTERVAL 1 YEAR"))


def since_week_of(ts: Column | str, as_of, days: int) -> Column:
    """From the Monday of the week ``days`` before ``as_of``."""
    anchor = moment(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return as_column(ts) >= F.trunc(F.to_date(anchor), "week").cast("timestamp_ntz")


def has_prefix(column: Column | str, prefix: str) -> Column:
    return as_column(column).startswith(prefix)


def mentions(text: Column | str, *phrases: str) -> Column:
    """Case-blind contains of any phrase (null text mentions nothing)."""
    low = F.lower(as_column(text))
    found = reduce(lambda a, b: a | b, [low.contains(p.lower()) for p in phrases])
    return F.coalesce(found, F.lit(False))


def min_group_size(df: DataFrame, count_column: str, at_least: int) -> DataFrame:
    """HAVING count >= n over an aggregated frame."""
    return df.where(F.col(count_column) >= F.lit(at_least))
