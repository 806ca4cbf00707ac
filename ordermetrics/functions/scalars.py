"""Arithmetic, null handling and presentation formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordermetrics.functions.predicates import as_column


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double; null when the denominator is zero or null."""
    top, bottom = as_column(numerator).cast("double"), as_column(denominator).cast("double")
    return F.try_divide(top, bottom)


def half_even(value: Column | str, digits: int = 2) -> Column:
    """Round half to even, the data-frame convention."""
    return F.bround(as_column(value).cast("double"), digits)


def sum_or_zero(value: Column | str) -> Column:
    """Sum that is 0 for no values."""
    return F.coalesce(F.sum(as_column(value)).cast("double"), F.lit(0.0))


def mean(value: Column | str) -> Column:
    """Sum over count in double, so that exact (decimal) sums give exact means."""
    value = as_column(value)
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def half_even_cents(value: Column | str) -> Column:
    """Mean of amounts in whole cents, rounded half to even at cents without passing through a binary quotient."""
    value = as_column(value)
    total, n = F.sum((value * 100).cast("decimal(28,0)")), F.count(value).cast("decimal(20,0)")
    size, whole = F.abs(total), F.floor(F.abs(total) / n)
    whole = F.when(whole * n > size, whole - 1).otherwise(whole)  # the quotient is rounded at its last digit
    twice = (size - whole * n) * 2
    up = (twice > n) | ((twice == n) & (whole % 2 == 1))
    cents = (whole + up.cast("int")).cast("double") / 100
    return F.when(n > 0, F.when(total < 0, -cents).otherwise(cents))


def count_present(*columns: Column | str) -> Column:
    """How many of the columns are not null in this row."""
    return reduce(lambda a, b: a + b, [as_column(c).isNotNull().cast("int") for c in columns])


def first_present(*columns: Column | str) -> Column:
    return F.coalesce(*[as_column(c) for c in columns])


# --- presentation: only the last step of a report, metrics stay numeric ---

def thousands(value: Column | str, digits: int = 0) -> Column:
    """``1234.5`` as ``1,234.5``."""
    return F.format_number(as_column(value), digits)


def thousands_float(value: Column | str) -> Column:
    """Grouped digits that keep a float's shortest fraction: ``1234.0`` is ``1,234.0``."""
    text = as_column(value).cast("double").cast("decimal(38,2)")
    whole = F.format_number(F.floor(F.abs(text)).cast("decimal(38,0)"), 0)
    cents = F.regexp_replace(F.regexp_extract(F.abs(text).cast("string"), r"\.(\d+)$", 1), r"(\d)0$", "$1")
    return F.concat(F.when(text < 0, "-").otherwise(""), whole, F.lit("."), cents)


def money(value: Column | str) -> Column:
    """``1234.5`` as ``$1,234.50``."""
    return F.concat(F.lit("$"), F.format_number(as_column(value), 2))


def fixed(value: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{int(digits)}f", as_column(value).cast("double"))


def percent_text(value: Column | str) -> Column:
    return F.concat(as_column(value).cast("string"), F.lit("%"))


def spaced(value: Column | str) -> Column:
    """Code to words: underscores become spaces."""
    return F.replace(as_column(value), F.lit("_"), F.lit(" "))


DATE_FORMATS = {
    "iso_day": "yyyy-MM-dd",
    "month_day": "MM/dd",
    "month_year": "MMMM yyyy",
    "stamp": "MMM dd, yyyy HH:mm",
}


def date_text(ts: Column | str, form: str = "iso_day") -> Column:
    return F.date_format(as_column(ts), DATE_FORMATS[form])


def snapshot_stamp(path: Column | str) -> Column:
    """The ``YYYYmmdd_HHMMSS`` part of a file path as text ('' when absent)."""
    return F.regexp_extract(as_column(path), r"(\d{8}_\d{6})", 1)
