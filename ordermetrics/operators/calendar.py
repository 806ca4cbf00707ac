"""Fiscal periods and gap-free series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordermetrics.functions.predicates import as_column
from ordermetrics.functions.timeframe import NTZ, day, parse_moment, truncated

GRAINS = ("Weekly", "Monthly", "Quarterly", "Yearly")


def sunday_week(ts: Column | str) -> Column:
    """Start of the week that begins on Sunday."""
    return (truncated("week", as_column(ts) + F.expr("INTERVAL 1 DAY")) - F.expr("INTERVAL 1 DAY")).cast(NTZ)


def period_start(ts: Column | str, grain: str) -> Column:
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}; use one of {GRAINS}")
    unit = {"Monthly": "month", "Quarterly": "quarter", "Yearly": "year"}
    return sunday_week(ts) if grain == "Weekly" else truncated(unit[grain], ts)


def period_label(ts: Column | str, grain: str) -> Column:
    """Week start date, ``month/year``, ``yearQn`` or ``year`` as text."""
    ts = as_column(ts)
    year = F.year(ts).cast("string")
    forms = {
        "Weekly": lambda: F.date_format(sunday_week(ts), "yyyy-MM-dd"),
        "Monthly": lambda: F.concat(F.month(ts).cast("string"), F.lit("/"), year),
        "Quarterly": lambda: F.concat(year, F.lit("Q"), F.quarter(ts).cast("string")),
        "Yearly": lambda: year,
    }
    return forms[grain]()


def fiscal_calendar(spark: SparkSession, start, end) -> DataFrame:
    """One row per day: Date, Week (from Sunday), Month, Quarter, Year as text."""
    first, last = parse_moment(start), parse_moment(end)
    days = spark.range((last - first).days + 1)
    dated = days.select(
        (F.lit(first.isoformat(" ")).cast(NTZ) + F.make_dt_interval(F.col("id").cast("int"))).cast(NTZ).alias("Date")
    )
    return dated.select(
        "Date",
        sunday_week("Date").alias("Week"),
        F.month("Date").cast("string").alias("Month"),
        F.quarter("Date").cast("string").alias("Quarter"),
        F.year("Date").cast("string").alias("Year"),
    )


def period_keys(calendar: DataFrame | None) -> list[str]:
    """Columns to group by: the start alone where the label follows from it."""
    return ["period_start"] if calendar is None else ["period", "period_start"]


def with_label(df: DataFrame, grain: str) -> DataFrame:
    """Add the label to a frame grouped by :func:`period_keys`."""
    return df if "period" in df.columns else df.withColumn("period", period_label("period_start", grain))


def with_period(df: DataFrame, ts: str, grain: str, calendar: DataFrame | None = None) -> DataFrame:
    """Add ``period_start``, and ``period`` (label) when a calendar table is supplied.

    Without a table the start is computed in place and :func:`with_label` adds
    the label after aggregation, so no text is shuffled. A supplied table (one
    row per day) is joined on the day; days it lacks get null periods.
    """
    if calendar is None:
        return df.withColumn("period_start", period_start(ts, grain))
    label = {
        "Weekly": F.date_format("Week", "yyyy-MM-dd"),
        "Monthly": F.concat("Month", F.lit("/"), "Year"),
        "Quarterly": F.concat("Year", F.lit("Q"), "Quarter"),
        "Yearly": F.col("Year"),
    }[grain]
    start = F.min(F.col("Date").cast(NTZ)).over(Window.partitionBy("period"))
    periods = calendar.withColumn("period", label).withColumn("period_start", start)
    days = periods.select(F.col("Date").cast(NTZ).alias("__day"), "period", "period_start")
    return df.withColumn("__day", day(ts)).join(days, "__day", "left").drop("__day")


def fill_periods(df: DataFrame, period: str, unit: str, zero: Sequence[str] = (), groups: Sequence[str] = ()) -> DataFrame:
    """Add the missing periods between the first and the last one.

    ``df`` is already aggregated to one row per period (and group). Columns in
    ``zero`` become 0 in added rows, all others null. Every row emits the
    periods up to its successor, so the aggregation is not computed twice as a
    separate spine join would.
    """
    step = F.expr(f"INTERVAL 1 {unit}")
    following = F.lead(period).over(Window.partitionBy(*groups).orderBy(period))
    spans = df.withColumn("__until", F.coalesce((following - step).cast(NTZ), F.col(period)))
    filled = spans.withColumn("__slot", F.explode(F.sequence(F.col(period), F.col("__until"), step)))
    real = F.col("__slot") == F.col(period)
    kept = [
        F.col(c) if c in groups
        else F.col("__slot").alias(c) if c == period
        else F.when(real, F.col(c)).otherwise(F.lit(0) if c in zero else F.lit(None)).alias(c)
        for c in df.columns
    ]
    return filled.select(*kept)
