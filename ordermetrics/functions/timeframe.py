"""Time buckets, month bounds, spans in days and zone conversion."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordermetrics.functions.predicates import as_column

NTZ = "timestamp_ntz"


def day(ts: Column | str) -> Column:
    """Midnight of the day."""
    return F.to_date(as_column(ts)).cast(NTZ)


def truncated(unit: str, ts: Column | str) -> Column:
    """SQL DATE_TRUNC for hour, day, week, month, quarter or year.

    Built on dates and wall-clock hours: DATE_TRUNC would pass through the
    session zone and move times its clock changes skip.
    """
    ts = as_column(ts)
    if unit == "hour":
        return (day(ts) + F.make_dt_interval(F.lit(0), F.hour(ts))).cast(NTZ)
    return day(ts) if unit == "day" else F.trunc(F.to_date(ts), unit).cast(NTZ)


def as_instant(ts: Column | str) -> Column:
    """The instant at which a UTC clock shows this wall-clock time."""
    ts = as_column(ts)
    minutes = (F.unix_date(F.to_date(ts)).cast("long") * 24 + F.hour(ts)) * 60 + F.minute(ts)
    seconds = F.extract(F.lit("SECOND"), ts).cast("decimal(18,6)")
    return F.timestamp_micros((minutes * 60_000_000 + seconds * 1_000_000).cast("long"))


def wall_clock(instant: Column | str) -> Column:
    """What a UTC clock shows at an instant."""
    seconds = (F.unix_micros(as_column(instant)) / F.lit(1_000_000).cast("decimal(18,6)")).cast("decimal(18,6)")
    start = F.lit("1970-01-01 00:00:00").cast(NTZ)
    return (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).cast(NTZ)


def bucket(ts: Column | str, frequency: str) -> Column:
    """Left-labelled bucket for Daily, Weekly or Monthly.

    Weekly buckets run Tuesday to Monday and carry the Monday before as label,
    so a Monday belongs to the bucket labelled one week earlier.
    """
    ts = as_column(ts)
    forms = {
        "daily": lambda: day(ts),
        "weekly": lambda: truncated("week", ts - F.expr("INTERVAL 1 DAY")),
        "monthly": lambda: truncated("month", ts),
    }
    try:
        return forms[frequency.lower()]()
    except KeyError:
        raise ValueError(f"unknown frequency {frequency!r}; use Daily, Weekly or Monthly") from None


def bucket_end(ts: Column | str, frequency: str) -> Column:
    """Right-labelled bucket: week ending Sunday, or the last day of the month."""
    ts = as_column(ts)
    forms = {
        "daily": lambda: day(ts),
        "weekly": lambda: (truncated("week", ts) + F.expr("INTERVAL 6 DAYS")).cast(NTZ),
        "monthly": lambda: F.last_day(ts).cast(NTZ),
    }
    try:
        return forms[frequency.lower()]()
    except KeyError:
        raise ValueError(f"unknown frequency {frequency!r}; use Daily, Weekly or Monthly") from None


def iso_week(ts: Column | str) -> Column:
    return F.weekofyear(as_column(ts))


def iso_year(ts: Column | str) -> Column:
    """Year the ISO week belongs to (that of its Thursday)."""
    return F.year(truncated("week", ts) + F.expr("INTERVAL 3 DAYS"))


def days_floor(later: Column | str, earlier: Column | str) -> Column:
    """Whole days of the elapsed time, rounded down (minus one hour is -1).

    Wall-clock arithmetic only, so the session zone cannot shift the result.
    """
    later, earlier = as_column(later).cast(NTZ), as_column(earlier).cast(NTZ)
    dates = F.datediff(later, earlier)
    incomplete = later < earlier + F.make_dt_interval(dates)
    return (dates - incomplete.cast("int")).cast("long")


def days_calendar(later: Column | str, earlier: Column | str) -> Column:
    """Difference of the two calendar dates."""
    return F.datediff(as_column(later), as_column(earlier)).cast("long")


def at_zone(ts: Column | str, zone: str, source: str = "UTC") -> Column:
    """Wall-clock time in ``zone`` of a wall-clock time in ``source``."""
    return F.convert_timezone(F.lit(source), F.lit(zone), as_column(ts).cast(NTZ))


@dataclass(frozen=True)
class MonthBounds:
    """First days and end (exclusive) of the current and the previous month."""

    previous_start: datetime
    current_start: datetime
    next_start: datetime
    today: datetime

    @property
    def days_in_current(self) -> int:
        return (self.next_start - self.current_start).days

    @property
    def days_in_previous(self) -> int:
        return (self.current_start - self.previous_start).days

    @property
    def same_day_previous(self) -> datetime:
        """Today one month earlier, kept inside the shorter month."""
        return self.previous_start + timedelta(days=min(self.today.day, self.days_in_previous) - 1)


def parse_moment(value: str | date | datetime) -> datetime:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.fromisoformat(value)


def month_bounds(as_of: str | date | datetime) -> MonthBounds:
    now = parse_moment(as_of)
    current = datetime(now.year, now.month, 1)
    previous = (current - timedelta(days=1)).replace(day=1)
    following = current + timedelta(days=calendar.monthrange(now.year, now.month)[1])
    return MonthBounds(previous, current, following, datetime(now.year, now.month, now.day))
