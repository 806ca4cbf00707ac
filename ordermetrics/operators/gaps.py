"""Sums over all pairs of two event lists of a key, without the pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermetrics.functions.timeframe import NTZ
from ordermetrics.operators.prefix import _same, running_sum
from ordermetrics.session import written

_WIDE = "decimal(38,0)"


def _clock(ts: str) -> list[Column]:
    """Day number ``__d`` and microseconds since midnight ``__t`` on the wall clock."""
    at = F.col(ts).cast(NTZ)
    minutes = F.extract(F.lit("HOUR"), at) * 60 + F.extract(F.lit("MINUTE"), at)
    micros = minutes.cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return [F.unix_date(F.to_date(at)).cast("long").alias("__d"), micros.alias("__t")]


def day_gap_sums(starts: DataFrame, ends: DataFrame, keys: Sequence[str], groups: Sequence[str], start: str, end: str, weight: str) -> DataFrame:
    """Per ``groups``: ``gap_days``, the whole days from each start to each end of its keys, summed, and ``gap_pairs``.

    A group is a column of the starts, or one that only the ends have. Days are rounded down, as ``days_floor`` does. With day numbers d
    and times of day t, a pair's gap is d(end) - d(start), less one where t(end) < t(start). The first part follows from counts and day
    sums of both lists, one row a key and group. The second needs nothing more for a key whose starts all stand before its ends on the
    clock, or all behind; only the others are scanned (``_behind``). So rows grow with starts plus ends, never with their product. An end
    counts ``weight`` times. Starts without a row in ``ends`` are left out, as in an inner join; an end without a time makes no pair but
    keeps its starts, so their groups can have 0 pairs. This runs a job, and the lists are read again only where keys must be scanned.
    """
    of_ends = [g for g in groups if g not in [*keys, *starts.columns]]
    of_starts = [g for g in groups if g not in [*keys, *of_ends]]
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    weighed = ends.where(named).select(*keys, *of_ends, F.col(weight).cast("long").alias("__n"), *_clock(end))
    timed = starts.where(F.col(start).isNotNull()).select(*keys, *of_starts, *_clock(start))
    targets = weighed.groupBy(*keys, *of_ends).agg(
        F.sum(F.when(F.col("__t").isNotNull(), F.col("__n"))).alias("__ends"), F.sum(F.col("__n") * F.col("__d")).alias("__end_days"),
        F.min("__t").alias("__first_end"), F.max("__t").alias("__last_end"))
    origins = timed.groupBy(*keys, *of_starts).agg(
        F.count(F.lit(1)).alias("__starts"), F.sum("__d").alias("__start_days"), F.min("__t").alias("__first"), F.max("__t").alias("__last"))
    both = written(origins.join(targets, list(keys)), "gaps")

    def wide(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("decimal(19,0)")

    pairs = (wide("__starts") * wide("__ends")).cast(_WIDE)
    before = F.col("__first_end").isNull() | (F.col("__last") <= F.col("__first_end"))
    mixed = ~before & (F.col("__first") <= F.col("__last_end"))
    less = F.when(before | mixed, F.lit(0).cast(_WIDE)).otherwise(pairs)
    days = (wide("__starts") * wide("__end_days")).cast(_WIDE) - (wide("__ends") * wide("__start_days")).cast(_WIDE)
    parts = both.select(*groups, (days - less).cast(_WIDE).alias("__gap"), pairs.alias("__pairs"))
    open_ = both.where(mixed).select(*keys, *of_starts, *of_ends)
    if not open_.isEmpty():
        crossed = _behind(timed, weighed, open_, keys, of_starts, of_ends)
        parts = parts.unionByName(crossed.select(*groups, (-F.col("__less")).cast(_WIDE).alias("__gap"), F.lit(0).cast(_WIDE).alias("__pairs")))
    return parts.groupBy(*groups).agg(F.sum("__gap").cast(_WIDE).alias("gap_days"), F.sum("__pairs").cast(_WIDE).alias("gap_pairs"))


def _behind(timed: DataFrame, weighed: DataFrame, open_: DataFrame, keys: Sequence[str], of_starts: Sequence[str], of_ends: Sequence[str]) -> DataFrame:
    """(keys, groups, __less): for the keys and groups ``open_``, how many ends stand before a start on the clock, summed over the starts.

    That count is a running sum of end weights along the time of day, for keys with any number of events.
    """
    named = [*keys, *of_starts]
    rows = timed.join(open_.withColumnsRenamed({c: f"__o_{c}" for c in named}), _same(named, [f"__o_{c}" for c in named]))
    before = written(rows.groupBy(*named, *of_ends, "__t").agg(F.count(F.lit(1)).alias("__n")), "starts")
    after = weighed.where(F.col("__t").isNotNull()).join(open_.select(*keys).distinct(), list(keys), "left_semi")
    # a start stands before the ends of its own time of day
    clock = before.select(*keys, *of_ends, "__t", F.lit(0).alias("__side"), F.lit(0).cast("long").alias("__n")).unionByName(
        after.select(*keys, *of_ends, "__t", F.lit(1).alias("__side"), "__n"))
    spot = [*keys, *of_ends, "__t"]
    merged = clock.groupBy(*spot, "__side").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__n"))
    sums = running_sum(merged, [*keys, *of_ends], ["__t", "__side"], "__n", "__behind").where(F.col("__side") == 0)
    behind = sums.select(*[F.col(c).alias(f"__b_{c}") for c in spot], "__behind")
    return before.join(behind, _same(spot, [f"__b_{c}" for c in spot])).groupBy(*named, *of_ends).agg(
        F.sum((F.col("__n").cast("decimal(19,0)") * F.col("__behind").cast("decimal(19,0)")).cast(_WIDE)).cast(_WIDE).alias("__less"))
