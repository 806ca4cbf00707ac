"""Distinct counts of any period from stored daily sketches.

A HyperLogLog sketch of the entities of each (day, group) is stored once. Sketches merge without loss, so weeks, months,
quarters and years come from the same small table, and a day that gets more rows is merged, not counted again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermetrics.functions.timeframe import day
from ordermetrics.operators.calendar import GRAINS, period_start
from ordermetrics.sources.partitions import changed

PRECISION = 14  # 2^14 registers: a relative standard error of about 0.7 %


def daily_sketches(df: DataFrame, ts: str, groups: Sequence[str], entity: str, precision: int = PRECISION) -> DataFrame:
    """(date, groups, sketch) of the distinct non-null ``entity`` values (whole numbers or text) of each day.

    Partial sketches are built map-side, so a hot day or group ships one sketch a task. Rows without a time are left out.
    """
    rows = df.where(F.col(ts).isNotNull() & F.col(entity).isNotNull())
    return rows.groupBy(day(ts).alias("date"), *groups).agg(F.hll_sketch_agg(entity, precision).alias("sketch"))


def merge_days(path: str, sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Merges daily sketches into the table at ``path``, which has a folder a month; only the months of ``sketches`` are read and rewritten.

    Merging the same rows again changes nothing, so a load that died half-way is simply repeated. Returns the stored table.
    """
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy("month", "date", *groups).agg(F.hll_union_agg("sketch").alias("sketch"))

    named = sketches.withColumn("month", F.date_format("date", "yyyy-MM"))
    return changed(named, path, "month", merge).drop("month")


def period_distinct(sketches: DataFrame, groups: Sequence[str], grains: Sequence[str] = GRAINS, name: str = "n") -> DataFrame:
    """(grain, period_start, groups, name): estimated distinct entities of each period of each grain, from one read of the table."""
    starts = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), period_start("date", g).alias("period_start")) for g in grains]))
    spread = sketches.select("sketch", *groups, starts.alias("__p")).select("sketch", *groups, "__p.grain", "__p.period_start")
    return spread.groupBy("grain", "period_start", *groups).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))
