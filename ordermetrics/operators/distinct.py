"""Distinct counts that hold on skewed groups.

All of these first reduce to one row per (group, entity) and only then to one
row per group. The heavy shuffle is therefore keyed by the entity as well, so
a group holding a third of all rows is spread over every task, and the second
shuffle moves partial counts only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_when(df: DataFrame, groups: Sequence[str], entity: str, stages: Mapping[str, Column]) -> DataFrame:
    """Per group, distinct ``entity`` values that meet each stage condition.

    One pass for any number of stages: an entity's flags are or-ed map-side,
    where several COUNT(DISTINCT CASE ...) would multiply every row.
    """
    flags = [F.max(F.coalesce(cond, F.lit(False)).cast("int")).alias(name) for name, cond in stages.items()]
    per_entity = df.where(F.col(entity).isNotNull()).groupBy(*groups, entity).agg(*flags)
    return per_entity.groupBy(*groups).agg(
        *[F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name) for name in stages]
    )


def distinct_count(df: DataFrame, groups: Sequence[str], entity: Column | str, name: str,
                   approximate: bool = False) -> DataFrame:
    """COUNT(DISTINCT entity) per group, or a HyperLogLog estimate of it."""
    measure = F.approx_count_distinct(entity) if approximate else F.count_distinct(entity)
    return df.groupBy(*groups).agg(measure.cast("long").alias(name))


def stacked_distinct(sources: Mapping[str, tuple[DataFrame, Column]], groups: Sequence[str]) -> DataFrame:
    """Distinct counts from several sources in one aggregation.

    ``sources`` maps a measure name to (frame, entity id). Each frame must
    carry the ``groups`` columns. The frames are stacked as (groups, measure,
    entity) and counted together, which replaces one aggregation per measure
    and the full outer joins that would line the results up.
    """
    picked = [
        frame.select(*groups, F.lit(number).cast("byte").alias("measure"), entity.alias("entity"))
        for number, (frame, entity) in enumerate(sources.values())
    ]
    one_type = len({part.schema["entity"].dataType for part in picked}) == 1
    parts = picked if one_type else [p.withColumn("entity", F.col("entity").cast("string")) for p in picked]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    once = stacked.where(F.col("entity").isNotNull()).select(*groups, "measure", "entity").distinct()
    return once.groupBy(*groups).agg(
        *[F.count(F.when(F.col("measure") == n, 1)).alias(name) for n, name in enumerate(sources)]
    )


def distinct_domain(df: DataFrame, column: str) -> DataFrame:
    """The values a selector of ``column`` offers, in order; null is no choice."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
