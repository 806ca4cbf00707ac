"""Running sums over keys of any size, by a scan over the ranges of one exchange."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordermetrics.session import written


def _same(a: Sequence[str], b: Sequence[str]):
    return reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.col(q)) for p, q in zip(a, b, strict=True)])


def placed_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | None = None) -> DataFrame:
    """One row per place (``keys`` and ``order``): its rows ``__rows``, their sum ``__value`` and the sum ``__upto`` within the keys up to it.

    ``order`` ascends, nulls last; without ``value`` rows are counted. Places go through one range exchange by (keys, order),
    so each partition holds a stretch of the order however many rows a key or a day has; sums run inside a partition,
    and a key that reaches over several gets the totals of its earlier ones. Only places and sums are stored; this runs a job.
    """
    place = [*keys, *order]
    sums = df.groupBy(*place).agg(
        F.count(F.lit(1)).alias("__rows"), (F.count(F.lit(1)) if value is None else F.sum(value)).alias("__value"))
    along = [F.col(c).asc_nulls_first() for c in keys] + [F.col(c).asc_nulls_last() for c in order]
    stored = written(sums.repartitionByRange(*along).withColumn("__part", F.spark_partition_id()), "places")
    inside = Window.partitionBy("__part", *keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    summed = stored.withColumn("__inside", F.sum("__value").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    spread = stored
    if keys:
        # only the first key of a partition can have begun in an earlier one: at most one row a partition
        first = stored.groupBy("__part").agg(F.min(F.struct(*keys)).alias("k")).select(*[F.col(f"k.{c}").alias(f"__k_{c}") for c in keys]).distinct()
        spread = stored.join(F.broadcast(first), _same(keys, [f"__k_{c}" for c in keys]), "left_semi")
    totals = spread.groupBy(*keys, "__part").agg(F.sum("__value").alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = [*keys, "__part"]
    offsets = totals.select(*[F.col(c).alias(f"__o_{c}") for c in held], F.sum("__total").over(earlier).alias("__before"))
    # the rows of ``offsets`` are at most two a partition
    return summed.join(F.broadcast(offsets), _same(held, [f"__o_{c}" for c in held]), "left").select(
        *place, "__rows", "__value", (F.col("__inside") + F.coalesce("__before", F.lit(0))).alias("__upto"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, order, value, name): the running sum of ``value`` within ``keys`` along ``order``.

    Each (keys, order) may stand once, else the result raises; other columns are left out.
    """
    twice = F.raise_error(F.lit(f"{[*keys, *order]} are not one row each"))
    sums = placed_sums(df, keys, order, value)
    total = F.col("__upto")
    return sums.select(
        *keys, *order, F.col("__value").alias(value),
        F.when(F.col("__rows") > 1, twice.cast(sums.schema["__upto"].dataType)).otherwise(total).alias(name))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with a sequence number within ``keys`` along ``order`` (ascending, nulls last), for keys of any size.

    Numbers come from places alone; other columns are neither sorted by range nor stored, but meet their place by one
    join, for which ``df`` is computed again. Rows of one place get consecutive numbers.
    """
    place = [*keys, *order]
    sums = placed_sums(df, keys, order)
    if set(df.columns) <= set(place):
        numbers = F.explode(F.sequence(F.col("__upto") - F.col("__rows") + 1, "__upto"))
        return sums.select(*df.columns, numbers.alias(name))
    # a struct is never null and equals one with nulls at the same fields, so window and join share an exchange
    here = F.struct(*place).alias("__place")
    nth = F.row_number().over(Window.partitionBy("__place").orderBy("__place"))
    rows = df.select("*", here).withColumn("__nth", nth)
    before = sums.select(here, (F.col("__upto") - F.col("__rows")).alias("__before"))
    return rows.join(before, "__place").select(*df.columns, (F.col("__before") + F.col("__nth")).cast("long").alias(name))
