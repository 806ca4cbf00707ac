"""Exact quantiles and summary statistics per group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordermetrics.session import written


def value_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """How often each value occurs in each group, with the slice of the whole it lies in.

    Slices are the partitions of a range exchange by (group, value), so they ascend with
    the values of a group, a hot group spans many, and their number is the session's
    partition count. Stored once for the steps below.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(
        group, F.col(value).cast("double").alias("__v")
    )
    counts = rows.groupBy(group, "__v").agg(F.count(F.lit(1)).alias("__n"))
    return written(counts.repartitionByRange(group, "__v").withColumn("__slice", F.spark_partition_id()), "values")


def _sliced(counts: DataFrame, group: str) -> DataFrame:
    """Values with their group's size and mean."""
    facts = counts.groupBy(group).agg(
        F.sum("__n").alias("__total"),
        (F.sum(F.col("__n") * F.col("__v")) / F.sum("__n")).alias("__mean"),
    )
    return counts.join(facts, group)


def _ends(spans: DataFrame, group: str, probabilities: dict[str, float]) -> DataFrame:
    """The one or two 0-based ranks that enclose each quantile, with the slice that holds them."""
    wanted = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probabilities.items()])
    )
    placed = spans.withColumn("__q", wanted).withColumn("__at", F.col("__q.p") * (F.col("__total") - 1))
    ranks = F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at"))))
    return placed.select(
        group, "__slice", "__before", "__size", F.col("__q.name").alias("__name"), "__at", ranks.alias("__rank")
    ).where((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__size")))


def _quantiles(sliced: DataFrame, spans: DataFrame, group: str, probabilities: dict[str, float]) -> DataFrame:
    ends = _ends(spans, group, probabilities)
    # only slices that hold a wanted rank are sorted
    needed = sliced.join(ends.select(group, "__slice", "__before").distinct(), [group, "__slice"])
    inside = Window.partitionBy(group, "__slice").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("__before") + F.sum("__n").over(inside) - 1
    ranked = needed.select(group, "__slice", "__v", upto.alias("__last"), "__n").withColumn(
        "__first", F.col("__last") - F.col("__n") + 1
    )
    picked = ranked.join(ends.select(group, "__slice", "__name", "__at", "__rank"), [group, "__slice"]).where(
        F.col("__rank").between(F.col("__first"), F.col("__last"))
    )
    # linear interpolation between the enclosing values
    pairs = picked.groupBy(group, "__name", "__at").agg(
        F.min_by("__v", "__rank").alias("__low"), F.max_by("__v", "__rank").alias("__high")
    )
    fraction = F.col("__at") - F.floor("__at")
    result = F.col("__low") + (F.col("__high") - F.col("__low")) * fraction
    return pairs.groupBy(group).agg(*[F.max(F.when(F.col("__name") == n, result)).alias(n) for n in probabilities])


def _spans(sizes: DataFrame, group: str) -> DataFrame:
    """Rows before each slice; a group has at most one row per partition here."""
    earlier = Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))


def exact_quantiles(df: DataFrame, group: str, value: str, probabilities: dict[str, float]) -> DataFrame:
    """Interpolated quantiles, one column per entry of ``probabilities``.

    ``percentile`` holds all values of a group in one task. Here exact sizes
    of the group's slices tell where each wanted rank lies, and only there
    values are sorted.
    """
    sliced = _sliced(value_counts(df, group, value), group)
    sizes = sliced.groupBy(group, "__slice", "__total").agg(F.sum("__n").alias("__size"))
    return _quantiles(sliced, _spans(sizes, group), group, probabilities)


def described(df: DataFrame, group: str, value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max per group."""
    sliced = _sliced(value_counts(df, group, value), group)
    off = F.col("__v") - F.col("__mean")
    sizes = sliced.groupBy(group, "__slice", "__total", "__mean").agg(
        F.sum("__n").alias("__size"), F.sum(F.col("__n") * off * off).alias("__squares"),
        F.min("__v").alias("__min"), F.max("__v").alias("__max"),
    )
    plain = sizes.groupBy(group).agg(
        F.sum("__size").alias("count"), F.max("__mean").alias("mean"), F.sum("__squares").alias("__squares"),
        F.min("__min").alias("min"), F.max("__max").alias("max"),
    ).withColumn("std", F.sqrt(F.try_divide(F.col("__squares"), (F.col("count") - 1).cast("double"))))
    quartiles = _quantiles(sliced, _spans(sizes, group), group, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return plain.join(quartiles, group).select(group, "count", "mean", "std", "min", "q25", "q50", "q75", "max")
