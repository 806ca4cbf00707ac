"""Join shapes. No hint is forced: with adaptive execution Spark broadcasts a
side only when its measured size is below the session's threshold, and splits
skewed partitions otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermetrics.operators.rank import first_per_key, latest_per_key
from ordermetrics.session import written


def join_on(left: DataFrame, right: DataFrame, keys: Mapping[str, str], how: str = "left", null_safe: bool = False,
            as_text: bool = False, spread: Sequence[str] = ()) -> DataFrame:
    """Equi-join on differently named keys; the right key columns are dropped.

    ``null_safe`` lets null ids meet null ids, as data-frame merges do; the
    default is SQL's (they never match). ``as_text`` compares the keys as text.
    For a full or right join the left key takes the right key's value.
    Rows of a left join whose key is null match nothing and would all reach one
    task; they are dealt by the hash of the left columns ``spread``.
    """
    renamed = right.withColumnsRenamed({r: f"__r_{r}" for r in keys.values()})

    def same(l: str, r: str) -> Column:
        a, b = left[l], renamed[f"__r_{r}"]
        if as_text:
            a, b = a.cast("string"), b.cast("string")
        return a.eqNullSafe(b) if null_safe else a == b

    on = reduce(lambda a, b: a & b, [same(l, r) for l, r in keys.items()])
    if spread:
        if how != "left" or null_safe:
            raise ValueError("spread is for left joins on which nulls don't match")
        absent = reduce(lambda a, b: a | b, [left[l].isNull() for l in keys])
        dealt = left.withColumn("__dealt", F.when(absent, F.xxhash64(*spread)).otherwise(F.lit(0).cast("long")))
        # zero, but not a literal, which the optimizer would take out of the join's keys
        zero = F.pmod(F.xxhash64(*[f"__r_{r}" for r in keys.values()]), F.lit(1)).cast("long")
        joined = dealt.join(renamed.withColumn("__r_dealt", zero), on & (F.col("__dealt") == F.col("__r_dealt")), how)
        return joined.drop("__dealt", "__r_dealt", *[f"__r_{r}" for r in keys.values()])
    joined = left.join(renamed, on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "full_outer", "outer", "right", "right_outer"):
        joined = joined.withColumns({l: F.coalesce(left[l], F.col(f"__r_{r}")) for l, r in keys.items()})
    return joined.drop(*[f"__r_{r}" for r in keys.values()])


def with_first_child(parents: DataFrame, children: DataFrame, keys: Mapping[str, str], by: Sequence[str],
                     tie: Sequence[str] = ()) -> DataFrame:
    """Each parent with its first child: still one row per parent.

    The child side shrinks to one row per key before the join, so a parent
    with a huge number of children costs the join nothing.
    """
    return join_on(parents, first_per_key(children, list(keys.values()), by, tie), keys, "left")


def sent_with_latest_return(shipments: DataFrame, key: str = "order_id", kind: str = "type",
                            by: Sequence[str] = ("delivered_date", "ship_date", "created_at"),
                            tie: Sequence[str] = (), sent: str = "NORMAL", returned: str = "RETURN",
                            columns: Sequence[str] = ("ship_date",)) -> DataFrame:
    """Outgoing shipments full-outer-joined with the latest return per order.

    Written as a left join plus the returns nothing was sent for: Spark can
    split a skewed left join but not a full one.
    """
    out = shipments.where(F.col(kind) == sent).select(key, *[F.col(c).alias(f"kit_sent_{c}") for c in columns])
    back = latest_per_key(shipments.where(F.col(kind) == returned), [key], by, tie).select(
        key, *[F.col(c).alias(f"kit_return_{c}") for c in columns]
    )
    matched = out.join(back, key, "left")
    unsent = back.join(out.select(key).distinct(), key, "left_anti")
    return matched.unionByName(unsent, allowMissingColumns=True)


def semi_top(df: DataFrame, top: DataFrame, column: str) -> DataFrame:
    """Rows whose value is in the top set."""
    return df.join(top.select(column), column, "left_semi")


def unique_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value); a key that occurs twice raises when the result is computed."""
    twice = F.raise_error(F.concat(F.lit(f"{key} occurs more than once: "), F.col(key).cast("string")))
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max(value).alias(value))
    return counted.select(key, F.when(F.col("__n") > 1, twice.cast(df.schema[value].dataType)).otherwise(F.col(value)).alias(value))


def rates_by_row(df: DataFrame, codes: Sequence[str], units: Sequence[str], rate_card: DataFrame, code: str, rate: str) -> DataFrame:
    """Rows with ``rate_total`` (summed rate x units) and ``code_count``.

    Rows are stored once with their place (partition, number), so each keeps it; their codes become (place, code, units), the units of
    a code that a row has several times summed before anything is shuffled. These narrow rows meet the card in one join, on which a
    code with a third of all rows is split by adaptive execution, and their sums meet the stored rows by place. Rows need no id; a
    code that stands twice in the card raises. Give ``df`` without columns that aren't needed later.
    """
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = written(df.withColumns({"__part": F.spark_partition_id(), "__at": number}), "coded")
    pairs = F.array(*[F.struct(F.col(c).alias("code"), F.coalesce(F.col(u), F.lit(0)).alias("units")) for c, u in zip(codes, units, strict=True)])
    held = F.filter(pairs, lambda p: p["code"].isNotNull())
    kinds = F.array_distinct(F.transform(held, lambda p: p["code"]))
    kind = rows.select(pairs[0]["units"].alias("u")).schema["u"].dataType
    zero = F.lit(0).cast(kind)
    once = F.transform(kinds, lambda k: F.struct(
        k.alias("code"), F.aggregate(F.filter(held, lambda p: p["code"] == k), zero, lambda total, p: (total + p["units"]).cast(kind)).alias("units")))
    used = rows.select("__part", "__at", F.explode(once).alias("__p")).select("__part", "__at", F.col("__p.code").alias("__code"), F.col("__p.units").alias("__units"))
    card = unique_values(rate_card, code, rate).select(F.col(code).alias("__code"), F.col(rate).alias("__rate"))
    totals = used.join(card, "__code").groupBy("__part", "__at").agg(F.sum(F.col("__rate") * F.col("__units")).alias("__total"))
    count = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in codes])
    total = F.coalesce("__total", F.lit(0))
    return rows.join(totals, ["__part", "__at"], "left").withColumns(
        {"rate_total": F.when(count > 0, total), "code_count": F.when(count > 0, count)}).drop("__part", "__at", "__total")


def aligned(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Outer concatenation of several series on their shared index columns, each index value once.

    The series are stacked and meet in one aggregation instead of a chain of full joins, which can't be split on a hot
    value. Null index values are one value. A series that holds an index value twice raises.
    """
    marked = [f.withColumn(f"__in{i}", F.lit(1)) for i, f in enumerate(frames)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    names = [c for f in frames for c in f.columns if c not in on]
    once = stacked.groupBy(*on).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names], *[F.sum(f"__in{i}").alias(f"__in{i}") for i in range(len(frames))])
    most = F.greatest(*[F.col(f"__in{i}") for i in range(len(frames))]) if len(frames) > 1 else F.col("__in0")
    twice = F.raise_error(F.lit(f"a series has a value of {list(on)} more than once")).cast("boolean")
    return once.where(F.when(most > 1, twice).otherwise(F.lit(True))).select(*on, *names)


def aligned_series(sources: Mapping[str, tuple[DataFrame, Column]], on: Mapping[str, Column], measure=F.sum) -> DataFrame:
    """Series of raw rows side by side on their index: ``sources`` maps a column to (rows, value), ``on`` an index column to its expression.

    All rows are stacked as (index, series number, value) and aggregated together, so there is one exchange whatever the number
    of series, and a hot index value shrinks map-side. ``measure`` sums by default; a series is null where it has no row.
    """
    parts = [rows.select(*[c.alias(n) for n, c in on.items()], F.lit(i).cast("byte").alias("__series"), value.alias("__value"))
             for i, (rows, value) in enumerate(sources.values())]
    stacked = reduce(lambda a, b: a.unionByName(b), parts)
    return stacked.groupBy(*on).agg(*[measure(F.when(F.col("__series") == i, F.col("__value"))).alias(n) for i, n in enumerate(sources)])
